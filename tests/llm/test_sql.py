"""The queries of the subpackage against their SQL."""

import duckdb
import pytest

from chunkmill.llm.queries import ORACLE_SQL, QUERIES

from .conftest import corpus

DATA = "/root/testdata/sf0.001"


def value(v):
    return round(v, 6) if isinstance(v, float) else v


def compared(spark, con, name, folder):
    df = QUERIES[name](spark, folder)
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(map(value, r)) for r in df.select(*names).collect()), key=repr)
    assert got == sorted((tuple(map(value, r)) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    compared(spark, con, name, DATA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_of_odd_texts_are_those_of_the_sql(spark, tmp_path, name):
    rows = {r[0]: r for r in corpus() if r[0] is not None and not (name == "op1_licenses" and "\u0130" in (r[1] or ""))}  # a letter that the two lower differently
    spark.createDataFrame([*rows.values()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    compared(spark, con, name, str(tmp_path))
