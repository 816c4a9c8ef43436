import math

import duckdb
import pytest

import __spark_entry__ as entry
from chunkmill.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    out = sorted((tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else value(r[i]) for i in order) for r in rows), key=repr)
    return sorted(names), out


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLE_SQL[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), [d[0] for d in found.description])


def test_entry(spark):
    assert 0.45 < entry.entry(spark).first()["dedup_ratio"] < 0.75


def test_cells_of_every_source(spark):
    from chunkmill.plans import queries, report

    occ = queries.occurrences(spark, DATA)
    few = occ.where("file_idx < 4")
    want = report.cells(few).groupBy("doc", "opacity", "height").count()
    assert sorted(map(tuple, report.looks(few).collect())) == sorted(map(tuple, want.collect()))
    got = QUERIES["multidoc_cells"](spark, DATA).groupBy("doc").sum("n").collect()
    sources = spark.read.parquet(f"{DATA}/documents.parquet").select("source").distinct().count()
    assert sources > 3 and {tuple(r) for r in got} == {(d, occ.count()) for d in range(sources)}


def test_all_part_files_are_read(spark, tmp_path):
    for t in ("orders", "lineitem"):
        spark.read.parquet(f"{DATA}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    size = {t: sum(p.stat().st_size for p in (tmp_path / f"{t}.parquet").glob("part-*")) for t in ("orders", "lineitem")}
    assert QUERIES["file_bytes_dedup"](spark, str(tmp_path)).first()["total_len"] == size["orders"] + 2 * size["lineitem"]
    pages = QUERIES["parquet_page_sizes"](spark, str(tmp_path)).where("page_type LIKE 'data%' AND column = 'l_orderkey'")
    assert pages.agg({"num_values": "sum"}).first()[0] == spark.read.parquet(f"{DATA}/lineitem.parquet").count()


@pytest.mark.parametrize("name", ["format_comparison", "format_comparison_lines"])
def test_formats_are_compared_without_collecting_tables(spark, monkeypatch, name):
    from pyspark.sql import DataFrame

    def collected(self):
        raise AssertionError("the whole table came to the driver")

    monkeypatch.setattr(type(spark.range(1)), "toArrow", collected)
    monkeypatch.setattr(DataFrame, "toArrow", collected)
    rows = QUERIES[name](spark, DATA).collect()
    assert len(rows) in (2, 3) and all(r["numfiles"] == 2 and r["total_len"] > 0 for r in rows)
