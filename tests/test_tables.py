import gzip
import hashlib
import json
import sqlite3
import subprocess
import time
from contextlib import closing

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql.datasource import WriterCommitMessage

from chunkmill import cli
from chunkmill.functions import text
from chunkmill.operators import edits, positions, row_cdc, synthetic
from chunkmill.plans import experiment, formats, render, report
from chunkmill.sources import listing, parquet_pages
from chunkmill.streaming import incremental


@pytest.mark.parametrize("kind", ["int", "float", "str", "largestr", "bool", ["int"], {"x": "int", "y": "str"}])
def test_generated_values_follow_the_seed(spark, kind):
    make = lambda seed: [r["a"] for r in synthetic.generate(spark, {"a": kind}, 40, seed).orderBy("_pos").collect()]
    a = make(42)
    assert a == make(42) and a != make(43) and None not in a


def test_generated_values_are_in_range_and_do_not_depend_on_partitions(spark):
    schema = '{"a": "int", "b": "float", "c": "str", "d": "largestr", "e": ["int"]}'
    df = synthetic.generate(spark, schema, 300)
    rows = df.orderBy("_pos").collect()
    assert all(0 <= r["a"] < 10**6 and 0 <= r["b"] < 10**6 and 10 <= len(r["c"]) < 100 and 100 <= len(r["d"]) < 1000 and len(r["e"]) < 5 for r in rows)
    assert {c for r in rows for c in r["d"]} == set(synthetic.ALPHABET)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
    assert synthetic.generate(spark, schema, 300).orderBy("_pos").collect() == rows
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_unsupported_types_are_refused(spark):
    for bad in ("unknown", [], 3):
        with pytest.raises(ValueError, match="Unsupported data type"):
            synthetic.generate(spark, {"a": bad}, 1)


def test_variants(spark):
    gen = synthetic.Generator(spark, {"a": "int", "b": "str", "c": ["float"]})
    t, v = edits.variants(gen, 100, [0.25, 0.75], 0.1, ["a", "c"], 5)
    assert set(v) == {"deleted", "inserted", "appended", "updated", "updated_a", "updated_c"}
    pos = lambda d: sorted(r["_pos"] for r in d.select("_pos").collect())
    for name, n in (("deleted", 90), ("inserted", 110), ("appended", 110), ("updated", 100), ("updated_c", 100)):
        assert pos(v[name]) == list(range(n)), name
    base = {r["_pos"]: r for r in t.collect()}
    changed = [r["_pos"] for r in v["updated"].collect() if r != base[r["_pos"]]]
    assert sorted(changed) == [25, 75]
    only = [r for r in v["updated_c"].collect() if r != base[r["_pos"]]]
    assert all(r["a"] == base[r["_pos"]]["a"] and r["b"] == base[r["_pos"]]["b"] for r in only) and {r["_pos"] for r in only} <= {25, 75}
    gone = [r["a"] for r in v["deleted"].orderBy("_pos").collect()]
    assert gone == [base[p]["a"] for p in range(100) if not (20 <= p < 25 or 70 <= p < 75)]


def test_a_short_segment_is_deleted_whole(spark):
    t = synthetic.generate(spark, {"a": "int"}, 20)
    assert edits.delete_rows(t, [0.1, 0.9], 10).count() == 8


def test_positions_and_running_sums_over_many_partitions(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k").repartition(7)
    p = positions.with_positions(df, "k")
    assert [(r["k"], r["_pos"]) for r in p.orderBy("k").collect()] == [(i, i) for i in range(1000)]
    s = positions.running_sum(p, p["k"], "s", block=64)
    x = positions.running_sum(p, p["k"], "s", exclusive=True, block=64)
    assert [r["s"] for r in s.orderBy("k").collect()] == np.cumsum(range(1000)).tolist()
    assert [r["s"] for r in x.orderBy("k").collect()] == (np.cumsum(range(1000)) - range(1000)).tolist()


def test_running_sums_of_each_key(spark):
    rows = [(k, p, (p * 7 + len(k or "")) % 11) for k in ("a", "bb", None) for p in range(300)]
    df = spark.createDataFrame(rows, "k string, p long, v long").repartition(5)
    got = positions.running_sum(df, df["v"], "s", "p", by=("k",), block=16, top=4)
    assert got.columns == ["k", "p", "v", "s"]
    want = [(k, p, v, sum(x for j, q, x in rows if j == k and q <= p)) for k, p, v in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_long_row_chunk_comes_in_parts(spark):
    df = spark.range(1000).selectExpr("id AS _pos", "'same' AS t")
    (one,) = row_cdc.row_chunks(df, df["t"], below="00").collect()
    assert one["n_rows"] == 1000
    parts = row_cdc.row_chunks(df, df["t"], below="00", max_rows=300).orderBy("first_pos").collect()
    assert [(r["chunk"], r["first_pos"], r["n_rows"]) for r in parts] == [(0, 0, 300), (0, 300, 300), (0, 600, 300), (0, 900, 100)]
    assert len({r["hash"] for r in parts}) == 2


def test_a_row_chunk_over_many_pieces_has_one_hash(spark):
    n = row_cdc.PIECE + 700
    df = spark.range(n).selectExpr("id AS _pos", "'same' AS t")
    got = row_cdc.row_chunks(df, df["t"], below="00").collect()
    assert [tuple(r) for r in got] == [(0, 0, n, 4 * n, hashlib.md5("\n".join(["same"] * n).encode()).hexdigest())]


@pytest.mark.parametrize("piece", [1, 7, 64, 1000])
def test_row_chunks_do_not_depend_on_pieces(spark, piece):
    rows = [(k, p, f"{k}-{p * 7919 % 61}" if p % 5 else "") for k in ("a", None) for p in range(500)]
    want = []
    for k in ("a", None):
        chunk, texts, first = 0, [], 0
        for p, t in ((p, t) for j, p, t in rows if j == k):
            texts.append(t)
            if hashlib.md5(t.encode()).hexdigest()[:2] < "10" or p == 499:
                want.append((k, chunk, first, len(texts), sum(map(len, texts)), hashlib.md5("\n".join(texts).encode()).hexdigest()))
                chunk, texts, first = chunk + 1, [], p + 1
    df = spark.createDataFrame(rows, "k string, _pos long, t string").repartition(3)
    assert sorted(map(tuple, row_cdc.row_chunks(df, df["t"], below="10", by=("k",), piece=piece).collect()), key=repr) == sorted(want, key=repr)


def test_row_chunks_survive_an_insertion(spark):
    t = synthetic.generate(spark, {"a": "int", "b": "int"}, 3000)
    e = edits.insert_rows(t, [0.5], lambda n: synthetic.generate(spark, {"a": "int", "b": "int"}, n, 7), rows=3000)
    hashes = [{r["hash"] for r in row_cdc.row_chunks(x, row_cdc.row_text(x["a"], x["b"])).collect()} for x in (t, e)]
    assert len(hashes[1] - hashes[0]) <= 3


@pytest.mark.parametrize("binary", [True, False])
def test_sizes_are_rounded_as_printf_does(spark, binary):
    base, units = (1024, ("KiB", "MiB", "GiB", "TiB")) if binary else (1000, ("kB", "MB", "GB", "TB"))
    near = [base**k * q // 20 + d for k in (1, 2, 3, 4) for q in (20, 21, 23, 25, 27, 29, 35, 45, 247, 12685, 19995, 20479) for d in (-1, 0, 1)]
    sizes = [None, 0, 1, 2, base - 1, *near, 4503599627369882, 2**63 - 1]

    def want(n):
        if n is None or n < base:
            return None if n is None else "1 Byte" if n == 1 else f"{n} Bytes"
        k = min(next(k for k in range(1, 99) if n < base ** (k + 1)), 4)
        return f"{n / float(base**k):.1f} {units[k - 1]}"

    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n long")
    got = df.select("i", "n", text.natural_size(df["n"], binary).alias("size")).orderBy("i").collect()
    assert [(r["n"], r["size"]) for r in got] == [(n, want(n)) for n in sizes]


@pytest.mark.parametrize("fmt,stem", [
    (formats.ParquetFormat(), ""), (formats.ParquetFormat("snappy", use_cdc=True), "snappy cdc"), (formats.ParquetFormat(use_cdc=True, row_group_size=2048, data_page_size=512), "cdc rg=2Ki dp=512Bytes"),
    (formats.ParquetFormat("zstd", row_group_size=1 << 20), "zstd rg=1Mi"), (formats.JsonLinesFormat("gzip"), "gzip"), (formats.SqliteFormat(), ""), (formats.ParquetFormat(use_dictionary=False), "nodict"),
])
def test_names(fmt, stem):
    assert fmt.paramstem == stem
    tag = f"-{stem.replace(' ', '-').replace('=', '-')}" if stem else ""
    assert fmt.derive_path("t", "/d").name == f"t{tag}.{fmt.suffix}"


def test_round_trips(spark, tmp_path):
    t = synthetic.generate(spark, {"a": "int", "b": "str"}, 100)
    want = formats.arrow_table(t)
    path = formats.ParquetFormat("zstd", use_cdc=formats.ChunkBounds(1 << 18, 1 << 20), row_group_size=10).write("t", t, tmp_path)
    assert pq.read_metadata(path).num_row_groups == 10 and pq.read_table(path).equals(want) and pq.read_metadata(path).row_group(0).column(0).compression == "ZSTD"
    again = formats.ParquetFormat("snappy", row_group_size=20).write("u", path, tmp_path)
    assert pq.read_metadata(again).num_row_groups == 5
    lines = formats.JsonLinesFormat().write("t", path, tmp_path).read_text().splitlines()
    assert [json.loads(x) for x in lines] == want.to_pylist()
    for _ in range(2):
        db = formats.SqliteFormat().write("t", t, tmp_path)
    con = sqlite3.connect(db)
    assert con.execute('SELECT a, b FROM "table"').fetchall() == [tuple(r.values()) for r in want.to_pylist()]
    con.close()
    assert formats.rewrite(path).name == f"{path.stem}-dedup-cdc.parquet"
    formats.write_cdc_parquet(t, str(tmp_path / "sink"), row_group_size=30)
    assert edits.same_rows(spark.read.parquet(str(tmp_path / "sink")), t)


@pytest.mark.parametrize("rows", [0, 5, 100])
def test_one_file_sinks_do_not_collect_the_table(spark, tmp_path, monkeypatch, rows):
    t = spark.range(rows).selectExpr("99 - id AS _pos", "id AS a", "if(id % 3 = 0, null, concat('ü', id)) AS b", "timestamp_seconds(id) AS c").repartition(7)
    want = formats.arrow_table(t).combine_chunks()
    pq.write_table(want, tmp_path / "want.parquet", row_group_size=30, compression="zstd", use_content_defined_chunking=True)
    lines = "".join(json.dumps(r, ensure_ascii=False, default=str, separators=(",", ":")) + "\n" for r in want.to_pylist())

    def collected(*_):
        raise AssertionError("the whole table came to the driver")

    monkeypatch.setattr(formats, "arrow_table", collected)
    monkeypatch.setattr(type(t), "toArrow", collected)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        parquet = formats.ParquetFormat("zstd", use_cdc=True, row_group_size=30)
        assert parquet.write("t", t, tmp_path).read_bytes() == (tmp_path / "want.parquet").read_bytes()
        with pytest.raises(AssertionError, match="does not hold"):
            parquet._check(t.withColumn("a", t["a"] + (t["a"] == rows - 1).cast("long")) if rows else t.select("_pos", "a"), tmp_path / "want.parquet")
        assert formats.JsonLinesFormat().write("t", t, tmp_path).read_text() == lines
        assert gzip.decompress(formats.JsonLinesFormat("gzip").write("t", t, tmp_path).read_bytes()).decode() == lines
        db = formats.SqliteFormat().write("t", t.select("_pos", "a", "b"), tmp_path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    with closing(sqlite3.connect(db)) as con:
        assert con.execute('SELECT a, b FROM "table"').fetchall() == [tuple(r.values()) for r in want.drop(["c"]).to_pylist()]


def test_sink_loses_no_rows(spark, tmp_path):
    path = tmp_path / "sink"
    hundred = lambda a: spark.range(a, a + 100, numPartitions=3)
    read = lambda: sorted(r["id"] for r in spark.read.parquet(str(path)).collect())
    for k in range(2):
        formats.write_cdc_parquet(hundred(100 * k), path.as_uri() if k else str(path), "append")
    assert read() == list(range(200))
    formats.write_cdc_parquet(hundred(500), str(path))
    assert read() == list(range(500, 600))
    formats.write_cdc_parquet(hundred(0).where("id < 0"), str(path), "append")
    assert read() == list(range(500, 600)) and len(list(path.iterdir())) == 3
    with pytest.raises(PySparkException):
        formats.write_cdc_parquet(hundred(0).selectExpr("id", "assert_true(id < 90) AS x"), str(path))
    until = time.time() + 20
    while len(list(path.iterdir())) > 3 and time.time() < until:  # tasks that the failed job left running remove their own files
        time.sleep(0.2)
    assert read() == list(range(500, 600)) and len(list(path.iterdir())) == 3
    formats.write_cdc_parquet(hundred(0).where("id < 0"), str(path))
    assert spark.read.parquet(str(path)).columns == ["id"] and read() == []


def test_a_crash_before_the_commit_keeps_the_old_parts(spark, tmp_path):
    path = str(tmp_path / "sink")
    formats.write_cdc_parquet(spark.range(10), path)
    writer = formats.CdcParquet({"path": path}).writer(spark.range(1).schema, True)
    left = f"{path}/.{writer.job}-part-00000-7.parquet"
    pq.write_table(pa.table({"id": [1, 2]}), left)
    assert spark.read.parquet(path).count() == 10
    message = WriterCommitMessage()
    message.file = left
    writer.commit([message, None])
    assert [r["id"] for r in spark.read.parquet(path).collect()] == [1, 2]


def test_refusals():
    with pytest.raises(ValueError):
        formats.codec("brotli9")
    with pytest.raises(ValueError):
        formats.ParquetFormat(use_cdc=formats.ChunkBounds(1, 2), flavor="rs").options()
    assert formats.codec("SNAPPY") == "snappy" and formats.codec("Uncompressed") is None


def test_pages_are_those_of_the_file(spark, tmp_path):
    path = str(tmp_path / "x.parquet")
    pq.write_table(pa.table({"x": list(range(1000)), "y": ["v"] * 1000}), path, row_group_size=250, data_page_size=256, use_dictionary=["y"], compression="snappy")
    rows = parquet_pages.parquet_pages(spark, [path]).collect()
    for c in "xy":
        assert sum(r["num_values"] for r in rows if r["column"] == c and r["page_type"].startswith("data")) == 1000
    assert sum(r["page_type"] == "dictionary_page" for r in rows) == 4
    assert parquet_pages.histogram(parquet_pages.data_page_sizes(spark, [path]), "uncompressed_bytes").agg({"n": "sum"}).first()[0] == sum(r["page_type"].startswith("data") for r in rows)
    assert parquet_pages.parquet_pages(spark, []).count() == 0


def test_results_one_for_each_group_and_format(spark, tmp_path):
    t = synthetic.generate(spark, {"a": "int"}, 50)
    r = experiment.compare_formats_tables(spark, [formats.ParquetFormat(), formats.JsonLinesFormat()], {"same": {"a": t, "b": t}, "one": {"a": t}}, tmp_path)
    rows = {(x["group"], x["format"]): x for x in r.collect()}
    assert len(rows) == 4 and rows["same", "jsonl"]["numfiles"] == 2 and rows["same", "jsonl"]["dedup_ratio"] == 0.5 and rows["one", "parquet-cpp"]["dedup_ratio"] == 1
    text = report.table_text(r)
    assert "jsonl" in text and text.count("*") >= 2
    assert "parquet-cpp (same)" in report.bars_html(r, tmp_path / "bars.html") and (tmp_path / "bars.html").exists()
    p = experiment.compare_formats(spark, formats.ParquetFormat(), {"x": formats.ParquetFormat("zstd")}, t, tmp_path / "p").collect()
    assert [(x["group"], x["numfiles"], x["params"]) for x in p] == [("param-impact", 2, "zstd")]


def test_colours_stretch_and_average():
    c = render.color_sequence(np.array([0, 1]))
    assert c[0].tolist() == [0, 255, 0] and c[-1].tolist() == [255, 0, 0] and len(c) == 8192
    assert render.color_sequence(np.zeros(100_000, int)).min(axis=0).tolist() == [0, 255, 0]
    assert render.png(c)[16:24] == (256).to_bytes(4, "big") * 2


def test_strips(spark):
    occ = spark.createDataFrame([(0, 0, "x", 5), (1, 0, "x", 5), (1, 1, "y", 50)], "file_idx long, ord long, hash string, size long")
    got = {(r["doc"], r["file_idx"], r["ord"]): (r["opacity"], r["height"]) for r in report.cells(occ).collect()}
    assert got == {(d, f, o): (op, h) for (f, o, h, shown) in ((0, 0, 1.0, (0.5, 0.5)), (1, 0, 1.0, (0.5, 0.5)), (1, 1, 10.0, (0.15, 1.0))) for d, op in enumerate(shown)}
    assert report.strips_html(occ).count('title="chunk') == 6


def test_revisions(tmp_path, capsys):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@localhost", *a], check=True, capture_output=True)
    git("init", "-q")
    for text in ("one", "two"):
        (tmp_path / "f.txt").write_text(text)
        git("add", "-A")
        git("commit", "-qm", text)
    out = listing.checkout_revisions(tmp_path / "f.txt", tmp_path / "out")
    assert [p.read_text() for p in out] == ["two", "one"] and all(p.name.startswith("f-") for p in out)
    assert listing.checkout_revisions(tmp_path / "f.txt", tmp_path / "none", until_rev="HEAD", from_rev="HEAD") == []
    assert cli.main(["revisions", str(tmp_path / "f.txt"), "-d", str(tmp_path / "cli")]) == 0
    assert "has 2 revisions" in capsys.readouterr().out and {p.read_text() for p in (tmp_path / "cli").iterdir()} == {"one", "two"}


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "v1.parquet"
    pq.write_table(pa.table({"a": list(range(100)), "b": ["x" * 100] * 100}), path)
    (tmp_path / "v2.parquet").write_bytes(path.read_bytes())
    assert cli.main(["dedup", str(path), str(path)]) == 0
    assert "Deduplication ratio: 50.00%" in capsys.readouterr().out
    assert cli.main(["stats", str(tmp_path), "--with-json"]) == 0
    assert "combined" in capsys.readouterr().out
    assert cli.main(["rewrite", str(path)]) == 0
    assert cli.main(["--plot", str(tmp_path / "pages.html"), "page-chunks", str(path)]) == 0
    assert (tmp_path / "pages.html").read_text().count("<tr>") >= 1
    assert cli.main(["param-impact", str(path), str(tmp_path)]) == 1
    assert "Please specify" in capsys.readouterr().out


def test_command_synthetic(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "variants", lambda gen, rows, *a, **k: edits.variants(gen, rows >> 12, *a, **k))
    assert cli.main(["--plot", str(tmp_path / "bars.html"), "synthetic", '{"a": "int"}', "-d", str(tmp_path / "out"), "-s", "1", "-e", "2", "--with-json"]) == 0
    shown = capsys.readouterr().out
    for name in ("deleted", "inserted", "appended", "updated", "updated_a"):
        assert f"s1c1e2-{name}" in shown and {p.name for p in (tmp_path / "out" / f"s1c1e2-{name}").iterdir()} == {"parquet-cpp", "parquet-rs", "jsonl"}
        assert len(list((tmp_path / "out" / f"s1c1e2-{name}" / "parquet-cpp").glob("*.parquet"))) == 8
    assert (tmp_path / "bars.html").exists()


def test_command_param_impact(spark, tmp_path, capsys):
    pq.write_table(pa.table({"a": list(range(3000))}), tmp_path / "v.parquet")
    assert cli.main(["param-impact", str(tmp_path / "v.parquet"), str(tmp_path / "out"), "--row-group-size"]) == 0
    shown = capsys.readouterr().out
    assert all(f"rg={t}" in shown for t in ("2Ki", "64Ki", "4Mi"))
    assert pq.read_metadata(next((tmp_path / "out").glob("*2048*.parquet"))).num_row_groups == 2


def test_new_chunks_of_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("s", "a" * 64 + "b" * 64), ("t", "a" * 64)], "k string, text string").coalesce(1).write.parquet(str(src))
    q = incremental.new_chunks(spark.readStream.schema("k string, text string").parquet(str(src)), "text", "k").writeStream.format("memory").queryName("new").outputMode("append").start()
    q.processAllAvailable()
    spark.createDataFrame([("u", "b" * 64 + "c" * 10)], "k string, text string").coalesce(1).write.mode("append").parquet(str(src))
    q.processAllAvailable()
    q.stop()
    assert sorted((r["size"]) for r in spark.table("new").collect()) == [10, 64, 64]


@pytest.mark.parametrize("sizes", [(1, 3), (700, 0, 9000), (8192, 20_011)])
def test_samples_are_those_of_the_sequence(spark, sizes):
    rng = np.random.default_rng(9)
    rows = [(f, o, f"h{rng.integers(0, 40 + 400 * (o % 3))}", 1) for f, n in enumerate(sizes) for o in range(n)]
    occ = spark.createDataFrame(rows, "file_idx long, ord long, hash string, size long")
    first = {}
    for f, _, h, _ in rows:
        first[h] = min(f, first.get(h, f))
    got = np.full((len(sizes) + 1, render.SAMPLES, 3), -1)
    for r in render.samples(occ).collect():
        got[r["picture"], r["i"]] = r["r"], r["g"], r["b"]
    for k in range(-1, len(sizes)):
        want = render.color_sequence(np.array([first[h] for f, _, h, _ in rows if k in (-1, f)], np.int64))
        near = np.abs(got[k] - want) if k < 0 or sizes[k] else got[k] + 1
        assert near.max() <= 1 and (near > 0).mean() < 0.02
