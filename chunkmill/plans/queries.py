"""Queries over the driver's tables, one for each operator, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.gear import Profile
from ..operators import chunking, dedup, edits, row_cdc, synthetic
from ..operators.positions import with_positions
from ..session import shared_folder
from ..sources import parquet_pages
from ..sources.listing import recursive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- chunks of fixed size; a source of documents is a file ----

_BLOCKS = """blocks AS (
    SELECT doc_id, source, lang, o AS ord, md5(substr(text, o * 64 + 1, 64)) AS hash, strlen(substr(text, o * 64 + 1, 64)) AS size
    FROM documents, range(0, CAST(ceil(length(text) / 64.0) AS BIGINT)) r(o))"""
_OCC = f"""{_BLOCKS}, files AS (SELECT source AS s, dense_rank() OVER (ORDER BY source) - 1 AS file_idx FROM (SELECT DISTINCT source FROM documents)),
    occ AS (SELECT file_idx, doc_id * 1000000 + ord AS ord, hash, size FROM blocks JOIN files ON source = s)"""


def _stats_sql(source: str, by: str = "") -> str:
    group = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"""SELECT {group}CAST(coalesce(sum(a), 0) AS BIGINT) AS total_len, CAST(coalesce(sum(size), 0) AS BIGINT) AS chunk_bytes, round(sum(size) / sum(a), 6) AS dedup_ratio
        FROM (SELECT {group}hash, any_value(size)::DOUBLE AS size, sum(size)::DOUBLE AS a FROM {source} GROUP BY {group}hash) {tail}"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(table(spark, sf_dir, "documents"), "text", "doc_id", "source", "lang")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as occurrences: file_idx by source, ord by document and block."""
    return dedup.file_index(blocks(spark, sf_dir), "source").select("file_idx", (F.col("doc_id") * 1000000 + F.col("ord")).alias("ord"), "hash", "size")


@query(f"WITH {_BLOCKS} {_stats_sql('blocks')}")
def fixed_chunk_dedup(spark, sf_dir):
    return dedup.stats(blocks(spark, sf_dir))


@query(f"WITH {_BLOCKS} {_stats_sql('blocks', 'source')}")
def fixed_chunk_dedup_by_source(spark, sf_dir):
    return dedup.stats(blocks(spark, sf_dir), "source")


@query(f"WITH {_BLOCKS} {_stats_sql('blocks', 'lang')}")
def dedup_ratio_by_lang(spark, sf_dir):
    return dedup.stats(blocks(spark, sf_dir), "lang")


@query(f"WITH {_OCC} SELECT hash, any_value(size) AS size, min(file_idx) AS first_seen_in FROM occ GROUP BY hash")
def chunk_first_seen(spark, sf_dir):
    return dedup.merge(occurrences(spark, sf_dir)).select("hash", "size", "first_seen_in")


_SEEN = "string_agg(DISTINCT lpad(file_idx::VARCHAR, 3, '0'), ',' ORDER BY lpad(file_idx::VARCHAR, 3, '0'))"


def _seen(df: DataFrame) -> DataFrame:
    return df.withColumn("seen_in", F.array_join(F.transform("seen_in", lambda x: F.lpad(x.cast("string"), 3, "0")), ","))


@query(f"WITH {_OCC} SELECT hash, {_SEEN} AS seen_in, count(*) AS n FROM occ GROUP BY hash")
def chunk_seen_in(spark, sf_dir):
    return _seen(dedup.merge(occurrences(spark, sf_dir))).select("hash", "seen_in", "n")


@query(f"""WITH {_OCC}, c AS (SELECT hash, any_value(size) AS size, min(file_idx) AS first_seen_in, {_SEEN} AS seen_in, count(*) AS n FROM occ GROUP BY hash)
    SELECT file_idx, ord, hash, c.size, first_seen_in, seen_in, n FROM occ JOIN c USING (hash)""")
def chunk_listing(spark, sf_dir):
    return _seen(dedup.listing(occurrences(spark, sf_dir))).select("file_idx", "ord", "hash", "size", "first_seen_in", "seen_in", "n")


@query(f"WITH {_OCC} SELECT file_idx, ord, min(file_idx) OVER (PARTITION BY hash) AS first_seen_in FROM occ")
def segments_by_source(spark, sf_dir):
    return dedup.segments(occurrences(spark, sf_dir))


@query(f"""WITH {_OCC}, f AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY file_idx, ord) AS k FROM occ)
    SELECT file_idx, CAST(sum(size) AS BIGINT) AS total_len, CAST(coalesce(sum(size) FILTER (k = 1), 0) AS BIGINT) AS new_bytes FROM f GROUP BY file_idx""")
def new_bytes_per_source(spark, sf_dir):
    return dedup.new_bytes(occurrences(spark, sf_dir))


@query(f"""WITH {_OCC} SELECT hash, CAST(any_value(size) AS BIGINT) AS size FROM occ WHERE file_idx >= 10 AND hash NOT IN (SELECT hash FROM occ WHERE file_idx < 10) GROUP BY hash""")
def chunks_to_upload(spark, sf_dir):
    occ = occurrences(spark, sf_dir)
    return dedup.missing(occ.where("file_idx >= 10"), occ.where("file_idx < 10")).select("hash", "size")


@query(f"""WITH {_OCC}, c AS (SELECT DISTINCT file_idx, hash, size FROM occ)
    SELECT x.file_idx AS a, y.file_idx AS b, CAST(sum(x.size) AS BIGINT) AS shared FROM c x JOIN c y ON x.hash = y.hash AND x.file_idx <= y.file_idx GROUP BY 1, 2""")
def shared_bytes_matrix(spark, sf_dir):
    return dedup.shared_bytes(occurrences(spark, sf_dir))


@query("SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(f"""WITH {_OCC}, each AS (SELECT file_idx, sum(a) AS total_len, sum(size) AS chunk_bytes FROM (SELECT file_idx, hash, any_value(size) AS size, sum(size) AS a FROM occ GROUP BY 1, 2) GROUP BY 1),
    merged AS ({_stats_sql('occ')})
    SELECT merged.total_len, merged.chunk_bytes, (SELECT CAST(sum(total_len) AS BIGINT) FROM each) AS sum_total_len, (SELECT CAST(sum(chunk_bytes) AS BIGINT) FROM each) AS sum_chunk_bytes FROM merged""")
def merge_totals(spark, sf_dir):
    """Totals of the merged files beside the sums of each file's own."""
    occ = occurrences(spark, sf_dir)
    each = dedup.stats(occ, "file_idx").agg(F.sum("total_len").alias("sum_total_len"), F.sum("chunk_bytes").alias("sum_chunk_bytes"))
    return dedup.stats(occ).select("total_len", "chunk_bytes").crossJoin(each)


@query(f"""WITH {_OCC}, s AS ({_stats_sql('occ')}) SELECT (SELECT count(DISTINCT source) FROM documents) AS numfiles, total_len, chunk_bytes, dedup_ratio FROM s""")
def estimate_row(spark, sf_dir):
    n = table(spark, sf_dir, "documents").agg(F.countDistinct("source").alias("numfiles"))
    return n.crossJoin(dedup.stats(occurrences(spark, sf_dir)))


@query()
def compressed_ratio(spark, sf_dir):
    """LZ4 sizes depend on the encoder, so there is no SQL."""
    occ = chunking.column_chunks(table(spark, sf_dir, "documents"), "text", "doc_id", "source", profile=Profile(9, 256))
    return dedup.stats(occ, "source", compressed=True)


@query(f"WITH {_BLOCKS} SELECT size, count(*) AS n FROM blocks GROUP BY size")
def block_size_counts(spark, sf_dir):
    return blocks(spark, sf_dir).groupBy("size").agg(F.count("*").alias("n"))


# ---- content-defined chunks of characters ----

_GEAR = """split AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''),
    codes AS (SELECT ch, CAST('0x' || substr(md5(ch), 1, 8) AS BIGINT) AS t FROM (SELECT DISTINCT ch FROM split)),
    chars AS (SELECT doc_id, i, t FROM split JOIN codes USING (ch)),
    h AS (SELECT doc_id, i, (""" + " + ".join(f"(lag(t, {k}, 0) OVER w % {1 << (32 - k)}) * {1 << k}" for k in range(32)) + """) % 4294967296 AS h FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    cand AS (SELECT doc_id, list(i ORDER BY i) AS c FROM h WHERE h < 67108864 GROUP BY doc_id),
    per_doc AS (SELECT d.doc_id, d.text, d.lang, length(d.text) AS len, coalesce(c, []) AS c FROM documents d LEFT JOIN cand USING (doc_id))"""  # fmt: skip


def _chunks_sql(least: int = 48) -> str:
    return f"""{_GEAR}, ends AS (SELECT doc_id, text, lang, list_append(list_reduce(list_prepend([0::BIGINT], list_transform(c, lambda x: [x])), lambda a, b: CASE WHEN b[1] - a[-1] >= {least} THEN list_concat(a, b) ELSE a END), len) AS e FROM per_doc),
    cut AS (SELECT doc_id, lang, k AS ord, e[k + 1] AS start, e[k + 2] - e[k + 1] AS n_chars, substr(text, e[k + 1] + 1, e[k + 2] - e[k + 1]) AS part FROM ends, range(0, len(e) - 1) r(k)),
    gear AS (SELECT doc_id, lang, ord, start, n_chars, strlen(part) AS size, md5(part) AS hash FROM cut)"""


@query(f"WITH {_GEAR} SELECT doc_id, len(c) AS n FROM per_doc")
def char_gear_candidates(spark, sf_dir):
    return chunking.char_candidate_counts(table(spark, sf_dir, "documents"), "text", "doc_id")


def _char_chunks(spark, sf_dir, **options) -> DataFrame:
    return chunking.char_chunks(table(spark, sf_dir, "documents"), "text", "doc_id", "lang", **options)


@query(f"WITH {_chunks_sql()} SELECT doc_id, ord, start, n_chars, size, hash FROM gear")
def char_gear_chunks(spark, sf_dir):
    return _char_chunks(spark, sf_dir).drop("lang")


@query(f"WITH {_chunks_sql()} {_stats_sql('gear')}")
def char_gear_dedup(spark, sf_dir):
    return dedup.stats(_char_chunks(spark, sf_dir))


_NEXT = "coalesce(list_filter(c, lambda x: x - {s} >= 48 AND x - {s} <= 128)[1], CASE WHEN len - {s} > 128 THEN {s} + 128 END)"


@query(f"""WITH RECURSIVE {_GEAR}, step AS (
        SELECT doc_id, text, len, c, 0::BIGINT AS start, {_NEXT.format(s="0")} AS stop FROM per_doc
        UNION ALL SELECT doc_id, text, len, c, stop, {_NEXT.format(s="stop")} FROM step WHERE stop IS NOT NULL),
    gear AS (SELECT md5(part) AS hash, strlen(part) AS size FROM (SELECT substr(text, start + 1, coalesce(stop, len) - start) AS part FROM step)) {_stats_sql('gear')}""")
def char_gear_dedup_maxlen(spark, sf_dir):
    """The bounded profile: at most 128 characters."""
    return dedup.stats(_char_chunks(spark, sf_dir, max_len=128))


@query("WITH " + _chunks_sql() + f""", m48 AS ({_stats_sql('gear')}), """ + _chunks_sql(96).replace(_GEAR + ", ", "").replace("ends", "ends96").replace("cut AS", "cut96 AS").replace("FROM cut)", "FROM cut96)").replace("gear AS", "gear96 AS") + f""", m96 AS ({_stats_sql('gear96')})
    SELECT 48 AS min_len, * FROM m48 UNION ALL SELECT 96, * FROM m96""")
def param_sweep(spark, sf_dir):
    """One parameter of the chunker over several values."""
    each = [dedup.stats(_char_chunks(spark, sf_dir, min_len=m)).select(F.lit(m).alias("min_len"), "*") for m in (48, 96)]
    return each[0].unionByName(each[1])


# ---- content-defined chunks of bytes ----

#: Short chunks, so that the short texts of the tables have several.
_BYTES = Profile(6, 64, digest="md5")


def _byte_chunks_sql(source: str, column: str, *keys: str) -> str:
    """Chunks of a column's bytes: the 64-bit gear hash of the last 64 bytes, candidates where its upper 6 bits are zero, at least 64 bytes a chunk."""
    k = ", ".join(keys)
    return f"""WITH bytes AS (SELECT {k}, hex(encode({column})) AS x FROM {source} WHERE {column} IS NOT NULL),
    split AS (SELECT {k}, unnest(regexp_extract_all(x, '..')) AS b, generate_subscripts(regexp_extract_all(x, '..'), 1) AS i FROM bytes WHERE x <> ''),
    codes AS (SELECT printf('%02X', v) AS b, CAST('0x' || substr(md5(unhex(printf('%02X', v))), 1, 16) AS UBIGINT)::HUGEINT AS t FROM range(0, 256) r(v)),
    h AS (SELECT {k}, i, (""" + " + ".join(f"(lag(t, {j}, 0::HUGEINT) OVER w % {1 << (64 - j)}::HUGEINT) * {1 << j}::HUGEINT" for j in range(64)) + f""") % {1 << 64}::HUGEINT AS h FROM split JOIN codes USING (b) WINDOW w AS (PARTITION BY {k} ORDER BY i)),
    cand AS (SELECT {k}, list(i ORDER BY i) AS c FROM h WHERE h < {1 << 58}::HUGEINT GROUP BY {k}),
    ends AS (SELECT {k}, x, list_append(list_reduce(list_prepend([0::BIGINT], list_transform(coalesce(c, []), lambda v: [v::BIGINT])), lambda a, b: CASE WHEN b[1] - a[-1] >= 64 THEN list_concat(a, b) ELSE a END), length(x) // 2) AS e FROM bytes LEFT JOIN cand USING ({k}))
    SELECT {k}, o AS ord, e[o + 1] AS start, e[o + 2] - e[o + 1] AS size, md5(unhex(substr(x, 2 * e[o + 1] + 1, 2 * (e[o + 2] - e[o + 1])))) AS hash FROM ends, range(0, len(e) - 1) r(o)"""  # fmt: skip


@query(_byte_chunks_sql("conversations", "text", "conv_id", "turn"))
def byte_gear_chunks(spark, sf_dir):
    """The byte chunker on a column."""
    return chunking.column_chunks(table(spark, sf_dir, "conversations"), "text", "conv_id", "turn", profile=_BYTES).drop("lz4_size")


@query(_byte_chunks_sql("pages", "html", "page_id"))
def file_gear_chunks(spark, sf_dir):
    """The byte chunker on files, a page's text in each, by blocks smaller than the files."""
    folder = _folder(spark)
    Path(folder).mkdir()

    def write(batches):
        for batch in batches:
            for key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (Path(folder) / f"{key}.html").write_bytes(data)
            yield batch.select([0])

    rows = table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", F.col("html").cast("binary"))
    keys = sorted(r["page_id"] for r in rows.mapInArrow(write, "page_id long").collect())  # the operator's argument is a list of files
    chunks = chunking.file_chunks(spark, [f"{folder}/{k}.html" for k in keys], _BYTES, block=1 << 10)
    return chunks.select(F.regexp_extract("path", r"(\d+)\.html$", 1).cast("long").alias("page_id"), "ord", "start", "size", "hash")


# ---- content-defined chunks of rows, and edits ----

_ORDER_COLUMNS = ("k", "cust", "cents", "status", "day")
_ROW_SQL = "concat_ws('|', k, cust, cents, status, day)"
_ORDERS = """orders_ AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS k, o_custkey AS cust, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
    n_ AS (SELECT count(*) AS n FROM orders_)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with _pos, and columns without doubles."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return with_positions(o, "k")


def fresh(spark: SparkSession):
    """Fresh rows for edits, by arithmetic, so that SQL can make them too."""
    return lambda n: spark.range(n).select(F.col("id").alias("_pos"), (F.col("id") + 9000000000).alias("k"), (F.col("id") * 7919 % 1000).alias("cust"), (F.col("id") * 104729 % 1000000).alias("cents"), F.lit("N").alias("status"), F.lit("2000-01-01").alias("day"))


def _fresh_sql(n: str) -> str:
    return f"SELECT j AS pos, 9000000000 + j AS k, j * 7919 % 1000 AS cust, j * 104729 % 1000000 AS cents, 'N' AS status, '2000-01-01' AS day FROM range(0, {n}) f(j)"


def row(*names: str):
    return row_cdc.row_text(*[F.col(c) for c in (names or _ORDER_COLUMNS)])


def _row_chunks_sql(source: str, name: str = "rc", text_sql: str = _ROW_SQL, by: str = "") -> str:
    part, group = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return f"""{name} AS (SELECT {group}chunk, min(pos) AS first_pos, count(*) AS n_rows, CAST(sum(strlen(t)) AS BIGINT) AS size, md5(string_agg(t, chr(10) ORDER BY pos)) AS hash
        FROM (SELECT *, CAST(coalesce(sum(c) OVER ({part}ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chunk
            FROM (SELECT {group}pos, {text_sql} AS t, CASE WHEN substr(md5({text_sql}), 1, 2) < '04' THEN 1 ELSE 0 END AS c FROM {source})) GROUP BY {group}chunk)"""


@query(f"WITH {_ORDERS}, {_row_chunks_sql('orders_')} SELECT chunk, first_pos, n_rows, size, hash FROM rc")
def row_cdc_orders(spark, sf_dir):
    return row_cdc.row_chunks(orders(spark, sf_dir), row())


_LINES = """lines_ AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS pos, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_quantity * 100) AS BIGINT)) AS t FROM lineitem)"""


@query(f"WITH {_LINES}, {_row_chunks_sql('lines_', text_sql='t')} SELECT count(*) AS n_chunks, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(size) AS BIGINT) AS total_len, min(hash) AS least_hash, max(hash) AS greatest_hash FROM rc")
def row_cdc_lineitem(spark, sf_dir):
    rows = with_positions(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    chunks = row_cdc.row_chunks(rows, row_cdc.row_text(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), cents("l_extendedprice"), cents("l_quantity")))
    return chunks.agg(F.count("*").alias("n_chunks"), F.sum("n_rows").alias("n_rows"), F.sum("size").alias("total_len"), F.min("hash").alias("least_hash"), F.max("hash").alias("greatest_hash"))


@query(f"WITH {_ORDERS}, {_row_chunks_sql('orders_')} SELECT CAST(floor(n_rows / 16.0) AS BIGINT) AS bin, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM rc GROUP BY 1")
def row_cdc_chunk_sizes(spark, sf_dir):
    return row_cdc_orders(spark, sf_dir).groupBy(F.floor(F.col("n_rows") / 16).alias("bin")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


_AT = "at_ AS (SELECT i, CAST(floor(p * n) AS BIGINT) AS place FROM (VALUES (0, 0.25::DOUBLE), (1, 0.75::DOUBLE)) v(i, p), n_)"
_POINTS = [0.25, 0.75]
_COLS = "k, cust, cents, status, day"
_EDITS = {
    "delete": f"edit AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, {_COLS} FROM orders_ WHERE NOT EXISTS (SELECT 1 FROM at_ WHERE pos BETWEEN place - 10 AND place - 1))",
    "insert": f"edit AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS pos, {_COLS} FROM (SELECT pos AS a, 1 AS b, 0 AS c, {_COLS} FROM orders_ UNION ALL SELECT place, 0, f.pos, {_COLS} FROM ({_fresh_sql('10')}) f, at_))",
    "append": f"edit AS (SELECT pos, {_COLS} FROM orders_ UNION ALL SELECT f.pos + n, {_COLS} FROM n_, LATERAL ({_fresh_sql('CAST(floor(0.05 * n) AS BIGINT)')}) f)",
    "update": f"edit AS (SELECT o.pos, coalesce(f.k, o.k) AS k, coalesce(f.cust, o.cust) AS cust, coalesce(f.cents, o.cents) AS cents, coalesce(f.status, o.status) AS status, coalesce(f.day, o.day) AS day FROM orders_ o LEFT JOIN at_ ON place = o.pos LEFT JOIN ({_fresh_sql('20')}) f ON f.pos = (i + 1) * 10 - 1)",
    "update_column": f"edit AS (SELECT o.pos, o.k, o.cust, coalesce(f.cents, o.cents) AS cents, o.status, o.day FROM orders_ o LEFT JOIN at_ ON place = o.pos LEFT JOIN ({_fresh_sql('20')}) f ON f.pos = (i + 1) * 10 - 1)",
}


def edited(spark: SparkSession, o: DataFrame, kind: str) -> DataFrame:
    """Orders after an edit."""
    new = fresh(spark)
    return {
        "delete": lambda: edits.delete_rows(o, _POINTS),
        "insert": lambda: edits.insert_rows(o, _POINTS, new),
        "append": lambda: edits.append_rows(o, 0.05, new),
        "update": lambda: edits.update_rows(o, _POINTS, new),
        "update_column": lambda: edits.update_rows(o, _POINTS, new, columns=["cents"]),
    }[kind]()


def _add_edit(kind: str) -> None:
    def run(spark, sf_dir):
        return edited(spark, orders(spark, sf_dir), kind).withColumnRenamed("_pos", "pos")

    run.__name__ = f"edit_{kind}"
    query(f"WITH {_ORDERS}, {_AT}, {_EDITS[kind]} SELECT pos, {_COLS} FROM edit")(run)


for _kind in _EDITS:
    _add_edit(_kind)


def _pair_sql(kind: str) -> str:
    return f"""{_ORDERS}, {_AT}, {_EDITS[kind]}, {_row_chunks_sql('orders_', 'a')}, {_row_chunks_sql('edit', 'b')}, pair AS (SELECT hash, size FROM a UNION ALL SELECT hash, size FROM b)"""


def _pair(spark, sf_dir, kind: str) -> DataFrame:
    o = orders(spark, sf_dir)
    return row_cdc.row_chunks(o, row()).unionByName(row_cdc.row_chunks(edited(spark, o, kind), row()))


@query(f"WITH {_pair_sql('insert')} {_stats_sql('pair')}")
def edit_dedup_row_cdc(spark, sf_dir):
    """The flagship: how much of a table and its edit is unique."""
    return dedup.stats(_pair(spark, sf_dir, "insert"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS variant, count(*) AS n FROM (WITH {_ORDERS}, {_AT}, {v} SELECT * FROM edit)" for k, v in _EDITS.items()))
def edit_variants_counts(spark, sf_dir):
    o = orders(spark, sf_dir)
    out = [edited(spark, o, k).agg(F.lit(k).alias("variant"), F.count("*").alias("n")) for k in _EDITS]
    while len(out) > 1:
        out.append(out.pop(0).unionByName(out.pop(0)))
    return out[0]


_SHARDS = f"{_ORDERS}, s AS (SELECT m, CAST(floor(pos * m / n) AS BIGINT) AS shard, pos, {_COLS} FROM orders_, n_, (VALUES (5), (10), (20)) v(m))"


@query(f"WITH {_SHARDS}, {_row_chunks_sql('s', by='m, shard')} {_stats_sql('rc')}")
def shard_split_dedup(spark, sf_dir):
    """The same table in 5, 10 and 20 shards."""
    o = orders(spark, sf_dir)
    n = o.count()
    parts = [edits.shard(o, m, n).withColumn("m", F.lit(m)) for m in (5, 10, 20)]
    return dedup.stats(row_cdc.row_chunks(parts[0].unionByName(parts[1]).unionByName(parts[2]), row(), by=("m", "shard")))


@query(f"WITH {_ORDERS} SELECT row_number() OVER (ORDER BY md5('40:' || pos)) - 1 AS pos, k FROM orders_")
def shuffle_positions(spark, sf_dir):
    return edits.shuffled(orders(spark, sf_dir)).select(F.col("_pos").alias("pos"), "k")


@query(f"WITH {_ORDERS} SELECT pos - 100 AS pos, {_COLS} FROM orders_ WHERE pos >= 100 AND pos < 350")
def slice_range(spark, sf_dir):
    return edits.slice_rows(orders(spark, sf_dir), 100, 250).withColumnRenamed("_pos", "pos")


@query(f"WITH {_ORDERS} SELECT pos, {_COLS} FROM orders_ ORDER BY pos LIMIT 5")
def head_rows(spark, sf_dir):
    """The first five rows: the limit is the operator."""
    return orders(spark, sf_dir).orderBy("_pos").limit(5).withColumnRenamed("_pos", "pos")


@query("SELECT doc_id, length(text) AS text_length FROM documents")
def add_column_len(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("text_length", F.char_length("text").cast("long")).select("doc_id", "text_length")


@query("SELECT doc_id, substr(text, 1, 10) AS text_short FROM documents")
def add_column_prefix10(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("text_short", F.substring("text", 1, 10)).select("doc_id", "text_short")


def _columns_sql(name: str, columns: str) -> str:
    return f"{_ORDERS}, {_row_chunks_sql('orders_', 'a')}, {_row_chunks_sql('orders_', 'b', columns)}, pair AS (SELECT hash, size FROM a UNION ALL SELECT hash, size FROM b)"


@query(f"WITH {_columns_sql('drop', 'concat_ws(chr(124), k, cust, cents, status)')} {_stats_sql('pair')}")
def drop_column_dedup(spark, sf_dir):
    """A table and itself without a column, rows as chunks' units."""
    o = orders(spark, sf_dir)
    names = [c for c in o.drop("day").columns if c != "_pos"]
    return dedup.stats(row_cdc.row_chunks(o, row()).unionByName(row_cdc.row_chunks(o.drop("day"), row(*names))))


@query(f"WITH {_columns_sql('cast', 'concat_ws(chr(124), k, cust, CAST(cents AS DECIMAL(18, 2)), status, day)')} {_stats_sql('pair')}")
def cast_column_dedup(spark, sf_dir):
    """A table and itself with one column of another type."""
    o = orders(spark, sf_dir)
    return dedup.stats(row_cdc.row_chunks(o, row()).unionByName(row_cdc.row_chunks(o.withColumn("cents", F.col("cents").cast("decimal(18,2)")), row())))


@query(f"""WITH {_ORDERS}, {_AT}, {_EDITS['insert']}, both_ AS (SELECT 0 AS version, * FROM orders_ UNION ALL SELECT 1, pos, {_COLS} FROM edit),
    one AS (SELECT version, c AS col, pos, t FROM (SELECT version, pos, k::VARCHAR AS k, cust::VARCHAR AS cust, cents::VARCHAR AS cents, status, day FROM both_) UNPIVOT (t FOR c IN (k, cust, cents, status, day))),
    {_row_chunks_sql('one', text_sql='t', by='version, col')} {_stats_sql('rc', 'col')}""")
def column_chunk_dedup(spark, sf_dir):
    """Each column of a table and its edit in chunks of its own, as a columnar file has them."""
    o = orders(spark, sf_dir)
    both = o.withColumn("version", F.lit(0)).unionByName(edited(spark, o, "insert").withColumn("version", F.lit(1)))
    long = both.select("version", "_pos", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("t")) for c in _ORDER_COLUMNS])).alias("x")).select("version", "_pos", "x.*")
    return dedup.stats(row_cdc.row_chunks(long, F.coalesce("t", F.lit("")), by=("version", "col")), "col")


@query("SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id HAVING count(*) < 10")
def nested_size_filter(spark, sf_dir):
    """Conversations of fewer than ten turns, as a nested column."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns)
    return edits.filter_nested(nested, "turns", 10).select("conv_id", F.size("turns").cast("long").alias("turns"))


# ---- reports ----

_RESULTS = """res AS (SELECT 'g' || (p_partkey % 7) AS grp, p_brand AS format, p_type AS params, round(p_retailprice / (p_retailprice + p_size * 40), 6) AS ratio, p_partkey AS id FROM part)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of experiments as reports get them, from the parts table: ids, groups, formats, parameters, ratios."""
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("g"), (F.col("p_partkey") % 7).cast("string")).alias("grp"), F.col("p_brand").alias("format"), F.col("p_type").alias("params"), F.round(price / (price + F.col("p_size") * 40), 6).alias("ratio"), F.col("p_partkey").alias("id"))


@query(f"WITH {_RESULTS} SELECT id, grp, ratio, round(ratio, 2) = min(round(ratio, 2)) OVER (PARTITION BY grp) AS best FROM res")
def best_ratio_per_group(spark, sf_dir):
    r = F.round("ratio", 2)
    return results(spark, sf_dir).select("id", "grp", "ratio", (r == F.min(r).over(Window.partitionBy("grp"))).alias("best"))



@query(f"WITH {_RESULTS} SELECT id, CASE " + " ".join(f"WHEN ratio <= 0.5::DOUBLE + 0.5::DOUBLE * {f}::DOUBLE THEN '{c}'" for f, c in zip(text.RATIO_STEPS, text.RATIO_COLORS, strict=False)) + f" ELSE '{text.RATIO_COLORS[-1]}' END AS color FROM res")
def ratio_color_bucket(spark, sf_dir):
    return results(spark, sf_dir).select("id", text.ratio_color(F.col("ratio"), F.lit(2)).alias("color"))


@query(f"""WITH {_RESULTS}, each AS (SELECT format AS label, params, min(ratio) AS ratio FROM res GROUP BY 1, 2)
    SELECT label, params, ratio, min(ratio) OVER (PARTITION BY label) AS best FROM each""")
def pivot_ratio_by_params(spark, sf_dir):
    """The report's table of a row for each format and a column for each parameter string, as rows of its cells, with the format's best."""
    from .report import pivot

    wide = pivot(results(spark, sf_dir).select(F.lit("all").alias("group"), "format", "params", F.col("ratio").alias("dedup_ratio")))
    cells = [F.col(f"`{c}`") for c in wide.columns if c != "label"]
    best = wide.select("*", F.array_min(F.array(*cells)).alias("best"))
    return best.unpivot(["label", "best"], cells, "params", "ratio").where("ratio IS NOT NULL")


@query(f"""WITH {_RESULTS} SELECT id, grp, coalesce(lag(grp) OVER (ORDER BY grp, ratio, id) <> grp, true) AS first_in_group FROM res""")
def group_section_breaks(spark, sf_dir):
    """The rows before which a report begins a section."""
    return results(spark, sf_dir).select("id", "grp", (F.row_number().over(Window.partitionBy("grp").orderBy("ratio", "id")) == 1).alias("first_in_group"))


@query("""SELECT o_orderkey, CASE WHEN n = 1 THEN '1 Byte' WHEN n < 1024 THEN format('{:d} Bytes', n) WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576.0::DOUBLE) WHEN n < 1099511627776 THEN printf('%.1f GiB', n / 1073741824.0::DOUBLE) ELSE printf('%.1f TiB', n / 1099511627776.0::DOUBLE) END AS size
    FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS n FROM orders)""")
def natural_size(spark, sf_dir):
    n = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.natural_size(n).alias("size"))


def _tag_sql(n: str) -> str:
    return f"CASE WHEN {n} < 1024 THEN format('{{:d}}Bytes', {n}) WHEN {n} < 1048576 THEN printf('%.0fKi', {n} / 1024.0::DOUBLE) ELSE printf('%.0fMi', {n} / 1048576.0::DOUBLE) END"


@query(f"""SELECT p_partkey, stem, regexp_replace(stem, '[^a-zA-Z0-9]+', '-', 'g') AS slug FROM (SELECT p_partkey, concat_ws(' ', CASE p_partkey % 3 WHEN 0 THEN 'snappy' WHEN 1 THEN 'zstd' END, CASE WHEN p_size % 2 = 0 THEN 'cdc' END, CASE WHEN p_partkey % 5 < 3 THEN 'rg=' || {_tag_sql('r')} END, CASE WHEN p_partkey % 4 = 0 THEN 'dp=' || {_tag_sql('r * 2')} END) AS stem
    FROM (SELECT *, CAST(1 AS BIGINT) << (p_size % 16 + 6) AS r FROM part))""")
def format_param_stem(spark, sf_dir):
    """Parameter strings of formats and their slugs."""
    key, size = F.col("p_partkey"), F.col("p_size")
    r = F.expr("shiftleft(1L, p_size % 16 + 6)")
    stem = text.param_stem(F.when(key % 3 == 0, "snappy").when(key % 3 == 1, "zstd"), size % 2 == 0, F.when(key % 5 < 3, r), F.when(key % 4 == 0, r * 2))
    return table(spark, sf_dir, "part").select("p_partkey", stem.alias("stem")).withColumn("slug", text.slug(F.col("stem")))


@query("""WITH e AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents) SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((n_chars - lo) / ((hi - lo) / 100)) + 1, 100) END AS INTEGER) AS bin, count(*) AS n FROM documents, e GROUP BY 1""")
def size_histogram(spark, sf_dir):
    return parquet_pages.histogram(table(spark, sf_dir, "documents"), "n_chars").select("bin", "n")


@query(f"""WITH {_OCC}, seg AS (SELECT min(file_idx) OVER (PARTITION BY hash) AS c, row_number() OVER (ORDER BY file_idx, ord) - 1 AS pos FROM occ), n_ AS (SELECT count(*) AS n FROM seg)
    SELECT CAST(floor(pos * 8192 / n) AS BIGINT) AS i, count(*) AS n, round(avg(c), 6) AS mean_first_seen FROM seg, n_ GROUP BY 1""")
def heatmap_samples(spark, sf_dir):
    """The sequence of first-seen files averaged into at most 8192 samples."""
    seg = with_positions(dedup.segments(occurrences(spark, sf_dir)), "file_idx", "ord")
    n = seg.agg(F.count("*").alias("all"))
    return seg.crossJoin(F.broadcast(n)).groupBy(F.floor(F.col("_pos") * 8192 / F.col("all")).alias("i")).agg(F.count("*").alias("n"), F.round(F.avg("first_seen_in"), 6).alias("mean_first_seen"))


@query(f"""WITH {_OCC}, c AS (SELECT hash, any_value(size) AS size, list(DISTINCT file_idx) AS seen, count(*) AS k FROM occ GROUP BY hash), l AS (SELECT list_sort(seen) AS seen, size, sum(k) AS k FROM c GROUP BY 1, 2), m AS (SELECT max(size) AS m FROM c), d AS (SELECT DISTINCT file_idx AS doc FROM occ)
    SELECT doc, CASE WHEN NOT list_contains(seen, doc) THEN 0.15::DOUBLE WHEN len(seen) = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS opacity, round(least(greatest(size / m::DOUBLE * 10, 1.0), 10.0), 4) AS height, CAST(sum(k) AS BIGINT) AS n
    FROM l, m, d GROUP BY 1, 2, 3""")
def multidoc_cells(spark, sf_dir):
    """Cells of the strips of all sources' blocks, counted by look."""
    from .report import looks

    return looks(occurrences(spark, sf_dir)).groupBy("doc", "opacity", F.round("height", 4).alias("height")).agg(F.sum("n").alias("n"))


# ---- generators and files, which SQL does not have ----


def _folder(spark: SparkSession) -> str:
    """A new folder's path in the shared one, which must be mounted where Python writes files."""
    shared = shared_folder(spark).removeprefix("file:")
    if not Path(shared).is_dir():
        raise RuntimeError(f"the shared folder is no mounted one: {shared}")
    return f"{shared}/chunkmill-{uuid.uuid4().hex}"


@query()
def synthetic_schema_types(spark, sf_dir):
    """A generated table of all types."""
    return synthetic.generate(spark, {"a": "int", "b": "float", "c": "str", "d": "largestr", "e": "bool", "f": ["int"], "g": {"x": "int", "y": "str"}}, 1000)


@query("SELECT 1000 AS n, 1000 AS positions, true AS ints, true AS floats, true AS texts, true AS long_texts, true AS lists, true AS structs")
def synthetic_ranges(spark, sf_dir):
    """What holds of a generated table whatever the draws are."""
    whole = lambda c: F.col(c).between(0, 999_999)
    sized = lambda c, low, high: F.char_length(c).between(low, high)
    each = {"ints": whole("a"), "floats": whole("b"), "texts": sized("c", 10, 99), "long_texts": sized("d", 100, 999), "lists": F.size("f").between(0, 4) & F.forall("f", lambda x: x.between(0, 999_999)), "structs": whole("g.x") & sized("g.y", 10, 99)}
    return synthetic_schema_types(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("_pos").alias("positions"), *[F.every(ok).alias(k) for k, ok in each.items()])


def _parts(sf_dir: str, name: str) -> list[str]:
    """All files of a table: the one, or those that Spark reads of a folder."""
    path = Path(sf_dir) / f"{name}.parquet"
    if not path.exists():
        raise FileNotFoundError(path)
    found = [path] if path.is_file() else [p for p in recursive(["*.parquet"], path) if p.is_file() and not any(x[0] in "_." for x in p.relative_to(path).parts)]
    return [str(p) for p in found]


@query()
def file_bytes_dedup(spark, sf_dir):
    """Chunks of the bytes of two tables' files, the second one's twice."""
    paths = [p for n in ("orders", "lineitem", "lineitem") for p in _parts(sf_dir, n)]
    return dedup.stats(chunking.file_chunks(spark, paths), compressed=True)


@query()
def parquet_page_sizes(spark, sf_dir):
    """The pages of a table's Parquet files by column and type."""
    pages = parquet_pages.parquet_pages(spark, _parts(sf_dir, "lineitem"))
    return pages.groupBy("column", "page_type").agg(F.count("*").alias("n"), F.sum("uncompressed_bytes").alias("bytes"), F.sum("num_values").alias("num_values"))


_LINE_COLUMNS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


@query(f"""SELECT unnest({_LINE_COLUMNS}) AS "column", (SELECT count(*) FROM lineitem) AS num_values""")
def parquet_page_values(spark, sf_dir):
    """The values of each column's data pages: one a row."""
    pages = parquet_pages.parquet_pages(spark, _parts(sf_dir, "lineitem")).where(F.col("page_type").startswith("data"))
    return pages.groupBy("column").agg(F.sum("num_values").alias("num_values"))


@query("SELECT * FROM orders")
def cdc_parquet_roundtrip(spark, sf_dir):
    """Rows written with content-defined page boundaries and read again."""
    from .formats import write_cdc_parquet

    path = f"{shared_folder(spark)}/chunkmill-{uuid.uuid4().hex}"
    write_cdc_parquet(table(spark, sf_dir, "orders"), path)
    return spark.read.parquet(path)


@query()
def format_comparison(spark, sf_dir):
    """Formats of a table and its edit compared by the bytes of their files."""
    from .experiment import compare_formats_tables
    from .formats import JsonLinesFormat, ParquetFormat

    o = orders(spark, sf_dir)
    formats = [ParquetFormat("snappy"), ParquetFormat("snappy", use_cdc=True), JsonLinesFormat()]
    return compare_formats_tables(spark, formats, {"insert": {"original": o, "insert": edited(spark, o, "insert")}}, _folder(spark), sanity_check=False)


_LINE_LENGTHS = "(SELECT sum(strlen(CAST(to_json(x) AS VARCHAR)) + 1) FROM (SELECT {{'k': k, 'cust': cust, 'cents': cents, 'status': status, 'day': day}} AS x FROM {}))"


@query(" UNION ALL ".join(f"""SELECT '{k}' AS "group", 'jsonl' AS format, '' AS params, 2 AS numfiles, CAST(n AS BIGINT) AS total_len FROM (WITH {_ORDERS}, {_AT}, {_EDITS[k]} SELECT {_LINE_LENGTHS.format('orders_')} + {_LINE_LENGTHS.format('edit')} AS n)""" for k in ("delete", "insert")))
def format_comparison_lines(spark, sf_dir):
    """The exact part of a comparison of formats: files and bytes of JSON lines, a table beside each of its edits."""
    from .experiment import compare_formats_tables
    from .formats import JsonLinesFormat

    o = orders(spark, sf_dir)
    groups = {k: {"original": o, k: edited(spark, o, k)} for k in ("delete", "insert")}
    return compare_formats_tables(spark, [JsonLinesFormat()], groups, _folder(spark), sanity_check=False).select("group", "format", "params", "numfiles", "total_len")
