"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets, cut, documents, whole

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 20240607
#: Residual groups that one step of the reduction tree combines.
FAN_IN = 32
#: Documents of one source that a task pairs at most, about.
GROUP_ROWS = 2_000

WORDS = r"[^\x20\x09-\x0D]+"


def n_words(column: str = "text"):
    """Words of a text (null: 0)."""
    return F.regexp_count(whole(column), F.lit(WORDS)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_COPIES, share: float = 1.0) -> DataFrame:
    """Target of each source (source, source_size): weights in turn over the sources by code point, null last; a target over cap times its source's size stops there and its excess goes to the others by weight, until none is above.

    One row of a name and a few numbers for each source; the sums over the sources are windows without a key, so one task
    sorts that many rows, spilling: 10^7 sources are about 1 GB. The level that ends the resharing is found at once: sources by cap per weight, and the first at which those before it,
    taken at their caps, leave a level below its own cap.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))).withColumn("weight", w)
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    at = ranked.withColumn("level", level)
    first = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)
    found = at.withColumn("first", first)
    return found.select("source", "source_size", F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("first.level") * F.col("weight"))).alias("target"))


def _draw(*key) -> float:
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=7).digest(), "big") / (1 << 56)


def _pair(p: float, s: int, q: float, t: int, u: float) -> tuple[float, float]:
    """Move mass between copy probabilities p and q of documents of sizes s and t, so that p*s + q*t stays, one of them becomes 0 or 1, and neither changes on average. u: uniform in [0, 1)."""
    up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    if up + down <= 0:
        return float(round(p)), float(round(q))
    if u * (up + down) < down:
        return (1.0 if up == (1 - p) * s else p + up / s), (0.0 if up == q * t else q - up / t)
    return (0.0 if down == p * s else p - down / s), (1.0 if down == (1 - q) * t else q + down / t)


def _round(rows: list[tuple], key: tuple) -> Iterator[tuple]:
    """Pivotal rounding of (row id, size, p), in this order; all but the last come out with 0 or 1."""
    rng = random.Random(repr(key))
    held = None
    for row, size, p in rows:
        if not 0 < p < 1 or size == 0:
            yield row, size, float(p >= 1)
        elif held is None:
            held = row, size, p
        else:
            a, b = _pair(held[2], held[1], p, size, rng.random())
            one, two = (held[0], held[1], a), (row, size, b)
            held = None
            for x in (one, two):
                if 0 < x[2] < 1:
                    held = x
                else:
                    yield x
    if held is not None:
        yield held


_OUT = "source string, part long, row string, size long, p double"


def _rounded(df: DataFrame, seed: int, last: bool = False) -> DataFrame:
    """Pivotal rounding inside each (source, part)."""

    def work(key, table):
        source, part = (k.as_py() for k in key)
        rows = sorted(zip(table.column("row").to_pylist(), table.column("size").to_pylist(), table.column("p").to_pylist(), strict=True))
        out = list(_round(rows, (seed, source, part)))
        if last:
            out = [(r, s, p if p in (0.0, 1.0) else float(_draw(seed, source, "last") < p)) for r, s, p in out]
        r, s, p = zip(*out, strict=True)
        return pa.table({"source": pa.array([source] * len(out), pa.string()), "part": pa.array([part] * len(out), pa.int64()), "row": pa.array(r, pa.string()), "size": pa.array(s, pa.int64()), "p": pa.array(p, pa.float64())})

    return df.select("source", "part", "row", "size", "p").groupBy("source", "part").applyInArrow(work, _OUT)


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_COPIES, share: float = 1.0, seed: int = SEED, group_rows: int = GROUP_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """How many copies of each document a mix takes: doc_id, row (a digest of the row, equal for repeated rows apart from its number), size, source, source_size, target, n_copies.

    A source's documents all have the expected number target/source_size; its whole part is certain, and the fraction is
    rounded by pivotal sampling: documents of one source are paired inside groups by hash, mass moves between a pair until
    one probability is integral, and each group's one residual goes up a tree that combines fan_in groups at a time, so
    that a source's sum misses its target by less than one document. Draws depend on the seed and the rows only, so
    reruns agree. A null text has size 0, a document of size 0 gets no extra copy, a null source is a source of its own
    (last in order), repeated rows count each, an empty table gives no rows. Only counts and ids are shuffled.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words().alias("size"), F.xxhash64(whole()).alias("digest"))
    sized = sized.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("times"))
    sized = cut(sized)
    per_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).cast("long").alias("source_size"))
    goals = cut(targets(per_source, weights, cap, share))
    n = sized.count()
    parts = max(1, -(-n // group_rows))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    row = F.concat_ws(":", F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("null")), F.hex("digest"), F.hex("number"))
    rows = (
        sized.join(goals, sized["source"].eqNullSafe(goals["source"])).drop(goals["source"])
        .withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        .select("doc_id", "digest", "number", "source", "size", "source_size", "target", rate.alias("rate"), row.alias("row"))
        .withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
        .withColumn("p", F.col("rate") - F.floor("rate"))
    )
    rows = cut(rows)
    done = None
    level = _rounded(rows.repartition(buckets(spark), "source", "part"), seed)
    while True:
        level = cut(level)
        settled = level.where("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        if parts == 1:
            break
        parts = -(-parts // fan_in)
        left = level.where("p > 0 and p < 1").withColumn("part", F.floor(F.col("part") / fan_in))
        level = _rounded(left, seed + parts, last=parts == 1)
    if parts == 1:
        open_ = level.where("p > 0 and p < 1")
        done = done.unionByName(_rounded(open_, seed, last=True))
    extra = done.select("row", F.col("p").cast("long").alias("extra"))
    return rows.join(extra, "row").select("doc_id", "digest", "number", "size", "source", "source_size", "target", (F.floor("rate").cast("long") + F.col("extra")).alias("n_copies"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as copies() says, with its own columns.

    Rows that repeat are told apart by number, so a row of documents that comes n times is taken as often as its n
    numbers say together.
    """
    taken = copies(docs, **options).groupBy("doc_id", "digest", "source").agg(F.sum("n_copies").alias("n"), F.count("*").alias("rows"))
    own = [F.col("d").getField(c).alias(c) for c in docs.columns]
    left = docs.select(F.struct("*").alias("d"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(whole()).alias("_digest"), F.col("source").alias("_source"))
    t = taken.select(F.col("doc_id").alias("_tid"), F.col("digest").alias("_tdigest"), F.col("source").alias("_tsource"), "n", "rows")
    joined = left.join(t, left["_id"].eqNullSafe(t["_tid"]) & (left["_digest"] == t["_tdigest"]) & left["_source"].eqNullSafe(t["_tsource"]))
    numbered = joined.withColumn("_k", F.when(F.col("rows") == 1, 1).otherwise(F.row_number().over(Window.partitionBy("_id", "_digest", "_source").orderBy(F.lit(0)))))
    each = F.floor(F.col("n") / F.col("rows")) + (F.col("_k") <= F.col("n") % F.col("rows")).cast("long")
    return numbered.select("d", F.explode(F.array_repeat(F.lit(0), each.cast("int")))).select(*own)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes from each."""
    done = copies(documents(spark, sf_dir))
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def mixing_targets(spark, sf_dir: str) -> DataFrame:
    """The exact part of op2_mixing: sizes and their sources' targets."""
    return op2_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def targets_sql(weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_COPIES) -> str:
    """The rows of mixing_targets in DuckDB SQL: the excess is reshared until no source is above its cap."""
    return f"""
        WITH RECURSIVE own AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(list_extract({list(weights)}, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(weights)} + 1 AS INTEGER)) AS DOUBLE) AS weight FROM own GROUP BY source),
        step AS (
            SELECT 0 AS k, source, source_size, weight, false AS full_ FROM s
            UNION ALL
            SELECT k + 1, source, source_size, weight, full_ OR weight * level > {cap} * source_size FROM (
                SELECT *, (sum(source_size) OVER () - sum(CASE WHEN full_ THEN {cap} * source_size ELSE 0 END) OVER ()) / sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () AS level FROM step)
            WHERE k < (SELECT count(*) FROM s)),
        last AS (SELECT * FROM step WHERE k = (SELECT max(k) FROM step)),
        t AS (SELECT source, source_size, CASE WHEN full_ THEN {cap} * source_size::DOUBLE ELSE weight * (sum(source_size) OVER () - sum(CASE WHEN full_ THEN {cap} * source_size ELSE 0 END) OVER ()) / sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () END AS target FROM last)
        SELECT doc_id, size, source_size, round(target, 3) AS target FROM own JOIN t ON own.source IS NOT DISTINCT FROM t.source
    """
