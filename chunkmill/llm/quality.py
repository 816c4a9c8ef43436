"""Quality rules whose thresholds follow each language and source; native expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, whole

#: Least documents of a group whose own sketch is used; smaller groups use their language's, then that of all documents.
LEAST_GROUP = 200
#: A measure is out of range beyond the quartiles by so many times their distance, plus the measure's slack.
FENCE = 4.0
#: Measures and the slack that keeps a group without any spread from losing whatever differs at all.
SLACK = {"symbol_share": 0.05, "dup_line_share": 0.5, "word_length": 2.0}
#: Thresholds of at most so many groups are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 10_000

_WHITE = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for each row however often use names it."""
    return F.transform(F.array(value), use)[0]


def _repeated(hashes: Column) -> Column:
    """Words of a text in 5-word windows that come twice or more, from its words' hashes."""
    windows = F.when(F.size(hashes) >= 6, F.transform(F.sequence(F.lit(0), F.size(hashes) - 5), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(5)])))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda x, i: F.when(i == F.size(places) - 1, 5).otherwise(F.least(F.lit(5), F.get(places, i + 1) - x)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def shared(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def places(w: Column) -> Column:
        return let(F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda s: let(shared(s), covered))

    return let(windows, lambda w: F.when(w.isNull() | (F.size(F.array_distinct(w)) == F.size(w)), F.lit(0)).otherwise(places(w)))


def measures(text: Column, repeats: bool = True) -> Column:
    """A struct of what the rules look at; repeats: also n_repeat_words, which is the dear one."""
    words = F.array_remove(F.split(text, _WHITE, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda x: x.cast("long")
    word_chars = long(F.length(F.translate(text, " \t\n\x0b\x0c\r", "")))
    n_symbols = long(F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")))
    dup = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    own = let(words, lambda x: F.struct(F.size(x).cast("long").alias("n"), (long(let(F.transform(x, lambda w: F.xxhash64(w)), _repeated)) if repeats else F.lit(None).cast("long")).alias("rep")))
    return F.struct(own.alias("w"), word_chars.alias("word_chars"), n_symbols.alias("n_symbols"), dup.alias("l"))


def _measured(docs: DataFrame, repeats: bool) -> DataFrame:
    """The rows with a column _m of plain measures and the shares that the sketches hold."""
    m = docs.withColumn("_r", measures(whole(), repeats))
    r = F.col("_r")
    share = lambda a, b: F.when(b > 0, a / b)
    return m.withColumn("_m", F.struct(
        r["w"]["n"].alias("n_words"), r["word_chars"].alias("word_chars"), r["n_symbols"].alias("n_symbols"), r["l"]["dup"].alias("n_dup_lines"), r["w"]["rep"].alias("n_repeat_words"),
        share(r["n_symbols"], r["word_chars"]).alias("symbol_share"), share(r["l"]["dup"], r["l"]["n"]).alias("dup_line_share"), share(r["word_chars"], r["w"]["n"]).alias("word_length"),
    )).drop("_r")


def thresholds(docs: DataFrame) -> DataFrame:
    """Bounds of each (lang, source): lang, source, and low and high of each measure.

    One mergeable quantile sketch (KLL) for each measure and group; those of a language and of all documents are merged
    from the groups' sketches, so the table is read once. A group of fewer than LEAST_GROUP documents uses its language's.
    """
    rows = _measured(docs.select("lang", "source", "text"), repeats=False).select("lang", "source", *[F.col("_m")[k].alias(k) for k in SLACK])
    groups = cut(rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(k).alias(k) for k in SLACK]))
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(k).alias(k) for k in SLACK]]
    by_lang, of_all = groups.groupBy("lang").agg(*merged), groups.agg(*merged)

    def bounds(df: DataFrame) -> DataFrame:
        cols = []
        for k, slack in SLACK.items():
            none = F.coalesce(F.kll_sketch_get_n_double(k), F.lit(0)) == 0
            q1, q3 = (F.when(~none, F.kll_sketch_get_quantile_double(k, F.lit(q))) for q in (0.25, 0.75))
            reach = F.lit(FENCE) * (q3 - q1) + F.lit(slack)
            cols.append(F.struct((q1 - reach).alias("low"), (q3 + reach).alias("high")).alias(k))
        return df.withColumn("b", F.struct(*cols)).drop(*SLACK)

    g, l, a = bounds(groups), bounds(by_lang).select(F.col("lang").alias("l_lang"), F.col("n").alias("l_n"), F.col("b").alias("l_b")), bounds(of_all).select(F.col("b").alias("a_b"))
    joined = g.join(l, g["lang"].eqNullSafe(l["l_lang"])).crossJoin(F.broadcast(a))  # one row
    return joined.select("lang", "source", F.when(F.col("n") >= LEAST_GROUP, F.col("b")).when(F.col("l_n") >= LEAST_GROUP, F.col("l_b")).otherwise(F.col("a_b")).alias("_b"))


def judged(docs: DataFrame) -> DataFrame:
    """The documents with columns _m (measures), base_failed and kept.

    Two passes: the sketches of each language and source, then measures and verdict of each row. base_failed: fewer than
    10 words, or over a fifth of the words in repeated 5-word windows. Else a document is kept if each measure is within
    its group's bounds; a measure without a value (no word) rejects nothing by itself. Texts are never shuffled, unless
    there are more than BROADCAST_GROUPS groups. A null text counts as empty (and fails), null languages and sources are
    groups of their own, repeated rows are judged each and alike, an empty table gives no rows, other columns stay, but for
    those named as the three that are added.
    """
    limits = cut(thresholds(docs))
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "_b")
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    m = _measured(docs.select(F.struct("*").alias("_d"), "lang", "source", "text"), repeats=True)
    both = m.join(limits, m["lang"].eqNullSafe(F.col("_lang")) & m["source"].eqNullSafe(F.col("_source")), "left")
    own = [F.col("_d")[c].alias(c) for c in docs.columns if c not in ("_m", "base_failed", "kept")]
    mm, b = F.col("_m"), F.col("_b")
    failed = (mm["n_words"] < 10) | (100 * mm["n_repeat_words"] > 20 * mm["n_words"])
    out = F.lit(False)
    for k in SLACK:
        out = out | F.coalesce((mm[k] < b[k]["low"]) | (mm[k] > b[k]["high"]), F.lit(False))
    return both.select(*own, "_m", failed.alias("base_failed"), (~failed & ~out).alias("kept"))


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    own = [F.col("_d")[c].alias(c) for c in docs.columns]
    inner = docs.select(F.struct("*").alias("_d"), "lang", "source", "text")
    return judged(inner).where("kept").select(*own)


def _own_columns(done: DataFrame, *more: str) -> DataFrame:
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col("_m")[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], *more)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Measures and verdict of all documents."""
    return _own_columns(judged(documents(spark, sf_dir).select("doc_id", "text", "lang", "source")), "base_failed", "kept")


def quality_measures(spark, sf_dir: str) -> DataFrame:
    """The exact part of op9_quality: what the operator measures, and the base rule."""
    return _own_columns(judged(documents(spark, sf_dir).select("doc_id", "text", "lang", "source")), "base_failed")


MEASURES_SQL = r"""
    WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
    v AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win FROM w, range(1, greatest(len(w) - 3, 1)) r(i)),
    twice AS (SELECT doc_id, win FROM v GROUP BY doc_id, win HAVING count(*) > 1),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM v JOIN twice USING (doc_id, win)) GROUP BY doc_id),
    m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id))
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
"""
