"""Document fingerprints by MinHash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, cut, documents, in_blocks, keyed, pack, shingled, small_batches, unpack, whole
from .ngram_join import links_sql

#: Permutations, and how many of them a band holds: 32 bands of 4 find a pair of likeness 0.8 with probability 1 - 5e-8.
PERMUTATIONS, BAND = 128, 4
WIDTH, LIKENESS = 5, 0.8
#: Documents of a band's bucket that are paired in one slice.
SLICE = 256
#: A null id sorts first.
LOWEST = -(1 << 63)

_RNG = np.random.default_rng(20240518)
_A = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)


def signatures(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """MinHash signatures of the texts' sets of word shingles (a row of PERMUTATIONS 32-bit values each), and how many shingles each has. A text without words has the highest value everywhere.

    A permutation is x -> a*x + b modulo 2^32 with odd a, over 32 bits of a shingle's hash.
    """
    out = np.full((len(texts), PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    counts = np.zeros(len(texts), np.int64)
    for a, b in in_blocks(texts):
        h, n = shingled(texts[a:b], width)
        counts[a:b] = n
        some = np.flatnonzero(n)
        if not len(some):
            continue
        x = (h >> np.uint64(32)).astype(np.uint32)
        start = (np.cumsum(n) - n)[some]
        for k in range(PERMUTATIONS):
            out[a + some, k] = np.minimum.reduceat(x * _A[k] + _B[k], start)
    return out, counts


def fingerprints(sig: np.ndarray) -> np.ndarray:
    """The lower 16 bits of each minimum. Other minima have equal ones once in 65,536 times; the upper bits of a long text's minima are nearly all 0."""
    return sig.astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of fingerprints: the share of equal values. Two texts without words are alike."""
    return (a == b).mean(axis=1)


def printed(prints: np.ndarray) -> list[str]:
    """Fingerprints as hex, four digits for each permutation."""
    return [x.tobytes().hex() for x in prints.astype(">u2")]


def with_next(docs: DataFrame, n: int) -> DataFrame:
    """Blobs of documents dealt by ranges of doc_id: bucket, blob (doc_id, text, extra).

    Each bucket begins at an id that exists. A document at the beginning of a bucket also goes, marked extra, to the
    bucket before (the first of all to the last bucket), so each bucket knows what follows its last document.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    cuts = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / n for i in range(n)], 10 * n)).first()[0]
    bounds = np.array(sorted({*(cuts or [LOWEST])}), np.int64)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            own = np.searchsorted(bounds, ids, "right") - 1
            first = np.flatnonzero(bounds[own] == ids)
            rows = np.concatenate([np.arange(len(ids)), first])
            to = np.concatenate([own, (own[first] - 1) % len(bounds)])
            order = np.argsort(to, kind="stable")
            table = pa.table({"doc_id": batch.column(0), "text": batch.column(1)}).take(pa.array(rows[order]))
            table = table.append_column("extra", pa.array(order >= len(ids)))
            edges = np.concatenate([[0], np.flatnonzero(np.diff(to[order])) + 1, [len(to)]])
            got = [(int(to[order[a]]), pack(table.slice(a, b - a).combine_chunks())) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary())], ["bucket", "blob"])

    return docs.select(key.alias("doc_id"), whole().cast("binary").alias("text")).mapInArrow(deal, "bucket int, blob binary")


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many of the following text's first."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(key, table):
    parts = [unpack(b) for b in table.column("blob").to_pylist()]
    rows = sorted(r for p in parts for r in zip(p.column("doc_id").to_pylist(), p.column("extra").to_pylist(), p.column("text").to_pylist(), strict=True))
    own = [(i, t) for i, extra, t in rows if not extra]
    after = [t for i, extra, t in rows if extra and i > own[-1][0]] or [t for i, extra, t in rows if extra]
    texts = [t for _, t in own] + after[:1]
    decoded = [t.decode() for t in texts]
    new = [edited(a, b).encode() for a, b in zip(decoded[:-1], decoded[1:], strict=True)]
    own_prints, new_prints = (fingerprints(signatures(t)[0]) for t in (texts, new))
    return pa.table({
        "doc_id": pa.array([None if i == LOWEST else i for i, _ in own], pa.int64()),
        "n_chars": pa.array([len(t) for t in decoded[:-1]], pa.int64()),
        "edited_sha256": [hashlib.sha256(t).hexdigest() for t in new],
        "fingerprint": printed(own_prints[:-1]),
        "edited_fingerprint": printed(new_prints),
        "near_edited": likeness(own_prints[:-1], new_prints),
        "near_next": likeness(own_prints[:-1], own_prints[1:]),
    })


def fingerprint_edits(docs: DataFrame, spread: int = 4) -> DataFrame:
    """Fingerprint each document and its edited text, and compare it with both that and the next document.

    Documents are dealt once, as compressed blobs, to ranges of doc_id; each range also gets the document after its last.
    A null text counts as empty; a null id comes first in order; documents of one id are ordered by text. A single
    document is its own next one. An empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    n = spread * buckets(docs.sparkSession)
    return with_next(docs, n).groupBy("bucket").applyInArrow(_compared, OUT)


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(documents(spark, sf_dir))


def near_duplicates(docs: DataFrame, threshold: float = LIKENESS, width: int = WIDTH) -> DataFrame:
    """Verified pairs (a, b, jaccard) of documents' ids, found by MinHash bands: all pairs of different shingle sets, and each copy with the first of its set.

    Of equal sets the first by id (null first), then text, stands for all; every other one is paired with it at 1, so
    memberships are whole though copies do not multiply. Within a band's bucket all pairs of different sets whose sizes
    allow the threshold are verified on whole sets; a large bucket is dealt as pairs of its slices. A text without words is
    in no pair.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2)]
            for a, b in in_blocks(texts):
                sig, n = signatures(texts[a:b], width)
                h, _ = shingled(texts[a:b], width)
                sets = [np.unique(x).view(np.int64) for x in np.split(h, np.cumsum(n)[:-1])]
                bands = np.ascontiguousarray(sig).reshape(b - a, -1, BAND).astype(np.uint64)
                key = bands[:, :, 0]
                for k in range(1, BAND):
                    key = key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k]
                key = key * np.uint64(64) + np.arange(key.shape[1], dtype=np.uint64)
                keep = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b].take(pa.array(keep)) for c in (0, 1)), pa.array([sets[i] for i in keep], pa.list_(pa.int64())), pa.array([key[i].view(np.int64) for i in keep], pa.list_(pa.int64()))], ["key", "id", "shingles", "bands"])

    every = keyed(docs).select("key", "doc_id", "text").mapInArrow(work, "key long, id long, shingles array<long>, bands array<long>")
    every = cut(every.withColumn("digest", F.sha2(F.array_join("shingles", ","), 256)))
    rows = cut(every.groupBy("digest").agg(F.min_by(F.struct("key", "id", "shingles", "bands"), "key").alias("r")).select("digest", "r.*"))
    posted = rows.select("key", F.size("shingles").alias("n"), F.explode("bands").alias("band"))
    slices = posted.groupBy("band").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"), F.count("*").alias("many")).where("many > 1")
    posted = posted.join(slices, "band").withColumn("own", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int"))
    left = posted.select("band", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("slices") - 1)).alias("j"), F.col("key").alias("a"), F.col("n").alias("na"))
    right = posted.select("band", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("key").alias("b"), F.col("n").alias("nb"))
    fits = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-6
    pairs = left.join(right, ["band", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one, two = (rows.select(F.col("key").alias(k), F.col("id").alias(f"id_{k}"), F.col("shingles").alias(f"s{k}")) for k in "ab")
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    found = both.withColumn("jaccard", F.col("common") / (F.size("sa") + F.size("sb") - F.col("common"))).where(F.col("jaccard") >= threshold)
    first = rows.select("digest", F.col("key").alias("_k"), F.col("id").alias("a"))
    copies = every.select("digest", "key", F.col("id").alias("b")).join(first, "digest").where("key <> _k")
    return found.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "jaccard").unionByName(copies.select("a", "b", F.lit(1.0).alias("jaccard")))


def minhash_pairs(spark, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents, found by bands and verified."""
    return near_duplicates(documents(spark, sf_dir)).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def pairs_oracle() -> str:
    """All such pairs in DuckDB SQL; the bands miss one of likeness 0.8 once in 20 million times."""
    return f"WITH {links_sql()} SELECT x AS a, y AS b, round(jaccard, 6) AS jaccard FROM l UNION ALL SELECT rep, doc_id, 1.0 FROM d JOIN r USING (d) WHERE rep <> doc_id"
