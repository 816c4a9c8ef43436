"""Toxicity by cumulative-link ordinal regression."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, hashed_words, in_blocks, small_batches, whole

#: Most labelled documents that the model is fitted on; the labels whose ids have the least hashes.
SAMPLE_DOCS = 8_000
FEATURES = 1 << 18
#: Lengths in bytes of the word beginnings that are features beside whole words.
PREFIXES = (4, 6)
#: Weight of the sum of absolute weights, which keeps words without a bearing at nought.
L1 = 5e-5
#: Most steps of the fit, and the share of the loss that CHECKED steps must gain for it to go on.
STEPS, LEAST_GAIN, CHECKED = 400, 1e-4, 10
#: A word must come in so many documents of the sample.
LEAST_DOCS = 3

_MARKS = bytes.maketrans(b".,;:!?\"'()[]{}", b" " * 14)


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(cut_k - x.w): one weight for each feature, and K - 1 ascending cuts."""

    grades: list[int]
    cuts: np.ndarray
    weights: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """Probability of each grade, for each score x.w."""
        up_to = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - score[:, None], -500, 500)))
        return np.diff(np.hstack([np.zeros((len(score), 1)), up_to, np.ones((len(score), 1))]), axis=1)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed words and word beginnings of each text, one text after another, and how many each has."""
    plain = [t.translate(_MARKS) for t in texts]
    doc, found = np.arange(len(texts)), []
    for k in (0, *PREFIXES):
        h, n = hashed_words(plain, prefix=k)
        slot = ((h + np.uint64(k << 32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)
        found.append(np.repeat(doc, n) * FEATURES + slot)
    both = np.unique(np.concatenate(found))
    return (both % FEATURES).astype(np.int32), np.bincount(both // FEATURES, minlength=len(texts)).astype(np.int64)


def fit(slots: np.ndarray, counts: np.ndarray, grades: np.ndarray, l1: float = L1, steps: int = STEPS, least_docs: int = LEAST_DOCS) -> OrdinalModel:
    """Fit by accelerated proximal gradient on the mean log loss, until it hardly falls; with one grade only, that grade is certain."""
    levels = sorted(set(grades.tolist()))
    if len(levels) < 2:
        return OrdinalModel(levels or [0], np.empty(0), np.zeros(FEATURES, np.float32))
    y = np.searchsorted(levels, grades)
    used = np.flatnonzero(np.bincount(slots, minlength=FEATURES) >= least_docs)
    place = np.full(FEATURES, -1)
    place[used] = np.arange(len(used))
    doc, col = np.repeat(np.arange(len(counts)), counts), place[slots]
    doc, col = doc[col >= 0], col[col >= 0]
    n, k = len(y), len(levels) - 1
    share = np.clip(np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / n, 1e-6, 1 - 1e-6)
    cuts = np.log(share / (1 - share))
    w = np.zeros(len(used))
    # a word's step is the inverse of a bound on its curvature: its documents, times how many words these have
    per_doc = np.bincount(doc, minlength=n)
    curve = np.bincount(col, weights=np.sqrt(per_doc[doc]), minlength=len(used)) / n * np.sqrt(max(1.0, per_doc.mean())) / 4 + 1e-3
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    some, begin = np.unique(doc, return_index=True)
    o = np.argsort(col, kind="stable")
    by_word, word_begin = doc[o], np.searchsorted(col[o], np.arange(len(used)))
    ahead, old, t = w.copy(), w.copy(), 1.0
    score, losses = np.zeros(n), []
    for _ in range(steps if len(used) else 0):
        score[some] = np.add.reduceat(ahead[col], begin)
        edges = np.hstack([np.full(1, -np.inf), cuts, np.full(1, np.inf)])
        lo, hi = sigma(edges[y] - score), sigma(edges[y + 1] - score)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        by_score = (d_hi - d_lo) / n
        grad = np.add.reduceat(by_score[by_word], word_begin)
        losses.append(l1 * np.abs(ahead).sum() - np.log(p).mean())
        if len(losses) > CHECKED and losses[-1 - CHECKED] - losses[-1] < LEAST_GAIN * losses[-1]:
            break
        step = ahead - 0.5 * grad / curve
        new = np.sign(step) * np.maximum(np.abs(step) - 0.5 * l1 / curve, 0)
        d_cut = np.array([(-d_hi[y == j].sum() + d_lo[y == j + 1].sum()) / n for j in range(k)])
        cuts = np.sort(cuts - 2.0 * d_cut)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((ahead - new) * (new - old)).sum() > 0:
            t_new = 1.0
        ahead, old, t = new + (t - 1) / t_new * (new - old), new, t_new
    weights = np.zeros(FEATURES, np.float32)
    weights[used] = old
    return OrdinalModel(levels, cuts, weights)


def train(docs: DataFrame, labels: DataFrame, label: Column | str = "toxic", sample_docs: int = SAMPLE_DOCS, held_out: int = 0) -> OrdinalModel:
    """Fit on at most sample_docs labelled documents, whole texts; only their hashed words come to the driver.

    Rows without id or label are left out; of several labels of one id the highest counts, of several texts the least.
    held_out: leave out ids whose hash modulo 5 is below it, for tests.
    """
    label = F.col(label) if isinstance(label, str) else label
    small_batches(docs.sparkSession)
    chosen = labels.select("doc_id", label.cast("int").alias("_grade")).where("doc_id is not null and _grade is not null")
    if held_out:
        chosen = chosen.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(5)) >= held_out)
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("_grade").alias("_grade")).orderBy(F.xxhash64("_id", F.lit("fit")), "_id").limit(sample_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().cast("binary").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("doc_id", "_grade").agg(F.min("text").alias("text"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2)]
            for a, b in in_blocks(texts):
                s, n = features(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array([x.tobytes() for x in np.split(s, np.cumsum(n)[:-1])], pa.binary())], ["doc_id", "grade", "slots"])

    found = rows.mapInArrow(work, "doc_id long, grade int, slots binary").toArrow().sort_by([("doc_id", "ascending")])
    own = [np.frombuffer(x, np.int32) for x in found.column("slots").to_pylist()]
    return fit(np.concatenate(own) if own else np.empty(0, np.int32), np.array([len(x) for x in own], np.int64), np.array(found.column("grade").to_pylist(), np.int64))


def predict(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """Rows doc_id, expected_severity (mean grade), severity (likeliest grade), p_least (probability of the least grade), toxic (the grades above the least are likelier together).

    A null or empty text has no features and gets the grades' base rates; repeated rows are scored each, a null doc_id
    stays null, an empty table gives no rows, other columns are not read.
    """
    small_batches(docs.sparkSession)
    values = np.array(model.grades, float)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            for a, b in in_blocks(texts):
                s, n = features(texts[a:b])
                score = np.bincount(np.repeat(np.arange(b - a), n), weights=model.weights[s], minlength=b - a)
                p = model.probabilities(score)
                best = p.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(p @ values), pa.array(values[best].astype(np.int32)), pa.array(p[:, 0]), pa.array((values[0] > 0) | (p[:, 0] < 0.5))], ["doc_id", "expected_severity", "severity", "p_least", "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id long, expected_severity double, severity int, p_least double, toxic boolean")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Expected severity of all documents, by a model of `labels`."""
    docs = documents(spark, sf_dir)
    return predict(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
