"""A training-data pipeline over the table documents: quality rules, near duplicates, repeated passages, mixing, packing.

A stage's result is written before the next stage begins, so the tables that a stage keeps go when the next one begins.
All stages take null texts as empty, null ids, languages and sources as values of their own, repeated and equal rows as
rows each, columns of any further names, and an empty table, of which nothing is left.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkmill.llm import mixing, ngram_join, packing, quality, suffix_dedup
from chunkmill.llm.common import Scope, documents, keyed, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_LAST = threading.local()


def release() -> None:
    """Remove what this thread's last stage keeps, once its result is written or read."""
    if last := getattr(_LAST, "scope", None):
        last.close()


def stage(work: Stage) -> Stage:
    """A stage that owns the tables it keeps and removes those of the stage before it in this thread."""

    @wraps(work)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release()
        _LAST.scope = Scope()
        with _LAST.scope.active():
            return work(spark, docs, sf_dir)

    return begun


def _own(docs: DataFrame) -> DataFrame:
    """keyed() rows that carry the whole row of documents in _d."""
    return keyed(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_d")), "_d")


@stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail the base rule or leave their language's and source's bounds go."""
    return quality.filtered(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of alike documents the one with the least id stays."""
    rows = _own(docs)
    found = ngram_join.grouped(rows).where("key = component").select(F.col("key").alias("_k"))
    return rows.join(found, F.col("key") == F.col("_k"), "left_semi").select(*[F.col("_d")[c].alias(c) for c in docs.columns])


@stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: bytes of 100-byte strings that begin earlier are cut out, and n_chars follows.

    A code point of which a cut leaves only some bytes goes whole. A null text stays null; a document of which nothing is
    left stays, empty.
    """
    rows = _own(docs)
    schema = pa.schema([("key", pa.int64()), ("kept", pa.string())])
    kept = suffix_dedup.repeated(rows.select("key", "text"), suffix_dedup.rewritten, schema, "key long, kept string")
    changed = kept.where("kept is not null").select(F.col("key").alias("_k"), "kept")
    text = F.coalesce("kept", F.col("_d")["text"])
    new = {"text": text, "n_chars": F.when(F.col("kept").isNull(), F.col("_d")["n_chars"]).otherwise(F.length("kept").cast("long"))}
    return rows.select("key", "_d").join(changed, F.col("key") == F.col("_k"), "left").select(*[new.get(c, F.col("_d")[c]).alias(c) for c in docs.columns])


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as many times as the mix takes it."""
    return mixing.mix_documents(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", passages),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: SQL expresses neither the sketches nor the draws; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next. What lies between two stages goes once the next is written."""
    docs, before = documents(spark, sf_dir), Scope()
    for name, work in STAGES[:-1]:
        made, own = work(spark, docs, sf_dir), Scope()
        if work is STAGES[-2][1]:
            docs = stored(made, name.split()[0])  # the result is computed from it, so it is the caller's
        else:
            with own.active():
                docs = stored(made, name.split()[0])
        before.close()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
