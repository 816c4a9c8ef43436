"""Deterministic synthetic tables from a JSON-like schema; every value is a function of seed, column and row alone."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What strings are made of, and the ranges of numbers, lengths and list sizes (upper bounds excluded).
ALPHABET = "abcdefghijklmnopqrstuvwxyz "
NUMBERS = 1_000_000
LENGTHS = {"str": (10, 100), "largestr": (100, 1000)}
LIST_SIZES = (0, 5)

_SCALARS = {"int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "largestr": T.StringType(), "bool": T.BooleanType()}
_TYPES = {int: "int", float: "float", str: "str", bool: "bool"}


def parse(schema):
    """A schema from JSON text, or as it is: names of types, {} for structs, [t] for lists."""
    return json.loads(schema) if isinstance(schema, str) and schema.lstrip()[:1] in "{[" else schema


def data_type(kind) -> T.DataType:
    """The Spark type of a schema entry."""
    kind = _TYPES.get(kind, kind) if not isinstance(kind, (dict, list)) else kind
    if isinstance(kind, dict):
        return T.StructType([T.StructField(k, data_type(v), False) for k, v in kind.items()])
    if isinstance(kind, list) and kind:
        return T.ArrayType(data_type(kind[0]), False)
    if isinstance(kind, str) and kind in _SCALARS:
        return _SCALARS[kind]
    raise ValueError(f"Unsupported data type: {kind}")


def _draw(seed: int, path: str, *keys: Column) -> Column:
    """63 uniform bits of seed, column and keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(path), *keys), 1)


def _value(kind, seed: int, path: str, keys: tuple[Column, ...]) -> Column:
    kind = _TYPES.get(kind, kind) if not isinstance(kind, (dict, list)) else kind
    data_type(kind)
    if isinstance(kind, dict):
        return F.struct(*[_value(v, seed, f"{path}.{k}", keys).alias(k) for k, v in kind.items()])
    if isinstance(kind, list):
        n = (_draw(seed, f"{path}#", *keys) % (LIST_SIZES[1] - LIST_SIZES[0]) + LIST_SIZES[0]).cast("int")
        none = F.array().cast(T.ArrayType(data_type(kind[0]), False))
        return F.when(n == 0, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _value(kind[0], seed, f"{path}[]", (*keys, i))))
    u = _draw(seed, path, *keys)
    if kind == "int":
        return u % NUMBERS
    if kind == "float":
        return F.round((u % (NUMBERS * 1000)) / 1000.0, 3)
    if kind == "bool":
        return u % 2 == 1
    low, high = LENGTHS[kind]
    n = (_draw(seed, f"{path}#", *keys) % (high - low) + low).cast("int")
    # eleven letters of 5 bits' worth each from one hash
    words = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 11).cast("int")), lambda w: _letters(_draw(seed, path, *keys, w)))
    return F.substring(F.array_join(words, ""), F.lit(1), n)


def _letters(u: Column) -> Column:
    base = len(ALPHABET)
    return F.concat(*[F.substring(F.lit(ALPHABET), (F.floor(u / F.lit(base**k)) % base + 1).cast("int"), F.lit(1)) for k in range(11)])


def generate(spark: SparkSession, schema, rows: int, seed: int = 42, first: int = 0, batch: int = 0) -> DataFrame:
    """Rows with _pos from 0 and the schema's columns; batch: another draw of the same seed. The same on any partitioning."""
    schema = parse(schema)
    if not isinstance(schema, dict):
        raise ValueError("a table's schema is an object")
    pos = F.col("id") + first
    ids = spark.range(rows)
    return ids.select(F.col("id").alias("_pos"), *[_value(v, seed, f"{batch}/{k}", (pos,)).alias(k) for k, v in schema.items()])


class Generator:
    """Successive draws of one seed: each call of table() is another batch, and two generators of one seed agree call by call."""

    def __init__(self, spark: SparkSession, schema, seed: int = 42):
        self.spark, self.schema, self.seed, self.calls = spark, parse(schema), seed, 0

    def table(self, rows: int) -> DataFrame:
        self.calls += 1
        return generate(self.spark, self.schema, rows, self.seed, batch=self.calls)
