"""What the operators of this subpackage share: reading the table, blob exchange, hashed words and shingles."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JNetworkError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once in a Python worker.
BLOCK_BYTES = 1 << 18

_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table `documents`."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to a few MB of text, so that a Python worker's memory stays bounded."""
    for k, v in _BATCH.items():
        spark.conf.set(k, v)


def buckets(spark: SparkSession) -> int:
    """Into how many buckets rows are dealt: the session's shuffle partitions, which the cluster sizes to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def whole(column: str = "text") -> Column:
    """A text, a null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; one is made only where none is set and all runs on one machine, as in tests."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        sc = spark.sparkContext._jsc.sc()
        if sc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chunkmill-"))
        found = sc.getCheckpointDir().get()
    elif spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scope:
    """The tables that one run keeps in the shared folder. Results are computed from them, so close() is for when these have been read or written."""

    def __init__(self) -> None:
        self._kept: list = []

    def own(self, spark: SparkSession, path: str) -> None:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._kept.append((jpath, spark.sparkContext._jsc.hadoopConfiguration()))

    def close(self) -> None:
        """Remove the tables."""
        while self._kept:
            path, conf = self._kept.pop()
            path.getFileSystem(conf).delete(path, True)

    @contextmanager
    def active(self) -> Iterator[Scope]:
        """What is kept inside the block belongs to this scope."""
        token = _ACTIVE.set(self)
        try:
            yield self
        finally:
            _ACTIVE.reset(token)


#: Owns what is kept outside any scope; removed when the process ends.
_PROCESS = Scope()
_ACTIVE: ContextVar[Scope] = ContextVar("scope", default=_PROCESS)


def _at_exit() -> None:
    try:
        _PROCESS.close()
    except (Py4JNetworkError, OSError):  # the JVM has gone first
        pass


atexit.register(_at_exit)


@contextmanager
def scope() -> Iterator[Scope]:
    """A scope for a run: `with scope(): op5_suffix_dedup(spark, sf_dir).write...` leaves nothing in the shared folder."""
    own = Scope()
    try:
        with own.active():
            yield own
    finally:
        own.close()


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that no later step computes them again."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    _ACTIVE.get().own(df.sparkSession, out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as compressed Parquet in the shared folder, until the active scope closes; smaller than a checkpoint where rows hold large blobs."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _ACTIVE.get().own(df.sparkSession, path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def pack(table: pa.Table | pa.RecordBatch) -> bytes:
    """A table as one compressed blob; one of plain numbers has a short head instead of Arrow's, since blobs can be small."""
    kinds = [f.type for f in table.schema]
    if all(pa.types.is_primitive(t) and not pa.types.is_boolean(t) for t in kinds) and not any(table.column(i).null_count for i in range(len(kinds))):
        parts = [np.ascontiguousarray(table.column(i).to_numpy()) for i in range(len(kinds))]
        head = ";".join([str(table.num_rows), *[f"{n},{x.dtype.str}" for n, x in zip(table.schema.names, parts, strict=True)]]).encode()
        body = b"".join(x.tobytes() for x in parts)
        return b"N" + len(head).to_bytes(2, "little") + head + len(body).to_bytes(8, "little") + (pa.compress(body, codec="zstd", asbytes=True) if body else b"")
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(table)
    return b"A" + sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    """What pack() packed."""
    if blob[:1] == b"A":
        return pa.ipc.open_stream(pa.py_buffer(blob)[1:]).read_all()
    n = int.from_bytes(blob[1:3], "little")
    rows, *cols = blob[3 : 3 + n].decode().split(";")
    size = int.from_bytes(blob[3 + n : 11 + n], "little")
    body = pa.decompress(blob[11 + n :], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    out, at = {}, 0
    for c in cols:
        name, kind = c.split(",")
        out[name] = np.frombuffer(body, np.dtype(kind), int(rows), at)
        at += out[name].nbytes
    return pa.table(out)


def columns(table: pa.Table) -> dict[str, np.ndarray]:
    """The columns of a table as arrays."""
    return {k: table.column(k).combine_chunks().to_numpy(zero_copy_only=False) if table.num_rows else table.column(k).to_numpy() for k in table.column_names}


def dealt(arrays: dict[str, np.ndarray], bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The rows of arrays as a blob for each bucket that has some."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    table = pa.table({k: v[order] for k, v in arrays.items()})
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]]), strict=True):
        if b > a:
            yield int(bucket[a]), pack(table.slice(a, b - a).combine_chunks())


def gathered(blobs: Iterable, schema: dict[str, np.dtype]) -> dict[str, np.ndarray]:
    """The rows of many blobs in one set of arrays."""
    parts = [columns(unpack(x)) for x in blobs]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, t) for k, t in schema.items()}


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.default_rng(20240901).integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_LANES = np.random.default_rng(7).integers(0, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a one-to-one map)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F | 1)
    x ^= x >> np.uint64(32)
    return x


def hashed_words(texts: list[bytes], lower: bool = True, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes other than ASCII white space) of all texts in order, and each text's number of words; prefix: of the words' first so many bytes."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    if lower:
        buf = _LOWER[buf]
    solid = ~_SPACE[buf]
    where = np.flatnonzero(solid)
    if not len(where):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.flatnonzero(np.diff(where, prepend=-2) > 1)
    size = np.diff(first, append=len(where))
    if prefix:
        where = where[np.arange(len(where)) - np.repeat(first, size) < prefix]
        size = np.minimum(size, prefix)
        first = np.cumsum(size) - size
    offset = np.arange(len(where)) - np.repeat(first, size)
    power = np.full(int(size.max()), _STEP, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    h = np.add.reduceat(_BYTES[buf[where]] * power[offset], first)
    counts = np.diff(np.searchsorted(where[first], ends), prepend=0)
    return mix(h + size.astype(np.uint64) * _LANES[15]), counts


def shingled(texts: list[bytes], width: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles of width words, in order and with repeats, and how many each text has; a text of fewer words has its whole sequence as one, one without words none."""
    words, n = hashed_words(texts, lower)
    many = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    start = np.cumsum(n) - n
    out = np.empty(int(many.sum()), np.uint64)
    at = np.cumsum(many) - many
    long = np.flatnonzero(n >= width)
    if len(long):
        pos = np.arange(int(many[long].sum())) + np.repeat(start[long] - (np.cumsum(many[long]) - many[long]), many[long])
        h = words[pos] * _LANES[0]
        for k in range(1, width):
            h += words[pos + k] * _LANES[k]
        out[np.arange(len(pos)) + np.repeat(at[long] - (np.cumsum(many[long]) - many[long]), many[long])] = mix(h)
    for i in np.flatnonzero((n > 0) & (n < width)):
        own = words[start[i] : start[i] + n[i]]
        out[at[i]] = mix(np.array([(own * _LANES[5 : 5 + len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))[0]
    return out, many


def in_blocks(texts: Iterable[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most limit bytes together, or of one text."""
    a, total = 0, 0
    i = -1
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield a, i
            a, total = i, 0
        total += len(t) + 1
    if i >= a:
        yield a, i + 1


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """Rows key, doc_id, text (binary; a null as empty) and the extra columns, with a unique key in the order of doc_id.

    The key is doc_id itself where ids are unique and never null. Otherwise rows are sorted by id (null first) and text
    once, and numbered in that order in the shared folder.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().cast("binary").alias("text"), *extra)
    ids = plain.select("doc_id").groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if not ids.take(1):
        return plain.select(F.col("doc_id").alias("key"), "doc_id", "text", *extra)
    order = plain.orderBy(F.col("doc_id").asc_nulls_first(), "text")
    return stored(order.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text", *extra), "keyed")


def blobs(rows: DataFrame, n: int, name: str = "bucket") -> DataFrame:
    """Rows with a column key dealt by it to n buckets, as compressed blobs: bucket, blob."""
    small_batches(rows.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = (mix(batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            table = pa.Table.from_batches([batch]).take(pa.array(order))
            edges = np.flatnonzero(np.diff(to[order], prepend=-1, append=-1))
            got = [(int(to[order[a]]), pack(table.slice(a, b - a).combine_chunks())) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield bucket_rows(got, name)

    return rows.mapInArrow(work, f"{name} int, blob binary")


def bucket_rows(got: list[tuple[int, bytes]], name: str = "bucket") -> pa.RecordBatch:
    """Blobs and their buckets as a batch."""
    return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary())], [name, "blob"])
