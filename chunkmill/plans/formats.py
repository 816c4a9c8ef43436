"""File formats of experiments: one file from one table or Parquet file, and how it is named."""

from __future__ import annotations

import json
import re
import sqlite3
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import closing, contextmanager
from dataclasses import asdict, dataclass
from itertools import chain, zip_longest
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import register, shared_folder

#: Rows of a row group where no number is given.
BLOCK_ROWS = 1 << 20
#: Bytes that are copied at once.
COPY_BYTES = 1 << 22
#: One file at a time is encoded on the driver, so that one row group is in its memory however many formats are compared.
_ENCODING = threading.Lock()
#: Compression names that the second Parquet writer takes, in any case.
CODECS = {"snappy": "snappy", "gzip": "gzip", "lz4": "lz4", "lz4_raw": "lz4", "zstd": "zstd", "uncompressed": None, "none": None}


@dataclass(frozen=True)
class ChunkBounds:
    """Content-defined page boundaries: least and most bytes, and normalisation level."""

    min_chunk_size: int
    max_chunk_size: int
    norm_level: int = 0


def codec(name: str | None) -> str | None:
    """A compression's name as the writer wants it; ValueError for others."""
    if name is None:
        return None
    if name.lower() not in CODECS:
        raise ValueError(f"unsupported compression: {name}")
    return CODECS[name.lower()]


def size_tag(n: int) -> str:
    """A size as it stands in names: 2Ki, 1Mi, 512Bytes."""
    for unit, base in (("Gi", 1 << 30), ("Mi", 1 << 20), ("Ki", 1 << 10)):
        if n >= base:
            return f"{n / base:.0f}{unit}"
    return f"{n}Bytes" if n != 1 else "1Byte"


def _ordered(df: DataFrame) -> DataFrame:
    """A positional table's rows in order, without their positions."""
    return df.orderBy("_pos").drop("_pos") if "_pos" in df.columns else df


def arrow_table(df: DataFrame) -> pa.Table:
    """A positional table's rows in order, all of them in the driver's memory: for small tables."""
    return _ordered(df).toArrow()


def _arrow_schema(df: DataFrame) -> pa.Schema:
    """The schema that the table has when it is collected by Arrow."""
    large = df.sparkSession.conf.get("spark.sql.execution.arrow.useLargeVarTypes") == "true"
    return to_arrow_schema(df.schema, error_on_duplicated_field_names_in_struct=True, prefers_large_types=large)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), str(Path(path.removeprefix("file:")).absolute())


@contextmanager
def parts(df: DataFrame, put: Callable[[Iterable[pa.RecordBatch], pa.NativeFile], None]) -> Iterator[tuple[fs.FileSystem, list[str]]]:
    """A table's rows in order as files in the shared folder, one of each partition that has rows, which its task writes by `put`; removed at the end."""
    df, folder = _ordered(df), f"{shared_folder(df.sparkSession)}/chunkmill-{uuid.uuid4().hex}"
    schema = _arrow_schema(df)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        task, (where, path) = TaskContext.get(), filesystem(folder)
        name = f"{path}/{task.partitionId():06d}-{task.taskAttemptId()}"
        with where.open_output_stream(name) as out:
            put((b.cast(schema) for b in chain([first], batches)), out)
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([name])], ["part", "name"])

    where, path = filesystem(folder)
    where.create_dir(path)
    try:
        yield where, [r["name"] for r in sorted(df.mapInArrow(work, "part long, name string").collect())]
    finally:
        where.delete_dir(path)


def _arrow_file(batches: Iterable[pa.RecordBatch], out: pa.NativeFile) -> None:
    batches = iter(batches)
    first = next(batches)
    with pa.ipc.new_stream(out, first.schema) as to:
        to.write_batch(first)
        for batch in batches:
            to.write_batch(batch)


@contextmanager
def record_batches(src: DataFrame | str | Path) -> Iterator[tuple[pa.Schema, Iterator[pa.RecordBatch]]]:
    """The schema and the rows in order of a table or a Parquet file, a batch at a time."""
    if not isinstance(src, DataFrame):
        with pq.ParquetFile(src) as f:
            yield f.schema_arrow, f.iter_batches(batch_size=1 << 14)
        return

    def read(where: fs.FileSystem, names: list[str]) -> Iterator[pa.RecordBatch]:
        for name in names:
            with where.open_input_stream(name) as f, pa.ipc.open_stream(f) as batches:
                yield from batches

    with parts(src, _arrow_file) as (where, names):
        yield _arrow_schema(_ordered(src)), read(where, names)


def tables_of(batches: Iterable[pa.RecordBatch], schema: pa.Schema, rows: int) -> Iterator[pa.Table]:
    """The rows as tables of so many rows, each in one piece, whatever batches they come in; one without rows where there are none."""
    held, n, some = [], 0, False
    for batch in batches:
        while n + batch.num_rows >= rows:
            yield pa.Table.from_batches([*held, batch.slice(0, rows - n)], schema).combine_chunks()
            batch, held, n, some = batch.slice(rows - n), [], 0, True
        held.append(batch)
        n += batch.num_rows
    if n or not some:
        yield pa.Table.from_batches(held, schema).combine_chunks()


def same_batches(a: Iterable[pa.RecordBatch], b: Iterable[pa.RecordBatch], schema: pa.Schema) -> bool:
    """Whether two tables have equal rows in order, whatever batches they come in."""
    return all(x is not None and y is not None and x.equals(y) for x, y in zip_longest(tables_of(a, schema, 1 << 14), tables_of(b, schema, 1 << 14)))


@dataclass(frozen=True)
class FileFormat:
    """A kind of file with its parameters; usable as a key."""

    compression: str | None = None

    name = "file"
    suffix = "bin"

    def params(self) -> list[str]:
        return [self.compression] if self.compression else []

    @property
    def paramstem(self) -> str:
        return " ".join(self.params())

    def derive_path(self, name: str, directory: str | Path) -> Path:
        """Where a table of this name goes: name, then the parameters as a slug."""
        tag = re.sub(r"[^a-zA-Z0-9]+", "-", self.paramstem)
        return Path(directory) / f"{name}{'-' if tag else ''}{tag}.{self.suffix}"

    def write(self, name: str, src: DataFrame | str | Path, directory: str | Path, sanity_check: bool = True) -> Path:
        """Write a table, or rewrite a Parquet file, as one file of this format; its path."""
        dest = self.derive_path(name, directory)
        dest.parent.mkdir(parents=True, exist_ok=True)
        self._put(src, dest)
        if sanity_check:
            self._check(src, dest)
        return dest

    def _put(self, src, dest: Path) -> None:
        raise NotImplementedError

    def _check(self, src, dest: Path) -> None:
        pass


@dataclass(frozen=True)
class ParquetFormat(FileFormat):
    """Parquet by the Arrow writer. flavor "rs" is the second writer of experiments: same rows and options, but it takes no chunk bounds and keeps its own name."""

    use_cdc: bool | ChunkBounds = False
    use_dictionary: bool = True
    data_page_size: int | None = None
    row_group_size: int | None = None
    flavor: str = "cpp"

    suffix = "parquet"

    @property
    def name(self) -> str:
        return f"parquet-{self.flavor}"

    def params(self) -> list[str]:
        out = super().params() + (["cdc"] if self.use_cdc else [])
        if isinstance(self.use_cdc, ChunkBounds) and self.use_cdc != ChunkBounds(256 << 10, 1 << 20, 0):
            out.append(f"b={size_tag(self.use_cdc.min_chunk_size)}..{size_tag(self.use_cdc.max_chunk_size)}/{self.use_cdc.norm_level}")
        out += [f"{k}={size_tag(v)}" for k, v in (("rg", self.row_group_size), ("dp", self.data_page_size)) if v is not None]
        return out + ([] if self.use_dictionary else ["nodict"])

    def options(self) -> dict:
        """Keyword options of the Arrow writer."""
        if self.flavor == "rs" and isinstance(self.use_cdc, ChunkBounds):
            raise ValueError("chunk bounds are not supported by this Parquet writer")
        out = {"compression": codec(self.compression) or "none", "use_dictionary": self.use_dictionary, "use_content_defined_chunking": asdict(self.use_cdc) if isinstance(self.use_cdc, ChunkBounds) else bool(self.use_cdc)}
        return out | ({"data_page_size": self.data_page_size} if self.data_page_size is not None else {})

    def _put(self, src, dest: Path) -> None:
        options = self.options()
        if isinstance(src, DataFrame):
            with record_batches(src) as (schema, batches), _ENCODING, pq.ParquetWriter(dest, schema, **options) as out:
                for table in tables_of(batches, schema, self.row_group_size or BLOCK_ROWS):
                    out.write_table(table, self.row_group_size)
            return
        with pq.ParquetFile(src) as f, pq.ParquetWriter(dest, f.schema_arrow, **options) as out:
            for batch in f.iter_batches(batch_size=BLOCK_ROWS):
                out.write_batch(batch, row_group_size=self.row_group_size)

    def _check(self, src, dest: Path) -> None:
        if isinstance(src, DataFrame):
            with record_batches(src) as (schema, want), pq.ParquetFile(dest) as f:
                same = schema.equals(f.schema_arrow) and same_batches(want, f.iter_batches(batch_size=1 << 14), schema)
        else:
            a, b = pq.read_metadata(src), pq.read_metadata(dest)
            same = a.num_rows == b.num_rows and a.schema.to_arrow_schema() == b.schema.to_arrow_schema()
        if not same:
            raise AssertionError(f"{dest} does not hold the rows of its source")


def _json_lines(batches: Iterable[pa.RecordBatch], out: pa.NativeFile) -> None:
    line = json.JSONEncoder(ensure_ascii=False, default=str, separators=(",", ":")).encode
    for batch in batches:
        for a in range(0, batch.num_rows, 1 << 12):
            out.write("".join(line(r) + "\n" for r in batch.slice(a, 1 << 12).to_pylist()).encode())


@dataclass(frozen=True)
class JsonLinesFormat(FileFormat):
    """One JSON object a line, nulls written."""

    name = "jsonl"
    suffix = "jsonlines"

    def _put(self, src, dest: Path) -> None:
        with pa.output_stream(str(dest), compression=self.compression) as out:
            if not isinstance(src, DataFrame):
                with record_batches(src) as (_, batches):
                    _json_lines(batches, out)
                return
            with parts(src, _json_lines) as (where, names):
                for name in names:
                    with where.open_input_stream(name) as f:
                        while data := f.read(COPY_BYTES):
                            out.write(data)


@dataclass(frozen=True)
class SqliteFormat(FileFormat):
    """A database with one table named `table`, replaced if it is there; compression is part of the name alone."""

    name = "sqlite"
    suffix = "sqlite"

    def _put(self, src, dest: Path) -> None:
        with record_batches(src) as (schema, batches), _ENCODING, closing(sqlite3.connect(dest)) as con, con:
            quoted = ", ".join('"' + c.replace('"', '""') + '"' for c in schema.names)
            con.execute('DROP TABLE IF EXISTS "table"')
            con.execute(f'CREATE TABLE "table" ({quoted})')
            marks = ", ".join("?" * len(schema.names))
            for batch in batches:
                con.executemany(f'INSERT INTO "table" VALUES ({marks})', [[v if isinstance(v, (int, float, str, bytes, type(None))) else json.dumps(v, default=str) for v in r.values()] for r in batch.to_pylist()])


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.options, self.overwrite, self.job = options.pop("path"), options, overwrite, uuid.uuid4().hex
        self.schema = to_arrow_schema(schema)
        where, path = filesystem(self.path)
        where.create_dir(path)
        with where.open_output_stream(self._mark(path)):  # stands while the job runs
            pass

    def _mark(self, path: str) -> str:
        return f"{path}/.{self.job}-running"

    def _running(self, where: fs.FileSystem, path: str) -> bool:
        return where.get_file_info(self._mark(path)).type == fs.FileType.File

    def _open(self, where: fs.FileSystem, file: str, schema: pa.Schema) -> pq.ParquetWriter:
        o = self.options
        cdc = {k: int(o[k]) for k in ("min_chunk_size", "max_chunk_size", "norm_level") if k in o} or True
        extra = {"data_page_size": int(o["data_page_size"])} if "data_page_size" in o else {}
        return pq.ParquetWriter(file, schema, filesystem=where, compression=codec(o.get("compression", "snappy")) or "none", use_content_defined_chunking=cdc, **extra)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        where, path = filesystem(self.path)
        group = int(self.options["row_group_size"]) if "row_group_size" in self.options else None
        out, task = None, TaskContext.get()
        temporary = f"{path}/.{self.job}-part-{task.partitionId():05d}-{task.taskAttemptId()}.parquet"
        for batch in iterator:
            if out is None:
                if not self._running(where, path):
                    break
                out = self._open(where, temporary, batch.schema)
            out.write_batch(batch, row_group_size=group)
        if out is not None:
            out.close()
            if not self._running(where, path) and where.get_file_info(temporary).type == fs.FileType.File:  # aborted meanwhile
                where.delete_file(temporary)
        message = WriterCommitMessage()
        message.file = temporary if out is not None else None
        return message

    def _files(self, where: fs.FileSystem, path: str) -> list[str]:
        return [f.path for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.File]

    def commit(self, messages: Iterable[WriterCommitMessage | None]) -> None:
        """Parts get names with the job's id; an overwrite removes the old ones last, so at no time are rows in neither."""
        where, path = filesystem(self.path)
        old = [f for f in self._files(where, path) if f.rsplit("/", 1)[-1].startswith("part-")] if self.overwrite else []
        made = [m.file for m in messages if m is not None and m.file]
        for file in made:
            number = file.rsplit("-part-", 1)[1].split("-")[0]
            where.move(file, f"{path}/part-{number}-{self.job}.parquet")
        if not made and not any(f.rsplit("/", 1)[-1].startswith("part-") for f in self._files(where, path) if f not in old):
            self._open(where, f"{path}/part-00000-{self.job}.parquet", self.schema).close()
        for file in old:
            where.delete_file(file)
        self._end(where, path)

    def _end(self, where: fs.FileSystem, path: str) -> None:
        """Remove what attempts of this job that did not count have left. The mark goes first: an attempt that is still at work closes its file before it looks for the mark, so one of the two removes the file."""
        where.delete_file(self._mark(path))
        for file in self._files(where, path):
            if file.rsplit("/", 1)[-1].startswith(f".{self.job}-"):
                try:
                    where.delete_file(file)
                except FileNotFoundError:  # by its attempt
                    pass

    def abort(self, messages: Iterable[WriterCommitMessage | None]) -> None:
        self._end(*filesystem(self.path))


class CdcParquet(DataSource):
    """format("cdc_parquet"): a distributed sink of Parquet parts with content-defined page boundaries, which Spark's own writer lacks. The path is a folder that all executors share, or a URI that pyarrow's file systems know. A part appears under its name when all tasks are done; an empty table leaves one part without rows."""

    @classmethod
    def name(cls) -> str:
        return "cdc_parquet"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), schema, overwrite)


def write_cdc_parquet(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    """Write with content-defined page boundaries: compression, row_group_size, data_page_size, and min_chunk_size, max_chunk_size, norm_level together."""
    register(df.sparkSession, CdcParquet)
    df.write.format("cdc_parquet").mode(mode).options(**{k: str(v) for k, v in options.items()}).save(path)


def rewrite(path: str | Path, compression: str | None = None) -> Path:
    """stem-dedup-cdc.parquet beside a Parquet file, with content-defined page boundaries."""
    path = Path(path)
    return ParquetFormat(compression, use_cdc=True).write(f"{path.stem}-dedup", path, path.parent)


def native_options(fmt: ParquetFormat) -> dict[str, str]:
    """The same parameters for Spark's own Parquet writer, where there are no content-defined boundaries."""
    out = {"compression": fmt.compression or "uncompressed", "parquet.enable.dictionary": str(fmt.use_dictionary).lower()}
    if fmt.data_page_size is not None:
        out["parquet.page.size"] = str(fmt.data_page_size)
    if fmt.row_group_size is not None:
        out["parquet.block.row.count.limit"] = str(fmt.row_group_size)
    return out


def write_native(df: DataFrame, path: str, fmt: ParquetFormat) -> None:
    """A distributed write of Parquet without content-defined boundaries, or of JSON lines."""
    if isinstance(fmt, JsonLinesFormat):
        df.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", fmt.compression or "none").json(path)
    else:
        df.write.mode("overwrite").options(**native_options(fmt)).parquet(path)


def read(spark: SparkSession, path: str | Path) -> DataFrame:
    """A Parquet file as a table."""
    return spark.read.parquet(str(path))
