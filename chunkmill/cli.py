"""Command line: python -m chunkmill.cli COMMAND ..."""

from __future__ import annotations

import argparse
import string
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators.edits import spread_points, variants
from .operators.synthetic import Generator, parse
from .plans import experiment, report
from .plans.formats import ChunkBounds, JsonLinesFormat, ParquetFormat, SqliteFormat, read, rewrite
from .sources.listing import checkout_revisions, parquet_files, recursive
from .sources.parquet_pages import data_page_sizes, histogram


def session() -> SparkSession:
    return SparkSession.builder.appName("chunkmill").getOrCreate()


def _bounds(a) -> ChunkBounds:
    return ChunkBounds(a.cdc_min_size << 10, a.cdc_max_size << 10, a.cdc_norm_level)


def _shown(results, a) -> None:
    print(report.table_text(results))
    if a.plot:
        report.bars_html(results, a.plot)


def synthetic(a) -> int:
    """Generate a table and its edits, write all in all formats, and compare."""
    spark, schema = session(), parse(a.schema)
    table, edits = variants(Generator(spark, schema), a.size << 20, spread_points(a.num_edits), update_columns=list(schema), edit_size=a.edit_size)
    table, edits = table.persist(), {k: v.persist() for k, v in edits.items()}
    d = a.use_dictionary
    formats = [ParquetFormat(c, use_cdc=cdc, use_dictionary=d) for cdc in (False, _bounds(a)) for c in ("snappy", "zstd")]
    formats += [ParquetFormat(c, use_cdc=cdc, flavor="rs") for cdc in (False, True) for c in ("snappy", "zstd")]
    formats += [JsonLinesFormat(), JsonLinesFormat("zstd")] * a.with_json + [SqliteFormat()] * a.with_sqlite
    prefix = f"s{a.size}c{len(schema)}e{a.num_edits}"
    groups = {f"{prefix}-{name}": {"original": table, name: edit} for name, edit in edits.items()}
    _shown(experiment.compare_formats_tables(spark, formats, groups, a.target_dir, sanity_check=not a.no_sanity_check), a)
    return 0


def revisions(a) -> int:
    """Check out all revisions of files."""
    for f in a.files:
        done = checkout_revisions(f, a.target_dir, a.from_rev, a.until_rev)
        print(f"{f} has {len(done)} revisions")
    return 0


def stats(a) -> int:
    """Compare formats over the Parquet files of a directory."""
    spark, p = session(), {"data_page_size": a.data_page_size, "row_group_size": a.row_group_size}
    formats = [SqliteFormat()] * a.with_sqlite + [JsonLinesFormat()] * a.with_json
    formats += [ParquetFormat("snappy", **p), ParquetFormat("snappy", use_cdc=_bounds(a), **p), ParquetFormat("snappy", flavor="rs"), ParquetFormat("snappy", use_cdc=True, flavor="rs")]
    group = {f.stem: f for f in parquet_files(a.directory)}
    _shown(experiment.compare_formats_tables(spark, formats, {"combined": group}, a.directory, sanity_check=not a.no_sanity_check), a)
    return 0


def dedup(a) -> int:
    """The two deduplication ratios of files."""
    spark = session()
    e = experiment.estimate(spark, a.files, images=a.images)
    one = spark.createDataFrame([(e.chunk_bytes, e.bounded_bytes, e.total_len)], "c long, x long, t long")
    r = one.select(*[text.natural_size(F.col(k), binary=False).alias(k) for k in "cxt"]).first()
    show = lambda x: "-" if x is None else f"{x:.2%}"
    print(f"Deduplication ratio: {show(e.dedup_ratio)} ({r['c']} / {r['t']})")
    print(f"Bounded deduplication ratio: {show(e.bounded_dedup_ratio)} ({r['x']} / {r['t']})")
    return 0


def rewrite_files(a) -> int:
    """Rewrite Parquet files with content-defined page boundaries beside themselves."""
    for f in a.files:
        print(rewrite(f))
    return 0


def render(a) -> int:
    """Fill $names of a template from name=value pairs; the result goes beside it, without its suffix."""
    path = Path(a.template)
    path.with_suffix("").write_text(string.Template(path.read_text()).safe_substitute(dict(v.split("=", 1) for v in a.values)))
    return 0


def page_chunks(a) -> int:
    """Histogram of data pages' sizes."""
    bins = histogram(data_page_sizes(session(), [str(p) for p in recursive(a.patterns)]), "uncompressed_bytes")
    bins.orderBy("bin").show(100, truncate=False)
    if a.plot:
        report.histogram_html(bins, a.plot)
    return 0


def param_impact(a) -> int:
    """Compare values of one writer parameter with its default."""
    if a.row_group_size:
        name, exponents = "row_group_size", range(11, 23)
    elif a.data_page_size:
        name, exponents = "data_page_size", range(12, 23)
    else:
        print("Please specify either --row-group-size or --data-page-size")
        return 1
    spark = session()
    contenders = {f"{name}={1 << e}": ParquetFormat(use_cdc=True, **{name: 1 << e}) for e in exponents}
    _shown(experiment.compare_formats(spark, ParquetFormat(use_cdc=True, **{name: 1 << 20}), contenders, read(spark, a.file), a.directory), a)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chunkmill", description=__doc__)
    top.add_argument("--plot", metavar="HTML", help="also write the ratios, or the histogram, as bars")
    sub = top.add_subparsers(required=True)

    def command(name: str, run, *args: tuple) -> None:
        p = sub.add_parser(name, help=run.__doc__)
        p.set_defaults(run=run)
        for names, options in args:
            p.add_argument(*names.split(), **options)

    flag = {"action": "store_true"}
    number = lambda default=None: {"type": int, "default": default}
    cdc = [("--cdc-min-size", number(256)), ("--cdc-max-size", number(1024)), ("--cdc-norm-level", number(0)), ("--with-json", flag), ("--with-sqlite", flag), ("--no-sanity-check", flag)]
    files = ("files", {"nargs": "*"})
    target = ("--target-dir -d", {"default": "synthetic"})
    command("synthetic", synthetic, ("schema", {"nargs": "?", "default": '{"a": "int", "b": "str", "c": ["int"]}'}), target, ("--size -s", number(1)), ("--num-edits -e", number(10)), ("--edit-size", number(10)), ("--use-dictionary", flag), *cdc)
    command("revisions", revisions, files, ("--target-dir -d", {"required": True}), ("--from-rev", {}), ("--until-rev", {"default": "HEAD"}))
    command("stats", stats, ("directory", {}), ("--data-page-size", number()), ("--row-group-size", number()), *cdc)
    command("dedup", dedup, files, ("--images", flag))
    command("rewrite", rewrite_files, files)
    command("render-readme", render, ("template", {}), ("values", {"nargs": "*"}))
    command("page-chunks", page_chunks, ("patterns", {"nargs": "*"}))
    command("param-impact", param_impact, ("file", {}), ("directory", {}), ("--row-group-size", flag), ("--data-page-size", flag))
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
