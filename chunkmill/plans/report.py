"""Reports on experiment results: text tables, bars, strips."""

from __future__ import annotations

import html
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .experiment import best_of


def report_rows(results: DataFrame) -> DataFrame:
    """Results by group and ratio, with best, first (of its group), color and sizes for people."""
    order = Window.partitionBy("group").orderBy("dedup_ratio", "format", "params")
    rows = best_of(results).withColumn("first", F.row_number().over(order) == 1)
    return rows.withColumn("color", text.ratio_color(F.round("dedup_ratio", 2), F.col("numfiles"))).withColumn("total", text.natural_size(F.col("total_len"))).withColumn("chunk", text.natural_size(F.col("chunk_bytes"))).withColumn("bounded", text.natural_size(F.col("bounded_bytes"))).orderBy("group", "dedup_ratio")


def bar(ratio: float | None, width: int = 20) -> str:
    """A ratio as percent and bar."""
    if ratio is None:
        return "   -"
    n = round(min(max(ratio, 0), 1) * width)
    return f"{ratio:4.0%} {'█' * n}{'░' * (width - n)}"


def table_text(results: DataFrame) -> str:
    """The results as a text table: a section for each group, its best rows marked with a star."""
    head = ("Group", "Format", "Params", "Total Size", "Chunk Size", "Deduped Ratio", "Bounded Size", "Bounded Deduped Ratio")
    rows = []
    for r in report_rows(results).toLocalIterator():
        if r["first"] and rows:
            rows.append(None)
        rows.append((r["group"] if r["first"] else "", ("*" if r["best"] else " ") + r["format"], r["params"], r["total"], r["chunk"], bar(r["dedup_ratio"]), r["bounded"], bar(r["bounded_dedup_ratio"])))
    width = [max(len(x[i]) for x in [head, *[r for r in rows if r]]) for i in range(len(head))]
    line = "-+-".join("-" * w for w in width)
    return "\n".join([" | ".join(h.ljust(w) for h, w in zip(head, width, strict=True)), line, *[line if r is None else " | ".join(c.ljust(w) for c, w in zip(r, width, strict=True)) for r in rows]])


def bars(results: DataFrame) -> DataFrame:
    """label (format, with its group where there are several), params, ratio, best (the label's least), the worst label first."""
    many = results.select("group").distinct().limit(2).count() > 1
    label = F.concat("format", F.lit(" ("), "group", F.lit(")")) if many else F.col("format")
    rows = results.select(label.alias("label"), "params", F.col("dedup_ratio").alias("ratio"))
    return rows.groupBy("label", "params").agg(F.min("ratio").alias("ratio")).withColumn("best", F.min("ratio").over(Window.partitionBy("label"))).orderBy(F.desc("best"), "label", "params")


def pivot(results: DataFrame, params: Sequence[str] | None = None) -> DataFrame:
    """A row for each label and a column for each params."""
    return bars(results).groupBy("label").pivot("params", list(params) if params else None).agg(F.min("ratio"))


def bars_html(results: DataFrame, path: str | Path | None = None) -> str:
    """The ratios as grouped horizontal bars in plain HTML."""
    out = ["<table style='font-family:sans-serif'>"]
    last = None
    for r in bars(results).toLocalIterator():
        name = html.escape(r["label"]) if r["label"] != last else ""
        last = r["label"]
        share = r["ratio"] or 0
        out.append(f"<tr><td>{name}</td><td>{html.escape(r['params'] or 'default')}</td><td><div style='background:#1f77b4;width:{400 * share:.0f}px'>&nbsp;</div></td><td>{share:.1%}</td></tr>")
    out.append("</table>")
    if path:
        Path(path).write_text("\n".join(out))
    return "\n".join(out)


def histogram_html(bins: DataFrame, path: str | Path) -> None:
    """A histogram (bin, low, high, n) as horizontal bars in plain HTML; the bins are few."""
    rows = bins.orderBy("bin").collect()
    most = max((r["n"] for r in rows), default=1)
    lines = [f"<tr><td>{r['low']:.0f} – {r['high']:.0f}</td><td><div style='background:#1f77b4;width:{400 * r['n'] / most:.0f}px'>&nbsp;</div></td><td>{r['n']}</td></tr>" for r in rows]
    Path(path).write_text("\n".join(["<table style='font-family:sans-serif'>", *lines, "</table>"]))


def cells(occurrences: DataFrame) -> DataFrame:
    """file_idx, ord, doc, color, opacity, height: one cell for each document strip and chunk occurrence.

    Documents are few; their indexes are the joined side.
    """
    from ..operators.dedup import listing, merge

    rows = listing(occurrences)
    largest = merge(occurrences).agg(F.max("size").alias("largest"))
    docs = occurrences.agg(F.max("file_idx").alias("last")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("doc"))
    each = rows.crossJoin(F.broadcast(largest)).crossJoin(F.broadcast(docs))
    inside = F.array_contains("seen_in", F.col("doc"))
    return each.select("file_idx", "ord", "hash", "doc", text.strip_color(F.col("doc")).alias("color"), text.cell_opacity(inside, F.size("seen_in")).alias("opacity"), text.cell_height(F.col("size"), F.col("largest")).alias("height"))


def looks(occurrences: DataFrame) -> DataFrame:
    """doc, opacity, height, n: how many of cells() look so, counted before chunks are multiplied by documents."""
    from ..operators.dedup import merge

    alike = merge(occurrences).groupBy("seen_in", "size").agg(F.sum("n").alias("n"))
    ends = occurrences.agg(F.max("size").alias("largest"), F.sequence(F.lit(0).cast("long"), F.max("file_idx")).alias("docs"))
    each = alike.crossJoin(F.broadcast(ends)).withColumn("doc", F.explode("docs"))
    inside = F.array_contains("seen_in", F.col("doc"))
    look = text.cell_opacity(inside, F.size("seen_in")).alias("opacity"), text.cell_height(F.col("size"), F.col("largest")).alias("height")
    return each.select("doc", *look, "n").groupBy("doc", "opacity", "height").agg(F.sum("n").alias("n"))


def strips_html(occurrences: DataFrame, path: str | Path | None = None) -> str:
    """Documents as vertical strips of their chunks."""
    out, last = ['<div style="display:flex;align-items:flex-end;gap:8px">'], None
    for r in cells(occurrences).orderBy("doc", "file_idx", "ord").toLocalIterator():
        if r["doc"] != last:
            out.append(("</div>" if last is not None else "") + '<div style="display:flex;flex-direction:column;margin:0 2px">')
            last = r["doc"]
        out.append(f'<div title="chunk {r["hash"]} in doc {r["doc"]}" style="background-color:{r["color"]};opacity:{r["opacity"]};height:{r["height"]}px;width:36px"></div>')
    out.append("</div></div>")
    if path:
        Path(path).write_text("\n".join(out))
    return "\n".join(out)
