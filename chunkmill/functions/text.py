"""Column expressions for names, sizes and report cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shares of the way from the ideal ratio to 1, and the colour of each range.
RATIO_STEPS = (0.067, 0.25, 0.5, 0.75, 0.933)
RATIO_COLORS = ("bright_green", "green", "yellow", "orange3", "red", "bright_red")
#: Colours of up to twelve documents' strips.
STRIP_COLORS = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf", "#a55194", "#393b79")


def slug(text: Column) -> Column:
    """The text with runs of other than ASCII letters and digits as one dash."""
    return F.regexp_replace(text, "[^a-zA-Z0-9]+", "-")


def one_decimal(x: Column) -> Column:
    """A value from 1 to 2^52 with one decimal, as C's %.1f: its binary value rounded, ties to even. Java's would round the shortest decimal half up."""
    whole = F.floor(x)
    tenths = ((x - whole) * float(1 << 52)).cast("long") * 10
    digit, rest = F.shiftright(tenths, 52), tenths.bitwiseAND((1 << 52) - 1)
    up = (rest > 1 << 51) | ((rest == 1 << 51) & (digit % 2 == 1))
    out = whole * 10 + digit + up.cast("long")
    return F.concat_ws(".", F.floor(out / 10).cast("string"), (out % 10).cast("string"))


def natural_size(n: Column, binary: bool = True) -> Column:
    """A size with one decimal in powers of 1024 (KiB) or 1000 (kB); bytes as they are."""
    base = 1024 if binary else 1000
    units = ("KiB", "MiB", "GiB", "TiB") if binary else ("kB", "MB", "GB", "TB")
    scale = F.lit(float(base ** len(units)))
    for k in range(len(units) - 1, 0, -1):
        scale = F.when(n < base ** (k + 1), F.lit(float(base**k))).otherwise(scale)
    unit = F.lit(units[-1])
    for k in range(len(units) - 1, 0, -1):
        unit = F.when(n < base ** (k + 1), F.lit(units[k - 1])).otherwise(unit)
    large = F.concat_ws(" ", one_decimal(n / scale), unit)
    return F.when(n.isNull(), None).when(n == 1, F.lit("1 Byte")).when(n < base, F.format_string("%d Bytes", n.cast("long"))).otherwise(large)


def size_tag(n: Column) -> Column:
    """A size parameter as it stands in names: 2Ki, 1Mi, 512Bytes."""
    return (
        F.when(n.isNull(), None)
        .when(n < 1024, F.format_string("%dBytes", n.cast("long")))
        .when(n < 1 << 20, F.format_string("%.0fKi", n / F.lit(1024.0)))
        .when(n < 1 << 30, F.format_string("%.0fMi", n / F.lit(1048576.0)))
        .otherwise(F.format_string("%.0fGi", n / F.lit(1073741824.0)))
    )


def param_stem(compression: Column, cdc: Column, row_group: Column, page: Column) -> Column:
    """A format's parameters in one string: compression, cdc, rg=..., dp=..., those that are set."""
    return F.concat_ws(" ", compression, F.when(cdc, "cdc"), F.concat(F.lit("rg="), size_tag(row_group)), F.concat(F.lit("dp="), size_tag(page)))


def ratio_color(ratio: Column, numfiles: Column) -> Column:
    """The colour of a ratio between the ideal 1/numfiles and 1."""
    ideal = F.lit(1.0) / numfiles
    out = F.lit(RATIO_COLORS[-1])
    for step, color in reversed(list(zip(RATIO_STEPS, RATIO_COLORS, strict=False))):
        out = F.when(ratio <= ideal + (1 - ideal) * F.lit(step), color).otherwise(out)
    return out


def percent(x: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def cell_opacity(inside: Column, n_files: Column) -> Column:
    """How clear a chunk's cell is: in this document alone, in others too, not in this one."""
    return F.when(~inside, 0.15).when(n_files == 1, 1.0).otherwise(0.5)


def cell_height(size: Column, largest: Column) -> Column:
    """A cell's height in pixels, 1 to 10."""
    return F.least(F.greatest(size / largest * 10, F.lit(1.0)), F.lit(10.0))


def strip_color(doc: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in STRIP_COLORS]), (doc % len(STRIP_COLORS) + 1).cast("int"))
