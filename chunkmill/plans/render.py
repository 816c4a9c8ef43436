"""Heat maps of where a file's chunks were first seen."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dedup import segments
from ..session import cut

#: The image is DIM x DIM in bands of BLOCK equal rows, so it shows SAMPLES colours one after another.
DIM, BLOCK = 256, 8
SAMPLES = DIM // BLOCK * DIM


#: The colours of first-seen indexes, again from the first after the last.
PALETTE = [
    (0, 255, 0), (255, 0, 0), (0, 0, 255), (255, 255, 0), (255, 165, 0), (128, 0, 128), (0, 255, 255), (255, 0, 255),
    (192, 192, 192), (128, 128, 128), (128, 0, 0), (128, 128, 0), (0, 128, 0), (0, 128, 128), (0, 0, 128), (255, 105, 180),
    (255, 20, 147), (75, 0, 130), (240, 230, 140), (173, 216, 230), (255, 182, 193), (144, 238, 144), (255, 255, 224), (0, 255, 127),
    (70, 130, 180), (210, 105, 30), (255, 69, 0), (255, 228, 181), (255, 218, 185), (255, 240, 245), (255, 250, 205), (255, 228, 225),
]


def color_sequence(first_seen: np.ndarray) -> np.ndarray:
    """SAMPLES colours (uint8 RGB) of the sequence of first-seen indexes, stretched or averaged over it.

    Sample i covers i*n/SAMPLES up to (i+1)*n/SAMPLES of the sequence, in 32-bit floats: it is the mean of the colours at
    its beginning and each whole step from there, colours between two places being blended, and is cut to whole numbers.
    """
    colors = np.array(PALETTE, np.float32)
    s = np.asarray(first_seen, np.int64)
    n = len(s)
    if not n:
        return np.zeros((SAMPLES, 3), np.uint8)
    edge = (np.arange(SAMPLES + 1) * n).astype(np.float32) / np.float32(SAMPLES)
    start, stop = np.minimum(edge[:-1], np.float32(n - 1)), edge[1:]
    total = np.zeros((SAMPLES, 3), np.float32)
    weight = np.zeros(SAMPLES, np.float32)
    each = np.maximum(stop - start, np.float32(1))
    at = start.copy()
    while (live := at < stop).any():
        i = np.clip(at.astype(np.int64), 0, n - 1)
        part = (at - i.astype(np.float32))[:, None]
        sample = (1 - part) * colors[s[i] % len(colors)] + part * colors[s[np.minimum(i + 1, n - 1)] % len(colors)]
        total += np.where(live[:, None], sample * each[:, None], 0)
        weight += np.where(live, each, 0)
        at += np.float32(1)
    return np.clip(total / np.maximum(weight, np.float32(1e-9))[:, None], 0, 255).astype(np.uint8)


def png(colors: np.ndarray) -> bytes:
    """A PNG of DIM x DIM: pixel (i, j) has colour (i // BLOCK) * DIM + j."""
    rows = np.repeat(colors.reshape(DIM // BLOCK, DIM, 3), BLOCK, axis=0)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", DIM, DIM, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def samples(occurrences: DataFrame) -> DataFrame:
    """picture, i, r, g, b: color_sequence() of each file's first-seen indexes (picture: file_idx) and of all files' one after another (-1), averaged where the occurrences are; at most SAMPLES rows for each picture leave.

    ord must number a file's occurrences from 0. Sample i has weight 1 - p for the K places from the whole part of its
    beginning, and p for the K places from the next, where p is the fraction of its beginning and K its steps.
    """
    seg = cut(segments(occurrences))
    sizes = seg.groupBy("file_idx").agg(F.count("*").alias("n")).withColumn("_from", F.sum("n").over(Window.orderBy("file_idx")) - F.col("n"))  # one row a file
    own = sizes.select("file_idx", F.col("file_idx").alias("picture"), "n", F.lit(0).alias("_from"))
    every = sizes.crossJoin(sizes.agg(F.sum("n").alias("_all"))).select("file_idx", F.lit(-1).cast("long").alias("picture"), F.col("_all").alias("n"), "_from")
    at = seg.join(own.unionByName(every), "file_idx").withColumn("j", F.col("ord") + F.col("_from"))
    per = F.lit(float(SAMPLES)) / F.col("n")
    near = F.sequence(F.greatest(F.floor((F.col("j") - 1) * per) - 1, F.lit(0)), F.least(F.floor((F.col("j") + 1) * per) + 1, F.lit(SAMPLES - 1)))
    at = at.select("picture", "n", "j", F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in PALETTE]), (F.col("first_seen_in") % len(PALETTE) + 1).cast("int")).alias("c"), F.explode(near).alias("i"))
    edge = lambda i: (((i * F.col("n")).cast("float") / F.lit(SAMPLES)).cast("float")).cast("double")
    start = F.least(edge(F.col("i")), F.col("n") - 1.0)
    at = at.withColumn("f", F.floor(start)).withColumn("p", start - F.floor(start)).withColumn("k", F.ceil(edge(F.col("i") + 1) - start))
    last = F.col("j") == F.col("n") - 1  # the place after the last is the last
    upto = lambda a: F.greatest(F.least(F.col("k"), F.when(last, F.lit(1 << 62)).otherwise(F.col("j")) - F.col("f") - a + 1) - F.greatest(F.col("j") - F.col("f") - a, F.lit(0)), F.lit(0))
    weight = (1 - F.col("p")) * upto(0) + F.col("p") * upto(1)
    at = at.withColumn("w", weight).where("w > 0")
    return at.groupBy("picture", "i").agg(*[F.floor(F.sum(F.col("c")[x] * F.col("w")) / F.sum("w") + 1e-4).cast("int").alias(n) for x, n in enumerate("rgb")])


def draw_files(occurrences: DataFrame, paths: list[str]) -> list[Path]:
    """file.png beside each file and merged.png beside the last, by the true first file of each chunk."""
    pictures = np.zeros((len(paths) + 1, SAMPLES, 3), np.uint8)
    for r in samples(occurrences).toLocalIterator():
        pictures[r["picture"], r["i"]] = r["r"], r["g"], r["b"]
    out = [*[Path(f"{p}.png") for p in paths], Path(paths[-1]).parent / "merged.png"]
    for path, colors in zip(out, pictures, strict=True):
        path.write_bytes(png(colors))
    return out
