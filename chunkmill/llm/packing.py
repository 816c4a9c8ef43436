"""Packing: documents into training sequences of several context sizes."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, in_blocks, small_batches, whole
from .tokenizing import cached, vocabulary

#: Context sizes. All are powers of two, so that a full window of any tier needs no padding.
TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens of a training step: sequences of one tier are dealt to steps of about so many.
STEP_TOKENS = 1 << 16
#: Tokens that are packed together; what does not fill a window goes on to the next such group.
GROUP_TOKENS = 1 << 21
#: Bytes of text that are tokenized together, many enough for words to repeat.
ENCODE_BYTES = 1 << 22

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs pieces (key, start, length) into windows.

    Pieces of a document's length over the largest tier are cut off as full windows. A rest is routed to the smallest
    tier that holds it. Tiers are packed from the largest: each window starts with the longest piece of its tier, its
    gap is filled with the largest pieces of this and shorter tiers that fit, and what is still open is closed with a cut
    from the longest remaining piece; the remainder is routed again. A window that nothing is left for stays open, and
    its pieces go to the next call.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self.pieces: dict[int, list] = defaultdict(list)
        self.lengths: list[int] = []

    def add(self, key, start: int, length: int) -> None:
        if length:
            if not self.pieces[length]:
                insort(self.lengths, length)
            self.pieces[length].append((key, start, length))

    def _take(self, most: int):
        if not (i := bisect_right(self.lengths, most)):
            return None
        n = self.lengths[i - 1]
        piece = self.pieces[n].pop()
        if not self.pieces[n]:
            del self.lengths[i - 1], self.pieces[n]
        return piece

    def windows(self) -> Iterator[tuple[int, list]]:
        """Full windows (tier, pieces) of what was added."""
        top = self.tiers[-1]
        while self.lengths and self.lengths[-1] >= top:
            key, start, length = self._take(self.lengths[-1])
            full = length // top * top
            for a in range(start, start + full, top):
                yield top, [(key, a, top)]
            self.add(key, start + full, length - full)
        for tier in reversed(self.tiers):
            below = max((t for t in self.tiers if t < tier), default=0)
            while self.lengths and self.lengths[-1] > below:
                window, gap = [], tier
                while gap and self.lengths:
                    if piece := self._take(gap):
                        window.append(piece)
                        gap -= piece[2]
                    else:
                        key, start, length = self._take(self.lengths[-1])
                        window.append((key, start, gap))
                        self.add(key, start + gap, length - gap)
                        gap = 0
                if gap:
                    for piece in window:
                        self.add(*piece)
                    return
                yield tier, window

    def rest(self) -> Iterator[tuple[int, list]]:
        """What is left, in windows whose sizes are the powers of two that add up to it, so that none is padded."""
        left = [p for n in reversed(self.lengths) for p in self.pieces[n]]
        self.pieces.clear()
        self.lengths.clear()
        total, i = sum(p[2] for p in left), 0
        while total:
            size = min(1 << (total.bit_length() - 1), self.tiers[-1])
            total -= size
            window, gap = [], size
            while gap:
                key, start, length = left[i]
                n = min(gap, length)
                window.append((key, start, n))
                gap -= n
                if n == length:
                    i += 1
                else:
                    left[i] = (key, start + n, length - n)
            yield size, window


def _steps(windows: list[tuple[int, list]], first: int, step_tokens: int) -> tuple[list[int], int]:
    """A step group for each window: windows of one size share groups of at most step_tokens, dealt so that the attention cost (the sum of squared lengths) of its groups is even."""
    out = [0] * len(windows)
    by_size = defaultdict(list)
    for i, (size, _) in enumerate(windows):
        by_size[size].append(i)
    for size, own in sorted(by_size.items()):
        groups = -(-len(own) * size // step_tokens)
        own.sort(key=lambda i: (-sum(p[2] ** 2 for p in windows[i][1]), i))
        for rank, i in enumerate(own):
            turn, place = divmod(rank, groups)
            out[i] = first + (place if turn % 2 == 0 else groups - 1 - place)
        first += groups
    return out, first


def pack_documents(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pack documents (doc_id, text) into sequences by hierarchical multi-length packing.

    Each partition is packed by itself, without a shuffle: documents are tokenized, an end id is added, and Packer fills
    windows. Only the end of a partition leaves less than full tiers, which become sequences of smaller powers of two.
    Rows: one for each piece; `with_ids` adds its ids. A null text counts as empty, and an empty text is its end id
    alone. A null doc_id stays null. Repeated rows are packed as often as they come; each is a document of its own.
    An empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = cached(tokenizer or vocabulary("word_bpe_49k.json")), Packer(tiers)
        base, made, step = TaskContext.get().partitionId() << 32, 0, TaskContext.get().partitionId() << 32
        docs_by_key: dict[int, tuple] = {}
        key = pending = 0

        def out(windows: list[tuple[int, list]]) -> pa.RecordBatch:
            nonlocal made, step, docs_by_key
            groups, step = _steps(windows, step, step_tokens)
            rows = []
            for (size, pieces), group in zip(windows, groups, strict=True):
                offset = 0
                for k, start, length in pieces:
                    doc_id, ids = docs_by_key[k]
                    part = ids[start : start + length]
                    rows.append((doc_id, start, length, zlib.crc32(part.astype("<u4").tobytes()), len(ids), base + made, offset, size, group) + ((part.astype(np.int32),) if with_ids else ()))
                    offset += length
                made += 1
            open_keys = {p[0] for own in packer.pieces.values() for p in own}
            docs_by_key = {k: v for k, v in docs_by_key.items() if k in open_keys}
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + ([pa.list_(pa.int32())] if with_ids else [])
            names = [x.split()[0] for x in schema.split(", ")]
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t.as_py() for t in batch.column(1)]
            for a, b in in_blocks(texts, ENCODE_BYTES):
                for doc_id, own in zip(ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    own = np.append(own, np.uint32(end_id))
                    docs_by_key[key] = doc_id, own
                    packer.add(key, 0, len(own))
                    key += 1
                    pending += len(own)
                if pending >= group_tokens:
                    pending = 0
                    yield out(list(packer.windows()))
        yield out(list(packer.windows()))
        yield out(list(packer.rest()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().cast("binary").alias("text")).mapInArrow(work, schema)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(documents(spark, sf_dir))
