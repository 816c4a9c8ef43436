"""Token counts by greedy longest match over a trie with failure links."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_blocks, documents, small_batches, whole
from .tokenizing import vocabulary

#: A word that no sequence of pieces makes up counts as one unknown token.
UNKNOWN_TOKENS = 1

_LOADED: dict[str, "Automaton"] = {}


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = {}, 0
    for b in range(256):
        out[chr(b if b in plain else 256 + more)] = b
        more += b not in plain
    return out


def pieces(path: str) -> tuple[set[bytes], set[bytes]]:
    """A byte-level vocabulary's pieces that begin a word (those with a leading blank, which is left out; of the blank alone nothing is left) and those that continue one."""
    table = printable_bytes()
    words = [bytes(table[c] for c in w) for w in json.load(open(path, encoding="utf-8"))["model"]["vocab"] if all(c in table for c in w)]
    return {w[1:] for w in words if w[:1] == b" "}, {w for w in words if w and w[:1] != b" "}


class Automaton:
    """Counts the pieces of a word's greedy longest match in one pass over its bytes, without building them.

    The trie holds the pieces that begin a word from its root and those that continue one from a second root. An empty
    first piece is the blank before the word as a token of its own, taken where no longer one begins the word. A node's
    failure link leads to the node for what is left of its string once the longest pieces are taken from its front, and
    `popped` is how many that takes; -1 where that ends in a dead end. So each byte either goes down the trie or pops a
    precomputed number of pieces, and the work is linear in the word.
    """

    ROOT, NEXT = 0, 1

    def __init__(self, begin: set[bytes], go_on: set[bytes]):
        self.go: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        for root, own in ((0, begin), (1, go_on)):
            for piece in sorted(own):
                at = root
                for b in piece:
                    if b not in self.go[at]:
                        self.go[at][b] = len(self.go)
                        self.go.append({})
                        final.append(False)
                    at = self.go[at][b]
                final[at] = True
        self.fail = [-1] * len(self.go)
        self.popped = [0] * len(self.go)
        if final[self.ROOT]:
            self.fail[self.ROOT], self.popped[self.ROOT] = self.NEXT, 1
        queue = deque([0, 1])
        while queue:
            at = queue.popleft()
            for b, child in self.go[at].items():
                queue.append(child)
                if final[child]:
                    self.fail[child], self.popped[child] = self.NEXT, 1
                    continue
                left, n = self.fail[at], self.popped[at]
                while left >= 0 and b not in self.go[left]:
                    n += self.popped[left]
                    left = self.fail[left]
                if left >= 0:
                    self.fail[child], self.popped[child] = self.go[left][b], n

    def count(self, word: bytes) -> int:
        """Pieces of a word; UNKNOWN_TOKENS where the longest matches come to a dead end."""
        go, fail, popped = self.go, self.fail, self.popped
        at = n = 0
        for b in word:
            while b not in go[at]:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return UNKNOWN_TOKENS
            at = go[at][b]
        while at != self.NEXT:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return UNKNOWN_TOKENS
        return n


def automaton(path: str) -> Automaton:
    """One automaton for each file and worker."""
    if path not in _LOADED:
        _LOADED[path] = Automaton(*pieces(path))
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 250_000) -> DataFrame:
    """Rows doc_id, n_words, n_tokens: greedy word-piece lengths of whole texts.

    Words are runs of bytes other than ASCII white space. Each distinct word runs through the automaton once for a
    worker (at most `limit` words are remembered). A null or empty text has no tokens, a null doc_id stays null, repeated
    rows are counted each, an empty table gives no rows, other columns are not read.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = automaton(path or vocabulary("byte_bpe_50k.json")), {}
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            for a, b in in_blocks(texts):
                words = [t.split() for t in texts[a:b]]
                n = np.fromiter(map(len, words), np.int64, b - a)
                flat = list(chain.from_iterable(words))
                if len(known) > limit:
                    known = {w: known[w] for w in flat if w in known}
                for w in flat:
                    if w not in known:
                        known[w] = count.count(w)
                sizes = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
                total = np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n)])])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n), pa.array(total)], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().cast("binary").alias("text")).mapInArrow(work, "doc_id long, n_words long, n_tokens long")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of all documents."""
    return count_tokens(documents(spark, sf_dir))
