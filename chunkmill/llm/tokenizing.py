"""Tokenizers from their public vocabulary files, with a bounded cache of words."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MARKS = ".,!?%*&$#;:"
#: A word whose stem, what is left without the marks at its end, ends in a Latin letter that lower-casing leaves one.
_STEM = rf"[A-Za-z\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{12F}}\x{{131}}-\x{{24F}}][{re.escape(_MARKS)}]*$"

_LOADED: dict[str, CachedTokenizer] = {}


def vocabulary(name: str) -> str:
    """Where a vocabulary file of the public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def halves(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each word as two pieces whose ids are its own: a lower-case stem and the ASCII marks at its end, or where that cannot be told, since the stem does not end in a letter or a special token may be in the word, the word and nothing."""
    apart = pc.and_not(pc.match_substring_regex(words, _STEM), pc.match_substring(words, "<|"))
    stems = pc.if_else(apart, pc.ascii_lower(pc.ascii_rtrim(words, _MARKS)), words)
    marked = pc.not_equal(pc.binary_length(stems), pc.binary_length(words))
    ends = pc.replace_substring_regex(words.filter(marked), rf"^.*[^{re.escape(_MARKS)}]", "")
    return stems, pc.replace_with_mask(pa.repeat(pa.scalar(""), len(words)), marked, ends)


class CachedTokenizer:
    """Token ids of texts, word by word.

    For a tokenizer that never joins what white space separates (as word_bpe_49k), the ids of a text are those of its
    words, one after another. A block's distinct words are told apart and cut into pieces (see halves) by Arrow. A piece's
    ids are looked up in a table of at most `limit` pieces, so that memory is bounded; the new pieces of one block that do
    not fit are kept for that block alone.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.index: dict[str, int] = {}
        self.size = np.zeros(1 << 12, np.int32)
        self.at = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.filled = 0

    def _learn(self, new: list[str]) -> None:
        """Put pieces into the table."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        n = len(self.index)
        while n + len(new) > len(self.size):
            self.size, self.at = np.concatenate([self.size, self.size * 0]), np.concatenate([self.at, self.at * 0])
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids * 0])
        self.size[n : n + len(new)] = sizes
        self.at[n : n + len(new)] = self.filled + np.cumsum(sizes) - sizes
        self.ids[self.filled : self.filled + len(flat)] = flat
        self.filled += len(flat)
        self.index.update(zip(new, range(n, n + len(new)), strict=True))

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Where the table has distinct pieces; what it lacks is learnt."""
        where = list(map(self.index.get, pieces))
        if new := [p for p, w in zip(pieces, where, strict=True) if w is None]:
            self._learn(new)
            where = map(self.index.__getitem__, pieces)
        return np.fromiter(where, np.int64, len(pieces))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text."""
        words = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        each = words.flatten().dictionary_encode()
        stems, ends = halves(each.dictionary)
        pieces = pa.concat_arrays([stems, ends]).dictionary_encode()
        places = self._places(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()].reshape(2, -1)
        both = gather(self.ids, self.at[places].T.ravel(), self.size[places].T.ravel())
        own = self.size[places].sum(axis=0, dtype=np.int64)
        word = each.indices.to_numpy()
        sizes = own[word]
        out = gather(both, (np.cumsum(own) - own)[word], sizes)
        while len(self.index) > self.limit:
            self.index.popitem()
            self.filled = int(self.at[len(self.index)])
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *words.value_lengths().to_numpy()])]
        return [out[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def gather(values: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of values that begin at `at`, one after another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - (ends - sizes), sizes)]


def cached(path: str) -> CachedTokenizer:
    """One tokenizer for each file and worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        _LOADED[path] = CachedTokenizer(path)
    return _LOADED[path]
