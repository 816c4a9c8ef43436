"""Elias-Fano sequences and a level of an n-gram trie on them, all of arrays that can be mapped from a file."""

from __future__ import annotations

import tempfile

import numpy as np

#: Elements that are decoded at once.
CHUNK = 1 << 16


class EliasFano:
    """A non-decreasing sequence of unsigned values: the low part of each in whole bytes, the high parts in unary.

    About 2 bits and log2(universe / n), rounded up to bytes, for each value.
    """

    def __init__(self, n: int, low_bytes: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.low_bytes, self.low, self.high, self.marks = n, low_bytes, low, high, marks

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """Of sorted values."""
        values = np.ascontiguousarray(values, np.uint64)
        n = len(values)
        wide = -(-max(0, (int(values[-1]) // n).bit_length() - 1) // 8) if n else 0
        place = (values >> np.uint64(8 * wide)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(place[-1]) if n else 0) + 1, np.uint8)
        unary[place] = 1
        low = values.view(np.uint8).reshape(n, 8)[:, :wide]
        return cls(n, wide, np.ascontiguousarray(low).ravel(), np.packbits(unary), place[::CHUNK])

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bytes], np.int64), self.low, self.high, self.marks]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(int(arrays[0][0]), int(arrays[0][1]), *arrays[1:4])

    def decode(self, chunk: int) -> np.ndarray:
        """The values of one chunk."""
        a, b = chunk * CHUNK, min((chunk + 1) * CHUNK, self.n)
        begin = int(self.marks[chunk])
        end = int(self.marks[chunk + 1]) if b < self.n else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin // 8 : -(-end // 8)])) + begin // 8 * 8
        ones = ones[np.searchsorted(ones, begin) :][: b - a]
        value = (ones - np.arange(a, b)).astype(np.uint64) << np.uint64(8 * self.low_bytes)
        if self.low_bytes:
            low = np.zeros((b - a, 8), np.uint8)
            low[:, : self.low_bytes] = self.low[a * self.low_bytes : b * self.low_bytes].reshape(b - a, -1)
            value |= low.view(np.uint64).ravel()
        return value

    def values(self) -> np.ndarray:
        return np.concatenate([self.decode(k) for k in range(-(-self.n // CHUNK))]) if self.n else np.empty(0, np.uint64)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The values at ascending places."""
        out = np.zeros(len(places), np.uint64)
        edges = np.searchsorted(places, np.arange(0, self.n + CHUNK, CHUNK)).tolist()
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if b > a:
                out[a:b] = self.decode(k)[places[a:b] - k * CHUNK]
        return out

    def successors(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending queries, the index of the first value that is no less, and whether it is equal. One pass over the chunks."""
        at = np.full(len(queries), self.n, np.int64)
        equal = np.zeros(len(queries), bool)
        done = 0
        for k in range(-(-self.n // CHUNK)):
            if done == len(queries):
                break
            chunk = self.decode(k)
            stop = int(np.searchsorted(queries, chunk[-1], "right"))
            if stop > done:
                i = np.searchsorted(chunk, queries[done:stop])
                at[done:stop] = k * CHUNK + i
                equal[done:stop] = chunk[i] == queries[done:stop]
                done = stop
        return at, equal


class Trie:
    """A level of an n-gram trie: contexts, and the successors of each with a quantised probability.

    `vocabulary`: the words' hashes; a word's number is its place there, plus 1. `contexts`: the contexts' hashes.
    `pointers`: where each context's successors begin, monotone, with one more for the end. `words`: the successors'
    numbers, each on top of the last value of the context before, so that the whole level ascends; a word is looked for
    relative to its context, between the values at its context's two pointers. `codes` and `weights`: the quantised
    probability of each successor and back-off weight of each context.
    """

    def __init__(self, vocabulary: EliasFano, contexts: EliasFano, pointers: EliasFano, words: EliasFano, codes: np.ndarray, weights: np.ndarray):
        self.vocabulary, self.contexts, self.pointers, self.words, self.codes, self.weights = vocabulary, contexts, pointers, words, codes, weights

    @classmethod
    def build(cls, contexts: np.ndarray, first: np.ndarray, words: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> Trie:
        """contexts: ascending; first: where the successors of each, if any, begin among words, and their number; words: ascending for each context."""
        vocabulary, number = np.unique(words, return_inverse=True)
        number = number.astype(np.uint64) + np.uint64(1)
        last = np.zeros(len(contexts), np.uint64)
        last[np.diff(first) > 0] = number[first[1:][np.diff(first) > 0] - 1]
        base = np.cumsum(last, dtype=np.uint64) - last
        levels = (vocabulary, contexts, first, number + np.repeat(base, np.diff(first)))
        return cls(*map(EliasFano.build, levels), codes, weights)

    def save(self, path: str) -> None:
        parts = [*self.vocabulary.arrays(), *self.contexts.arrays(), *self.pointers.arrays(), *self.words.arrays(), self.codes, self.weights]
        with open(path, "wb") as out:
            np.array([len(parts), *[x for p in parts for x in (p.dtype.num, len(p))]], np.int64).tofile(out)
            for p in parts:
                out.write(b"\0" * (-out.tell() % 8))
                np.ascontiguousarray(p).tofile(out)

    @classmethod
    def load(cls, path: str) -> Trie:
        """The level as a map of the file."""
        data = np.memmap(path, np.uint8, "r")
        n = int(data[:8].view(np.int64)[0])
        head = np.array(data[8 : 8 + 16 * n]).view(np.int64).reshape(n, 2)
        kinds = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.int64)}
        parts, at = [], 8 + 16 * n
        for kind, size in head.tolist():
            at += -at % 8
            end = at + size * kinds[kind].itemsize
            parts.append(data[at:end].view(kinds[kind]))
            at = end
        return cls(*[EliasFano.of(parts[i : i + 4]) for i in range(0, 16, 4)], parts[16], parts[17])

    def lookup(self, contexts: np.ndarray, n: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code of each successor (0: not there) and the weight's code of each context (0: not there); contexts ascend, and of words, which ascend for each context, each has its n."""
        rank, known = self.contexts.successors(contexts)
        codes, weights = np.zeros(len(words), np.uint8), np.zeros(len(contexts), np.uint8)
        weights[known] = self.weights[rank[known]]
        if not known.any():
            return codes, weights
        some, back = np.unique(rank[known], return_inverse=True)
        begin, end = self.pointers.at(some).astype(np.int64), self.pointers.at(some + 1).astype(np.int64)
        base, top = (np.where(x > 0, self.words.at(np.maximum(x - 1, 0)), np.uint64(0)) for x in (begin, end))
        distinct, which = np.unique(words, return_inverse=True)
        number, there = self.vocabulary.successors(distinct)
        mine = np.repeat(known, n) & there[which]
        slot = back[np.repeat(np.cumsum(known) - 1, n)[mine]]
        want = base[slot] + number[which[mine]].astype(np.uint64) + np.uint64(1)
        within = want <= top[slot]
        mine, want = np.flatnonzero(mine)[within], want[within]
        at, equal = self.words.successors(want)
        codes[mine[equal]] = self.codes[at[equal]]
        return codes, weights


def mapped(trie: Trie) -> tuple[Trie, tempfile.TemporaryDirectory]:
    """The trie, mapped from a file of this worker's own; the folder goes with its object."""
    folder = tempfile.TemporaryDirectory(prefix="trie-")
    trie.save(f"{folder.name}/levels")
    return Trie.load(f"{folder.name}/levels"), folder
