"""Deep-shallow suffix sorting: multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

import numpy as np

#: Bytes that the multikey quicksort looks at, a multiple of 8.
SHALLOW = 24
#: Suffixes that are compared with their tries' representatives at once.
CHUNK = 1 << 15


def _ranges(key: np.ndarray) -> np.ndarray:
    """Beginnings of runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)


def sort_suffixes(buf: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of starts by the depth bytes from each on, and for each place in it whether a new string begins there.

    All starts must leave depth bytes in buf. Equal strings keep their given order.

    Shallow: a multikey quicksort whose characters are 8 bytes wide; each round splits the groups that are still equal,
    all at once. Deep: what shares SHALLOW bytes goes into a blind trie for each group, grown level by level for all
    groups together. A group's first suffix stands for its path; each other suffix leaves that path at the depth of their
    common prefix, by the byte there, so siblings are ordered by those two numbers alone, and suffixes that leave at one
    place by one byte form the next level's group.
    """
    n = len(starts)
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    group = np.zeros(n, np.int64)
    order = np.arange(n)
    live = np.arange(n)
    for at in range(0, min(SHALLOW, depth), 8):
        if not len(live):
            break
        take = min(8, depth - at)
        pos = starts[order[live]] + at
        word = np.zeros(len(live), np.uint64)
        for k in range(take):
            word = (word << np.uint64(8)) | padded[pos + k]
        o = np.lexsort((word, group[live]))
        order[live] = order[live][o]
        word, g = word[o], group[live]
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (g[1:] != g[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(first, append=len(live))
        group[live] = np.repeat(live[first], size)
        live = live[np.repeat(size > 1, size)]
    if depth <= SHALLOW:
        live = live[:0]
    while len(live):
        g = group[live]
        first = _ranges(g)
        size = np.diff(first, append=len(live))
        path = np.repeat(starts[order[live[first]]], size)
        pos = starts[order[live]]
        common = np.empty(len(live), np.int64)
        reach = np.arange(SHALLOW, depth)
        for a in range(0, len(live), CHUNK):
            differ = buf[pos[a : a + CHUNK, None] + reach] != buf[path[a : a + CHUNK, None] + reach]
            where = differ.argmax(axis=1)
            common[a : a + CHUNK] = np.where(differ[np.arange(len(where)), where], where + SHALLOW, depth)
        same = common == depth
        at = np.minimum(common, depth - 1)
        mine, theirs = buf[pos + at].astype(np.int64), buf[path + at].astype(np.int64)
        key = np.where(same, 1 << 30, np.where(mine < theirs, common * 256 + mine, (2 << 30) + (depth - common) * 256 + mine))
        o = np.lexsort((key, g))
        order[live] = order[live][o]
        key, same = key[o], same[o]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (g[1:] != g[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(first, append=len(live))
        group[live] = np.repeat(live[first], size)
        live = live[np.repeat(size > 1, size) & ~same]
    fresh = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.empty(0, bool)
    return order, fresh
