"""Content-defined chunk boundaries by a gear hash, vectorised.

A rolling gear hash of 64 bits depends on the last 64 bytes only: each byte's table value is shifted out after 64 steps.
So candidate boundaries are a pure function of a 64-byte window, any block of a stream yields its candidates from itself
and the 63 bytes before it, and only the least-length rule runs along the sparse candidates of a whole stream.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

#: Bytes before a block that its candidates depend on.
OVERLAP = 63

GEAR = np.array([int(hashlib.md5(bytes([b])).hexdigest()[:16], 16) for b in range(256)], np.uint64)


@dataclass(frozen=True)
class Profile:
    """How a stream is cut: candidates where the hash's top mask_bits are zero, chunks of at least min_len bytes, and of at most max_len where one is given."""

    mask_bits: int = 16
    min_len: int = 8192
    max_len: int | None = None
    digest: str = "xxh3"

    def __post_init__(self):
        if not 0 < self.mask_bits < 64 or self.min_len < 1 or (self.max_len is not None and self.max_len < self.min_len):
            raise ValueError(f"not a chunk profile: {self}")


#: The default: mean 64 KiB between candidates, at least 8 KiB, no most.
OPEN = Profile()
#: The second estimator's: the same, at most 128 KiB, told apart by SHA-256.
BOUNDED = Profile(max_len=131072, digest="sha256")


def rolling(values: np.ndarray) -> np.ndarray:
    """The gear hash after each value, given the table values of a stream from its beginning (or after OVERLAP values that are only context)."""
    h = values.astype(np.uint64)
    width = 1
    while width < 64:
        older = np.concatenate([np.zeros(min(width, len(h)), np.uint64), h[:-width]]) if len(h) else h
        h = h + (older << np.uint64(width))
        width *= 2
    return h


def candidates(block: bytes, before: bytes = b"", mask_bits: int = OPEN.mask_bits) -> np.ndarray:
    """Offsets in the block after which a boundary may lie; before: up to OVERLAP bytes that precede it."""
    before = before[-OVERLAP:]
    h = rolling(GEAR[np.frombuffer(before + block, np.uint8)])[len(before) :]
    return np.flatnonzero(h >> np.uint64(64 - mask_bits) == 0) + 1


def boundaries(found: np.ndarray, length: int, min_len: int, max_len: int | None = None) -> list[int]:
    """Ends of the chunks of a stream of this length, from its sorted candidates.

    A candidate closes a chunk that has min_len by then; a chunk is closed at max_len where no candidate does. The rest is
    a chunk of its own, even where it is empty.
    """
    out, start, i, n = [], 0, 0, len(found)
    while True:
        i += int(np.searchsorted(found[i:], start + min_len))
        end = int(found[i]) if i < n else None
        if max_len is not None and (end is None or end - start > max_len):
            if length - start <= max_len:
                break
            end = start + max_len
        if end is None:
            break
        out.append(end)
        start = end
    out.append(length)
    return out


def chunks(data: bytes, profile: Profile = OPEN) -> list[tuple[int, int]]:
    """(start, size) of the chunks of a whole stream."""
    ends = boundaries(candidates(data, mask_bits=profile.mask_bits), len(data), profile.min_len, profile.max_len)
    return [(a, b - a) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


#: The 32-bit variant over characters: table values are the first 8 hex digits of a character's MD5.
CHAR_BITS = 32


def char_candidates(text: str, limit: int = 1 << 26) -> np.ndarray:
    """Places after which a boundary may lie in a text: where the 32-bit gear hash of the last 32 characters is below limit."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    known, where = np.unique(points, return_inverse=True)
    table = np.array([int(hashlib.md5(chr(c).encode()).hexdigest()[:8], 16) for c in known.tolist()], np.uint32)
    h = table[where] if len(known) else np.empty(0, np.uint32)
    width = 1
    while width < CHAR_BITS:
        older = np.concatenate([np.zeros(min(width, len(h)), np.uint32), h[:-width]]) if len(h) else h
        h = h + (older << np.uint32(width))
        width *= 2
    return np.flatnonzero(h < limit) + 1
