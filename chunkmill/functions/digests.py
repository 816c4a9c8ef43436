"""Chunk digests and compressed sizes, for Arrow UDFs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
import xxhash

_DIGESTS = {"xxh3": xxhash.xxh3_64, "sha256": hashlib.sha256, "md5": hashlib.md5}
#: Most bytes of a chunk that are compressed as one block.
PIECE_BYTES = 1 << 26


def digest(data: bytes, kind: str = "xxh3") -> str:
    """Hex digest of a chunk."""
    return _DIGESTS[kind](data).hexdigest()


def lz4_size(data: bytes) -> int:
    """Bytes of the chunk as one raw LZ4 block."""
    return len(pa.compress(data, codec="lz4_raw", asbytes=True)) if data else 1


def measured(pieces: Iterable[bytes], kind: str = "xxh3") -> tuple[str, int]:
    """Hex digest of a chunk that comes in pieces, and the bytes of its pieces as raw LZ4 blocks."""
    whole, size = _DIGESTS[kind](), 0
    for data in pieces:
        whole.update(data)
        size += lz4_size(data)
    return whole.hexdigest(), size
