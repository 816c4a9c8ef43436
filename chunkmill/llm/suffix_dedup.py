"""Suffix-array dedup: repeated passages, by deep-shallow suffix sorting of what can repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, buckets, dealt, documents, gathered, in_blocks, keyed, mix, small_batches, stored, unpack
from .deep_shallow import sort_suffixes

#: Bytes of a repeated string; 65,535 at most.
LENGTH = 100
#: Bytes of the anchor that stands for all strings around it: of each string's anchors, the one with the least hash.
ANCHOR = 32
#: Bytes of text of which a task combines equal segments before it deals them.
COMBINE_BYTES = 16 << 20
#: An anchor with more different surroundings than this in one task's text, or than HOT_TOTAL in all, is settled by digests of its strings, dealt by the string, instead of by sorting in one task.
HOT_LOCAL, HOT_TOTAL = 64, 2000

_BYTE = np.random.default_rng(20240611).integers(0, 1 << 64, 256, dtype=np.uint64)
_MUL = np.random.default_rng(11).integers(0, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)


def _widths(width: int) -> list[int]:
    return [1 << k for k in range(width.bit_length()) if width >> k & 1]


def rolling(buf: np.ndarray, *widths: int, salt: int = 0) -> list[np.ndarray]:
    """For each width, hashes of the strings of that many bytes that begin at each place of buf."""
    h, size = _BYTE[buf] + np.uint64(salt), 1
    parts: dict[int, np.ndarray] = {1: h}
    while 2 * size <= max(widths):
        h = h[:-size] * _MUL[size.bit_length() + (8 if salt else 0) - 1] + h[size:]
        size *= 2
        parts[size] = h
    out = []
    for w in widths:
        acc, at = None, 0
        for k in reversed(_widths(w)):
            piece = parts[k][at : len(buf) - w + 1 + at]
            acc = piece if acc is None else acc * _MUL[7] + piece
            at += k
        out.append(mix(acc))
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of width values."""
    size = 1
    m = x
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - size : width - size + len(x) - width + 1]) if size < width else m


def segments(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """Segments of the texts: doc (index), lo, n: strings of `length` bytes that begin at lo .. lo+n-1 have one least anchor hash m; c: hash of all their bytes; own: the anchor comes more than once, so the segment can repeat itself.

    Which segment a string is in depends on its bytes alone, so equal strings have equal m wherever they are.
    """
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    none = {"own": np.empty(0, bool), "doc": np.empty(0, np.int64), "lo": np.empty(0, np.int64), "n": np.empty(0, np.int64), "m": np.empty(0, np.uint64), "c": np.empty(0, np.uint64)}
    if len(buf) < length:
        return none
    a, w = rolling(buf, anchor, length)
    m = _least(a, length - anchor + 1)
    begin = np.cumsum(sizes) - sizes
    fits = np.maximum(sizes - length + 1, 0)
    doc = np.repeat(np.arange(len(texts)), fits)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(fits) - fits, fits)
    pos = at + begin[doc]
    if not len(pos):
        return none
    m = m[pos]
    new = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])]))
    n = np.diff(new, append=len(m))
    if n.max() > length:  # a period's anchor goes on and on; such runs are cut, their parts meet by m all the same
        k = -(-n // length)
        new = np.repeat(new, k) + length * (np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k))
        n = np.diff(new, append=len(m))
    first, last = w[pos[new]], w[pos[new + n - 1]]
    wide = n + length - anchor
    edge = np.cumsum(wide) - wide
    inside = a[np.arange(int(wide.sum())) + np.repeat(pos[new] - edge, wide)] == np.repeat(m[new], wide)
    own = np.add.reduceat(inside.astype(np.int32), edge) > 1
    return {"own": own, "doc": doc[new], "lo": at[new], "n": n, "m": m[new], "c": mix(first * _MUL[9] + last * _MUL[10] + n.astype(np.uint64))}


def _later(keys: tuple[np.ndarray, ...], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, then place; and for each row in it whether an earlier one has the same keys."""
    o = np.lexsort((at, doc, *reversed(keys)))
    same = np.ones(max(len(o) - 1, 0), bool)
    for k in keys:
        k = k[o]
        same &= k[1:] == k[:-1]
    return o, np.concatenate([[False], same])[: len(o)]


_SEG = {"m": np.uint64, "c": np.uint64, "doc": np.int64, "lo": np.int32, "n": np.uint16, "flags": np.uint8}
#: What a row holds: a blob of segments by anchor; a span to remove, a candidate, both by document; a string's bytes by anchor; a blob of digests by string.
SEGMENTS, SPAN, CANDIDATE, STRING, DIGESTS = range(5)
#: Flags of a segment: it can repeat itself; its anchor is hot.
OWN, HOT = 1, 2
_OUT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("doc", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("m", pa.int64()), ("hot", pa.bool_()), ("blob", pa.binary())])
_DDL = "kind int, bucket int, doc long, lo int, n int, m long, hot boolean, blob binary"


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    return (mix(x.astype(np.int64).view(np.uint64) if x.dtype != np.uint64 else x) % np.uint64(n)).astype(np.int32)


def _filled(rows: int, **columns) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _OUT], schema=_OUT)


def _blobs(kind: int, arrays: dict[str, np.ndarray], to: np.ndarray) -> Iterator[pa.RecordBatch]:
    got = list(dealt(arrays, to))
    yield from _filled(len(got), kind=[kind] * len(got), bucket=[g[0] for g in got], blob=[g[1] for g in got])


def _spans(x: dict[str, np.ndarray], which: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """These segments as spans to remove, those that touch as one."""
    doc, lo, size = x["doc"][which], x["lo"][which].astype(np.int64), x["n"][which].astype(np.int64)
    o = np.lexsort((lo, doc))
    doc, lo, size = doc[o], lo[o], size[o]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > lo[:-1] + size[:-1])])) if len(doc) else np.empty(0, np.int64)
    if len(new):
        last = np.append(new[1:], len(doc)) - 1
        doc, lo, size = doc[new], lo[new], lo[last] + size[last] - lo[new]
        yield from _filled(len(doc), kind=np.full(len(doc), SPAN), bucket=_bucket(doc, n), doc=doc, lo=lo, n=size)


def _candidates(x: dict[str, np.ndarray], which: np.ndarray, hot: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    doc = x["doc"][which]
    yield from _filled(len(doc), kind=np.full(len(doc), CANDIDATE), bucket=_bucket(doc, n), doc=doc, lo=x["lo"][which], n=x["n"][which], m=x["m"][which].astype(np.int64), hot=hot)


def _by_anchor(rows: DataFrame, n: int, length: int) -> DataFrame:
    """Segments of all texts, combined in each task."""

    def flush(held: list[dict]) -> Iterator[pa.RecordBatch]:
        x = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        x["m"] >>= np.uint64(20)
        o, again = _later((x["m"], x["c"]), x["doc"], x["lo"])
        x = {k: v[o] for k, v in x.items()}
        yield from _spans(x, again, n)
        x = {k: v[~again] for k, v in x.items()}
        first = _begin(x["m"])
        size = np.diff(first, append=len(x["m"]))
        hot = np.repeat(size > HOT_LOCAL, size)
        yield from _candidates(x, hot, np.ones(int(hot.sum()), bool), n)
        keep = ~hot
        keep[first] = True  # one of a hot anchor tells the others that it is hot
        x["flags"] = (x["own"] * OWN + hot * HOT).astype(np.uint8)
        seg = {k: x[k][keep].astype(t) for k, t in _SEG.items()}
        yield from _blobs(SEGMENTS, seg, _bucket(seg["m"], n))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            key, texts = batch.column("key").to_numpy(), [t.as_py() for t in batch.column("text")]
            for a, b in in_blocks(texts):
                x = segments(texts[a:b], length)
                x["doc"] = key[a:b][x["doc"]]
                held.append(x)
                total += sum(map(len, texts[a:b]))
                if total >= COMBINE_BYTES:
                    yield from flush(held)
                    held, total = [], 0
        if held:
            yield from flush(held)

    return rows.select("key", "text").mapInArrow(work, _DDL)


def _begin(key: np.ndarray) -> np.ndarray:
    """Beginnings of runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)


def _meet(n: int):
    """For each anchor's bucket: later segments of equal bytes become spans, different ones of one anchor candidates."""

    def work(key, table):
        x = gathered(table.column("blob").to_pylist(), _SEG)
        o, again = _later((x["m"], x["c"]), x["doc"], x["lo"])
        x = {k: v[o] for k, v in x.items()}
        hot, own = x["flags"] & HOT > 0, x["flags"] & OWN > 0
        first = _begin(x["m"])
        size = np.diff(first, append=len(o))
        told = np.add.reduceat(hot, first) > 0 if len(first) else np.empty(0, bool)
        fresh = np.add.reduceat(~again, first) if len(first) else np.empty(0, np.int64)
        big = np.repeat(told | (fresh > HOT_TOTAL), size)
        # one that tells is among the candidates already
        want = (np.repeat(told | (fresh > 1), size) | own) & ~again & ~hot
        return pa.Table.from_batches([*_spans(x, again, n), *_candidates(x, want, big[want], n)], _OUT)

    return work


def _strings(n: int, length: int):
    """For each bucket of documents: the bytes of its candidates, dealt by anchor; for hot anchors digests, dealt by string."""

    def work(key, docs, candidates):
        doc, lo, size, m = (candidates.column(k).to_numpy() for k in ("doc", "lo", "n", "m"))
        is_hot = candidates.column("hot").to_numpy()
        out = []
        if len(doc):
            texts = {}
            wanted = set(np.unique(doc).tolist())
            for blob in docs.column("blob").to_pylist():
                t = unpack(blob)
                texts.update((k, v) for k, v in zip(t.column("key").to_pylist(), t.column("text").to_pylist(), strict=True) if k in wanted)
            take = lambda part: [texts[d][a : a + k + length - 1] for d, a, k in zip(doc[part].tolist(), lo[part].tolist(), size[part].tolist(), strict=True)]
            cool = np.flatnonzero(~is_hot)
            for a in range(0, len(cool), 1 << 16):
                part = cool[a : a + (1 << 16)]
                out += _filled(len(part), kind=np.full(len(part), STRING), bucket=_bucket(m[part].view(np.uint64), n), doc=doc[part], lo=lo[part], m=m[part], blob=take(part))
            hot = np.flatnonzero(is_hot)
            for a in range(0, len(hot), 1 << 12):
                part = hot[a : a + (1 << 12)]
                buf = np.frombuffer(b"".join(take(part)), np.uint8)
                sizes = size[part].astype(np.int64)
                row = np.repeat(np.arange(len(part)), sizes)
                off = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                pos = off + (np.cumsum(sizes + length - 1) - (sizes + length - 1))[row]
                y = {"d1": rolling(buf, length)[0][pos], "d2": rolling(buf, length, salt=0x5851F42D4C957F2D)[0][pos], "doc": doc[part][row], "lo": (lo[part][row] + off).astype(np.int32)}
                o, again = _later((y["d1"], y["d2"]), y["doc"], y["lo"])
                y = {k: v[o] for k, v in y.items()}
                out += _spans(y | {"n": np.ones(len(o), np.int64)}, again, n)
                rest = {k: v[~again] for k, v in y.items()}
                out += _blobs(DIGESTS, rest, _bucket(rest["d1"], n))
        return pa.Table.from_batches(out, _OUT)

    return work


def _sort(n: int, length: int):
    """Sort the suffixes of strings that share anchors, and settle hot ones by digest; later ones of equal bytes become spans."""

    def work(key, table):
        out = []
        kind = table.column("kind").to_numpy()
        if digests := [b for k, b in zip(kind, table.column("blob").to_pylist(), strict=True) if k == DIGESTS]:
            y = gathered(digests, {"d1": np.uint64, "d2": np.uint64, "doc": np.int64, "lo": np.int32})
            o, again = _later((y["d1"], y["d2"]), y["doc"], y["lo"])
            out += _spans({"doc": y["doc"][o], "lo": y["lo"][o], "n": np.ones(len(o), np.int64)}, again, n)
        some = table.filter(pa.array(kind == STRING))
        m, docs, los, data = some.column("m").to_numpy(), some.column("doc").to_numpy(), some.column("lo").to_numpy(), some.column("blob")
        o = np.argsort(m, kind="stable")
        edges = np.append(_begin(m[o]), len(o))
        a = 0
        while a < len(edges) - 1:  # whole anchors together, up to about 16k strings at once
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + (1 << 14), "right")) - 1)
            part = o[edges[a] : edges[b]]
            a = b
            own = data.take(pa.array(part)).to_pylist()
            size = np.fromiter(map(len, own), np.int64, len(own))
            many = size - length + 1
            row = np.repeat(np.arange(len(own)), many)
            off = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            doc, lo = docs[part][row], los[part][row].astype(np.int64) + off
            place = np.lexsort((lo, doc))
            order, fresh = sort_suffixes(np.frombuffer(b"".join(own), np.uint8), ((np.cumsum(size) - size)[row] + off)[place], length)
            out += _spans({"doc": doc, "lo": lo, "n": np.ones(len(doc), np.int64)}, place[order[~fresh]], n)
        return pa.Table.from_batches(out, _OUT)

    return work


def _runs(size: int, spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings beginning in these spans cover."""
    out: list[list[int]] = []
    for lo, n in sorted(spans):
        end = min(lo + n - 1 + length, size)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([lo, end])
    return [(a, b) for a, b in out]


def _rest(length: int, schema: pa.Schema, finish):
    """For each bucket of documents: what is left of each."""

    def work(key, docs, spans):
        ids = spans.column("doc").to_numpy()
        o = np.argsort(ids, kind="stable")
        ids, lo, n = ids[o], spans.column("lo").to_numpy()[o], spans.column("n").to_numpy()[o]
        edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]])) if len(ids) else np.zeros(1, np.int64)
        of = {int(ids[a]): list(zip(lo[a:b].tolist(), n[a:b].tolist(), strict=True)) for a, b in zip(edges[:-1], edges[1:], strict=True)}
        out = []
        for blob in docs.column("blob").to_pylist():
            t = unpack(blob)
            rows = t.to_pylist()
            for r in rows:
                r["runs"] = _runs(len(r["text"]), of.get(r["key"], []), length)
            out.append(pa.Table.from_pylist([finish(r) for r in rows], schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return work


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    if not runs:
        return text
    edges = [0, *[e for r in runs for e in r], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def repeated(rows: DataFrame, finish, schema: pa.Schema, ddl: str, length: int = LENGTH) -> DataFrame:
    """Apply finish to each row of keyed() with its runs of repeated bytes.

    1. Each task cuts its texts into segments by content (the anchor of least hash in each string of `length` bytes),
       drops segments of equal bytes that come later, and deals the others by anchor, as hashes.
    2. For each anchor, later segments of equal bytes are settled; different segments of one anchor are candidates,
       since only they can still share a string. An anchor that comes once is done with.
    3. Candidates' bytes are fetched from their documents and dealt by anchor, and all their suffixes are sorted by
       deep-shallow sorting; of equal strings all but the earliest are repeated. An anchor with very many surroundings is
       split: its strings go by 128-bit digest instead, each task sending a string once.
    4. Spans meet their documents.
    Equal strings always meet, so nothing is missed; between steps only hashes, candidates and spans are dealt, texts
    twice, compressed.
    """
    spark = rows.sparkSession
    small_batches(spark)
    n = buckets(spark)
    first = stored(_by_anchor(rows, n, length), "segments")
    met = stored(first.where(F.col("kind") == SEGMENTS).groupBy("bucket").applyInArrow(_meet(n), _DDL), "met")
    both = first.unionByName(met)
    texts = blobs(rows.select("key", "text"), n)
    got = stored(texts.groupBy("bucket").cogroup(both.where(F.col("kind") == CANDIDATE).groupBy("bucket")).applyInArrow(_strings(n, length), _DDL), "strings")
    sorted_ = got.where(F.col("kind").isin(STRING, DIGESTS)).groupBy("bucket").applyInArrow(_sort(n, length), _DDL)
    spans = both.unionByName(got).where(F.col("kind") == SPAN).unionByName(sorted_).select("bucket", "doc", "lo", "n")
    return blobs(rows, n).groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(_rest(length, schema, finish), ddl)


def _figures(r: dict) -> dict:
    kept = _kept(r["text"], r["runs"])
    return {"doc_id": r["doc_id"], "n_bytes": len(r["text"]), "n_removed": len(r["text"]) - len(kept), "n_spans": len(r["runs"]), "kept_sha256": hashlib.sha256(kept).hexdigest()}


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """For each document doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    Each byte is removed that is covered by a string of `length` bytes which also begins earlier (smaller doc_id, or same
    document and smaller start), judged on the input. A null text counts as empty. Documents of one id are ordered by
    text, null ids come first; of repeated rows the first stays and the others go whole, if they have `length` bytes. An
    empty table gives no rows. Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    return repeated(keyed(docs), _figures, schema, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length)


def rewritten(r: dict) -> dict:
    """For repeated(): the text that is left, null where nothing was removed; a code point that a cut halves goes whole."""
    return {"key": r["key"], "kept": _kept(r["text"], r["runs"]).decode(errors="ignore") if r["runs"] else None}


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What of all documents repeats an earlier 100 bytes."""
    return removed(documents(spark, sf_dir))
