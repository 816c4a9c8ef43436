"""N-gram Jaccard join by vertical partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scope, buckets, cut, dealt, documents, in_blocks, keyed, mix, pack, shingled, small_batches, stored, unpack
from .components import components

WIDTH, PERCENT = 5, 80
#: Text of which a task counts shingles together.
BLOCK_TEXT = 8 << 20
#: Bits of a shingle's hash by which its document frequency is counted. Two that fall together look more frequent, which changes the order alone; sets are compared by all 64 bits.
COUNT_BITS = 40
#: Fragments into which the global order of shingles is cut, of about as many postings each.
FRAGMENTS = 4
#: A shingle with more postings than this in one bucket has them paired with their hubs there in the first round, and hubs alone are posted.
LOCAL_POSTS = 32

_ROWS = "bucket int, block long, blob binary"


def _arrow(got: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary())], ["bucket", "block", "blob"])


def sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for a, b in in_blocks(texts):
        h, n = shingled(texts[a:b], width)
        own = np.repeat(np.arange(b - a), n)
        o = np.lexsort((h, own))
        h, own = h[o], own[o]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])]) if len(h) else np.empty(0, bool)
        out += np.split(h[new], np.searchsorted(own[new], np.arange(1, b - a)))
    return out


def _blocks(rows: DataFrame, make, block_text: int) -> DataFrame:
    small_batches(rows.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, held, total = TaskContext.get().partitionId() << 24, 0, [], 0
        for batch in batches:
            texts = batch.column("text")
            for i in range(batch.num_rows):
                size = len(texts[i].as_buffer())
                if total and total + size > block_text:
                    yield make(first + n, pa.Table.from_batches(held))
                    n, held, total = n + 1, [], 0
                held.append(batch.slice(i, 1))
                total += size + 1
        if held:
            yield make(first + n, pa.Table.from_batches(held))

    return rows.select("key", "doc_id", "text").mapInArrow(work, _ROWS)


def _short(x: np.ndarray) -> np.ndarray:
    return x >> np.uint64(64 - COUNT_BITS)


def _cuts(values: np.ndarray, n: int) -> list[int]:
    return np.searchsorted(values, np.array([-(-(i << COUNT_BITS) // n) for i in range(n)], np.uint64)).tolist() + [len(values)]


def _frequencies(n: int, width: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's shingles with how many documents have them, to the buckets of their hashes."""
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                every = sets(unpack(blob).column("text").to_pylist(), width)
                value, count = np.unique(_short(np.concatenate(every)), return_counts=True)
                cuts = _cuts(value, n)
                yield _arrow([(k, block, pack(pa.table({"step": np.diff(value[a:b], prepend=np.uint64(0)), "count": count[a:b].astype(np.uint32)}))) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a])

    return work


def _classes(key, table):
    """A class for each block's shingles by document frequency: 0 for those of one document, then more by the logarithm; on block -1 how many postings each class has."""
    parts = [unpack(b) for b in table.column("blob").to_pylist()]
    values = [np.cumsum(p.column("step").to_numpy(), dtype=np.uint64) for p in parts]
    flat = np.concatenate(values)
    o = np.argsort(flat)
    first = np.flatnonzero(np.concatenate([[True], flat[o][1:] != flat[o][:-1]]))
    total = np.add.reduceat(np.concatenate([p.column("count").to_numpy() for p in parts]).astype(np.int64)[o], first)
    out = np.empty(len(flat), np.uint8)
    kind = np.minimum(np.ceil(8 * np.log2(total)), 255).astype(np.uint8)
    out[o] = np.repeat(kind, np.diff(first, append=len(flat)))
    postings = np.bincount(kind, total, 256).astype(np.int64)
    edges = np.cumsum([0, *map(len, values)])
    bucket = key[0].as_py()
    answers = [(bucket, block, pack(pa.table({"kind": out[a:b]}))) for block, a, b in zip(table.column("block").to_pylist(), edges[:-1], edges[1:], strict=True)]
    return pa.Table.from_batches([_arrow([*answers, (bucket, -1, pack(pa.table({"postings": postings})))])])


def place(kind: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where shingles stand in the global order: by class, then by hash."""
    return kind.astype(np.uint64) << np.uint64(56) | x >> np.uint64(8)


def pivots(postings: np.ndarray, fragments: int) -> np.ndarray:
    """Places that cut the global order of the shingles that several documents have into fragments of about as many postings; postings: how many each class has. Within a class hashes are spread evenly."""
    mass = postings.astype(float)
    mass[0] = 0
    upto = np.cumsum(mass)
    goal = upto[-1] * np.arange(1, fragments) / fragments
    kind = np.minimum(np.searchsorted(upto, goal), 255)
    part = np.clip((goal - upto[kind] + mass[kind]) / np.maximum(mass[kind], 1), 0, 1)
    return kind.astype(np.uint64) << np.uint64(56) | (part * ((1 << 56) - 1)).astype(np.uint64) & np.uint64((1 << 56) - 1)


def _texts(block: int, table: pa.Table) -> pa.RecordBatch:
    return _arrow([(0, block, pack(table.combine_chunks()))])


#: What a row of the first result holds: documents that cannot link or are copies of another of their block, and those that go on.
MEMBERS, SETS = 0, 1
_KINDS = "kind int, bucket int, blob binary"
_MEMBERS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("rep", pa.int64())])
_SETS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary(16)), ("tokens", pa.binary()), ("central", pa.int64()), ("cuts", pa.list_(pa.int32()))])


def _kinds(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"kind": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})


def _ordered(n: int, width: int, percent: int, pivot: np.ndarray):
    def work(key, kept, answers):
        """The sets of a block's documents without shingles that no other document has, in the global order, and where its fragments begin in them."""
        kinds = [unpack(b).column("kind").to_numpy() for _, b in sorted(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True))]
        kind = np.concatenate(kinds) if kinds else np.empty(0, np.uint8)
        members, going, seen = [], {}, {}
        for blob in kept.column("blob").to_pylist():
            t = unpack(blob)
            own = sets(t.column("text").to_pylist(), width)
            value = np.unique(_short(np.concatenate(own)))
            if len(value) != len(kind):
                raise RuntimeError("the answers to a block are not those that it asked for")
            for k, d, x in sorted(zip(t.column("key").to_pylist(), t.column("doc_id").to_pylist(), own, strict=True), key=lambda r: r[0]):
                c = kind[np.searchsorted(value, _short(x))]
                shared = c > 0
                if not len(x) or 100 * int(shared.sum()) < percent * len(x):
                    members.append((k, d, len(x), k))
                    continue
                digest = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                if digest in seen:
                    members.append((k, d, len(x), seen[digest]))
                    continue
                seen[digest] = k
                at = place(c[shared], x[shared])
                o = np.argsort(at)
                going.setdefault(int.from_bytes(digest[:4], "little") % n, []).append((k, d, len(x), digest, x[shared][o].tobytes(), int(1000 * c.mean()), np.searchsorted(at[o], pivot).tolist()))
        rows = [(SETS, b, pack(_rows(v, _SETS))) for b, v in going.items()]
        return _kinds([(MEMBERS, 0, pack(_rows(members, _MEMBERS))), *rows])

    return work


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * len(schema), schema, strict=True)], schema=schema)


def _representatives(n: int):
    def work(key, table):
        """The first document of each set; all documents of the bucket as members of theirs."""
        first, members = {}, []
        for blob in table.column("blob").to_pylist():
            for r in zip(*(c.to_pylist() for c in unpack(blob).columns), strict=True):
                members.append(r)
                if r[3] not in first or r[0] < first[r[3]][0]:
                    first[r[3]] = r
        going: dict[int, list] = {}
        for r in first.values():
            going.setdefault(r[0] % n, []).append(r)
        return _kinds([(MEMBERS, 0, pack(_rows([(r[0], r[1], r[2], first[r[3]][0]) for r in members], _MEMBERS))), *[(SETS, b, pack(_rows(v, _SETS))) for b, v in going.items()]])

    return work


def _opened(table) -> dict[int, tuple[int, np.ndarray, int]]:
    """key -> (size of the set, its shared shingles in the global order, how central it is)."""
    out = {}
    for blob in table.column("blob").to_pylist():
        t = unpack(blob)
        out.update((k, (n, np.frombuffer(x, np.uint64), c)) for k, n, x, c in zip(*(t.column(f).to_pylist() for f in ("key", "n", "tokens", "central")), strict=True))
    return out


def prefix(n: int, shared: int, percent: int) -> int:
    """How many of a set's shared shingles, the rarest, one at least must be in any set that links with it."""
    least = -(-percent * n // 100)
    return max(0, n - least + 1 - (n - shared))


def _fits(a, b, percent: int):
    """Whether sets of these sizes can link."""
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def _groups(token: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of equal tokens that are longer than one."""
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, np.int64)
    last = np.append(first[1:], len(token))
    some = last - first > 1
    return zip(first[some].tolist(), last[some].tolist(), strict=True)


def _stars(key: np.ndarray, size: np.ndarray, label: np.ndarray, percent: int) -> tuple[list, np.ndarray]:
    """Pairs of one shingle's postings, the most central first, with hubs: the first, and the first of those whose size that one rules out, and so on. Also which are hubs."""
    found, hubs, left = [], np.zeros(len(key), bool), np.arange(len(key))
    while len(left):
        hubs[left[0]] = True
        fits = _fits(size[left[0]], size[left[1:]], percent)
        other = left[1:][fits]
        other = other[label[other] != label[left[0]]]
        if len(other):
            found.append(np.stack([np.full(len(other), key[left[0]]), key[other]], 1))
        left = left[1:][~fits]
    return found, hubs


def bitmap(x: np.ndarray, size: int) -> np.ndarray:
    """Parities of a set's hashes by their lowest bits, in about two bits for each of its size; half of it xor the other half is the bitmap of half the length."""
    bits = 1 << min(max((2 * size - 1).bit_length(), 8), 14)
    return np.packbits((np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


class Sketches:
    """Bitmaps of sets, by which pairs are ruled out for certain: sets differ in at least as many elements as their bitmaps in bits, and in all that no other set has."""

    def __init__(self, keys: list[int], sizes: list[int], shared: list[int], maps: list[np.ndarray], percent: int):
        self.percent, self.at = percent, {}
        self.rows: dict[int, list] = {}
        for k, n, m, x in zip(keys, sizes, shared, maps, strict=True):
            if k not in self.at:
                own = self.rows.setdefault(len(x), [])
                self.at[k] = len(x), len(own), n, n - m
                own.append(x)
        self.maps = {w: np.stack(v) for w, v in self.rows.items()}

    def possible(self, key: int, others: np.ndarray) -> np.ndarray:
        """Which of the others, all of sizes that fit, can link with the key's set."""
        width, row, n, alone = self.at[key]
        x = self.maps[width][row]
        where = np.array([self.at[k] for k in others.tolist()], np.int64).reshape(-1, 4)
        ok = np.zeros(len(others), bool)
        total = n + where[:, 2]
        most = total - 2 * (-(-self.percent * total // (100 + self.percent)))
        for w in np.unique(where[:, 0]).tolist():
            part = np.flatnonzero(where[:, 0] == w)
            y, own = self.maps[w][where[part, 1]], x
            while own.shape[-1] > y.shape[-1]:
                own = own[: own.shape[-1] // 2] ^ own[own.shape[-1] // 2 :]
            while y.shape[-1] > own.shape[-1]:
                y = y[:, : y.shape[-1] // 2] ^ y[:, y.shape[-1] // 2 :]
            ok[part] = np.bitwise_count(y ^ own).sum(axis=1) + alone + where[part, 3] <= most[part]
        return ok


def _crossed(key: np.ndarray, size: np.ndarray, label: np.ndarray, percent: int, sketches: Sketches) -> list:
    """All pairs of one shingle's postings with different labels that can link."""
    found = []
    if (label != label[0]).any():
        for i in range(len(key) - 1):
            other = key[i + 1 :][(label[i + 1 :] != label[i]) & _fits(size[i], size[i + 1 :], percent)]
            if len(other):
                other = other[sketches.possible(int(key[i]), other)]
                found.append(np.stack([np.full(len(other), key[i]), other], 1))
    return found


def _distinct(found: list) -> np.ndarray:
    """Pairs once each, the lesser key first."""
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.empty((0, 2), np.int64)


_ROUNDS = ("stars", "crossed")


#: A third kind of row: sketches of the sets whose postings go to a bucket.
SKETCHES = 2
_SKETCH = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("bits", pa.binary())])


def _posts(n: int, percent: int, way: str, local_posts: int):
    """Postings of the rarest shingles of each representative, with its label; "stars": of a shingle with many here those with a hub are told as pairs at once (kind SETS), and hubs alone are posted; "crossed": sketches of the sets go with them."""

    def work(key, own, labels):
        label = dict(zip(labels.column("key").to_pylist(), labels.column("component").to_pylist(), strict=True))
        token, rows, sets_ = [], [], _opened(own)
        for k, (size, x, central) in sets_.items():
            p = prefix(size, len(x), percent)
            token.append(x[:p])
            rows.append(np.tile(np.array([k, size, label.get(k, k), -central], np.int64), (p, 1)))
        if not token:
            return _kinds([])
        token, rows = np.concatenate(token), np.concatenate(rows)
        out = []
        if way == "stars":
            o = np.lexsort((rows[:, 0], rows[:, 3], token))
            token, rows = token[o], rows[o]
            keep, found = np.ones(len(token), bool), []
            for a, b in _groups(token):
                if b - a > local_posts:
                    pairs, hubs = _stars(*rows[a:b, :3].T, percent)
                    found += pairs
                    keep[a:b] = hubs
            pair = _distinct(found)
            if len(pair):
                out.append((SETS, 0, pack(pa.table({"a": pair[:, 0], "b": pair[:, 1]}))))
            token, rows = token[keep], rows[keep]
        to = (mix(token) % np.uint64(n)).astype(np.int32)
        if way == "crossed":
            by_bucket: dict[int, list] = {}
            made = {}
            for b, k in np.unique(np.stack([to, rows[:, 0]], 1), axis=0).tolist():
                if k not in made:
                    made[k] = (k, sets_[k][0], len(sets_[k][1]), bitmap(sets_[k][1], sets_[k][0]).tobytes())
                by_bucket.setdefault(b, []).append(made[k])
            out += [(SKETCHES, b, pack(_rows(v, _SKETCH))) for b, v in by_bucket.items()]
        out += [(MEMBERS, b, x) for b, x in dealt({"token": token} | {c: rows[:, i] for i, c in enumerate(("key", "n", "label", "order"))}, to)]
        return _kinds(out)

    return work


def _paired(percent: int, way: str):
    """Candidate pairs of a bucket's postings."""

    def work(key, table):
        opened = [(k, unpack(b)) for k, b in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True)]
        got = [t for k, t in opened if k == MEMBERS]
        if way == "crossed":
            known = [[v for k, t in opened if k == SKETCHES for v in t.column(c).to_pylist()] for c in ("key", "n", "shared", "bits")]
            sketches = Sketches(*known[:3], [np.frombuffer(b, np.uint64) for b in known[3]], percent)
        token, keys, size, label, order = (np.concatenate([g.column(c).to_numpy() for g in got]) for c in ("token", "key", "n", "label", "order"))
        o = np.lexsort((keys, order, token))
        token, keys, size, label = token[o], keys[o], size[o], label[o]
        found = []
        for a, b in _groups(token):
            own = keys[a:b], size[a:b], label[a:b], percent
            found += _stars(*own)[0] if way == "stars" else _crossed(*own, sketches)
            if len(found) > 5000:
                found = [_distinct(found)]
        pair = _distinct(found)
        return pa.table({"a": pa.array(pair[:, 0], pa.int64()), "b": pa.array(pair[:, 1], pa.int64())})

    return work


_PART = pa.schema([("group", pa.int32()), ("fragment", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])


def _fragments(key, own, wanted):
    """Deal the sets to the buckets of their pairs, one fragment of the global order each."""
    cuts = {}
    for blob in own.column("blob").to_pylist():
        t = unpack(blob)
        cuts.update(zip(t.column("key").to_pylist(), t.column("cuts").to_pylist(), strict=True))
    have, parts, out = _opened(own), {}, []
    for k, g in zip(wanted.column("key").to_pylist(), wanted.column("group").to_pylist(), strict=True):
        size, x, _ = have[k]
        if k not in parts:
            parts[k] = [np.sort(part).tobytes() for part in np.split(x, cuts[k])]
        out += [(g, f, k, size, part) for f, part in enumerate(parts[k])]
    return _rows(out, _PART)


def _overlaps(key, own, pairs):
    """Partial overlaps of a bucket's pairs within one fragment."""
    have = {k: (n, np.frombuffer(x, np.uint64)) for k, n, x in zip(*(own.column(c).to_pylist() for c in ("key", "n", "tokens")), strict=True)}
    rows = []
    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
        (na, x), (nb, y) = have[a], have[b]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        rows.append((a, b, na, nb, int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) else 0))
    return _rows(rows, pa.schema([(k, pa.int64()) for k in ("a", "b", "na", "nb", "common")]))


def _verified(reps: DataFrame, pairs: DataFrame, n: int, percent: int, fragments: int) -> DataFrame:
    """Links among candidate pairs: overlaps counted fragment by fragment and summed for each pair. Pairs are dealt by both ends, so a hub's go to many tasks."""
    group = F.pmod(F.xxhash64("a", "b"), F.lit(n)).cast("int")
    pairs = pairs.withColumn("group", group)
    home = lambda c: F.col(c).alias("key")
    ends = pairs.select(home("a"), "group").unionByName(pairs.select(home("b"), "group")).distinct()
    ends = ends.withColumn("bucket", _home(F.col("key"), n))
    parts = reps.groupBy("bucket").cogroup(ends.groupBy("bucket")).applyInArrow(_fragments, "group int, fragment int, key long, n long, tokens binary")
    each = pairs.withColumn("fragment", F.explode(F.array(*[F.lit(f) for f in range(fragments)])))
    counted = parts.groupBy("group", "fragment").cogroup(each.groupBy("group", "fragment")).applyInArrow(_overlaps, "a long, b long, na long, nb long, common long")
    total = counted.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return total.where((100 + percent) * F.col("common") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _home(key, n: int):
    """The bucket of a representative."""
    return F.pmod(key, F.lit(n)).cast("int")


def _unpacked(rows: DataFrame, schema: pa.Schema, ddl: str) -> DataFrame:
    def work(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                yield from unpack(blob).select(schema.names).to_batches()

    return rows.select("blob").mapInArrow(work, ddl)


def grouped(rows: DataFrame, width: int = WIDTH, percent: int = PERCENT, fragments: int = FRAGMENTS, block_text: int = BLOCK_TEXT, local_posts: int = LOCAL_POSTS) -> DataFrame:
    """Rows (key, doc_id, n, component) of keyed() documents: n shingles, and the least key that links reach.

    1. Shingles' document frequencies are counted over all documents; the global order is by frequency, then hash. A
       document of whose set less than the threshold is shared with any other cannot link and is done with.
    2. Equal sets are one representative from here on: copies of a block follow the block's first, which follows the least
       of all blocks.
    3. Of each representative the rarest shingles that any linked set must share one of are posted. In a first round each
       posting is paired with its shingle's most central one alone (the one whose shingles are the most frequent); in a
       second all postings of a shingle that are not yet in one component are paired, but for those whose bitmaps rule a
       link out. So no link is lost, and a large group of copies still makes few pairs.
    4. Pairs are verified by vertical partitioning: the global order is cut into fragments of about as many postings each,
       a task counts a bucket of pairs' overlaps in one fragment, and the parts are summed for each pair.

    Texts are read once and kept as blocks until the sets are made.
    """
    spark = rows.sparkSession
    n = buckets(spark)
    early = Scope()
    with early.active():
        blocks = stored(_blocks(rows, _texts, block_text), "texts")
        kinds = stored(blocks.mapInArrow(_frequencies(n, width), _ROWS).groupBy("bucket").applyInArrow(_classes, _ROWS), "classes")
    postings = np.zeros(256, np.int64)
    for r in kinds.where("block = -1").select("blob").toLocalIterator():
        postings += unpack(bytes(r[0])).column("postings").to_numpy()
    ordered = _ordered(n, width, percent, pivots(postings, fragments))
    first = stored(blocks.groupBy("block").cogroup(kinds.where("block >= 0").groupBy("block")).applyInArrow(ordered, _KINDS), "sets")
    early.close()
    second = first.where(F.col("kind") == SETS).groupBy("bucket").applyInArrow(_representatives(n), _KINDS)
    second = stored(second, "representatives")
    ddl = "key long, doc_id long, n long, rep long"
    early, members = (_unpacked(x.where(F.col("kind") == MEMBERS), _MEMBERS, ddl) for x in (first, second))
    reps = second.where(F.col("kind") == SETS).select("bucket", "blob")
    labels = spark.createDataFrame([], "key long, component long")
    links = None
    for way in _ROUNDS:
        mine = labels.withColumn("bucket", _home(F.col("key"), n))
        posts = stored(reps.groupBy("bucket").cogroup(mine.groupBy("bucket")).applyInArrow(_posts(n, percent, way, local_posts), _KINDS), "posts")
        pairs = posts.where(F.col("kind") != SETS).groupBy("bucket").applyInArrow(_paired(percent, way), "a long, b long")
        if way == "stars":
            pairs = pairs.unionByName(_unpacked(posts.where(F.col("kind") == SETS), pa.schema([("a", pa.int64()), ("b", pa.int64())]), "a long, b long"))
        found = cut(_verified(reps, cut(pairs.distinct()), n, percent, fragments))
        if links is None:
            links = found
        elif found.take(1):
            links = links.unionByName(found)
        else:
            continue
        labels = components(links)
    full = members.join(labels.select(F.col("key").alias("rep"), "component"), "rep", "left")
    full = full.select("key", "doc_id", "n", F.coalesce("component", "rep").alias("component"))
    alone = early.where("key = rep").withColumnRenamed("rep", "component")
    copies = early.where("key <> rep").join(full.select(F.col("key").alias("rep"), "component"), "rep").select(*full.columns)
    return full.unionByName(alone).unionByName(copies)


def joined(docs: DataFrame, **options) -> DataFrame:
    """Rows doc_id, n_shingles, component_id for each document.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A document with fewer words than a shingle
    has its whole sequence as one; one without words (a null or empty text) is linked with nothing. Documents of one id
    are nodes of their own, ordered by text; null ids come first in order. Equal documents are linked. An empty table
    gives no rows. Other columns are not read.
    """
    out = cut(grouped(keyed(docs), **options))
    ids = out.select(F.col("key").alias("component"), F.col("doc_id").alias("component_id"))
    return out.join(ids, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents whose shingle sets are alike."""
    return joined(documents(spark, sf_dir))


def links_sql(width: int = WIDTH, percent: int = PERCENT) -> str:
    """Tables in DuckDB SQL: w (doc_id and words), d (each set's size and digest), r (its first document), and l, the links between these by comparing all pairs."""
    return f"""
        w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {width} THEN list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
        d AS (SELECT doc_id, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS d FROM s GROUP BY doc_id),
        r AS (SELECT d, min(doc_id) AS rep, any_value(n) AS n FROM d GROUP BY d),
        t AS (SELECT s.doc_id, s.sh, r.n FROM s JOIN r ON s.doc_id = r.rep),
        l AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE AS jaccard FROM t a JOIN t b ON a.sh = b.sh AND a.doc_id < b.doc_id
            GROUP BY 1, 2 HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*)))"""


def oracle() -> str:
    """The rows of op6_ngram_join in DuckDB SQL, following all links."""
    return f"""
        WITH RECURSIVE {links_sql()},
        two AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        reach AS (SELECT rep AS x, rep AS root FROM r UNION SELECT two.y, reach.root FROM reach JOIN two USING (x)),
        c AS (SELECT x, min(root) AS root FROM reach GROUP BY x)
        SELECT w.doc_id, coalesce(d.n, 0) AS n_shingles, coalesce(c.root, w.doc_id) AS component_id
        FROM w LEFT JOIN d USING (doc_id) LEFT JOIN r ON r.d = d.d LEFT JOIN c ON c.x = r.rep
    """
