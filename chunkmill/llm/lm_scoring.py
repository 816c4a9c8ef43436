"""Language-model scoring with an Elias-Fano n-gram trie, in parts by ranges of contexts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, documents, hashed_words, in_blocks, mix, pack, small_batches, stored, unpack, whole
from .elias_fano import Trie, mapped

ORDER = 3
#: A context that came T times gives PRIOR_SCALE * T^PRIOR_POWER, about its number of different successors, to the order below.
PRIOR_SCALE, PRIOR_POWER = 1.0, 0.75
#: Text that a task counts together.
BLOCK_TEXT = 16 << 20
#: A context with over 1/SPLIT of a bucket's share of all tokens is dealt by successor over more buckets. It changes where a probability is computed, not its value.
SPLIT = 4
#: Bits of a context's and of a word's hash in the trie.
CONTEXT_BITS, WORD_BITS = 48, 40
#: Codes for each factor of ten; code 1 is probability 1, 0 is none. A probability is rounded down, so sums stay under 1.
STEPS = 32

#: Places of a block's tokens, words and n-grams, of which there are fewer than 2^31.
PLACE = np.int32

BEGIN, END = np.uint64(0x2B7E151628AED2A7), np.uint64(0x5D8F1C3A9B7E6421)


def quantised(p: np.ndarray) -> np.ndarray:
    """8-bit codes of probabilities (0: none)."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.ceil(-np.log10(p) * STEPS - 1e-9) + 1, 1, 255), 0).astype(np.uint8)


#: The probability of each code.
VALUES = np.concatenate([[0.0], 10.0 ** -(np.arange(255) / STEPS)])


def narrow(x: np.ndarray) -> np.ndarray:
    """Unsigned values in the fewest bytes that hold them all."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


@dataclass
class Block:
    """The tokens of some documents: `words`, their sorted distinct hashes and the beginning's, and `index`, each token's place in it."""

    doc_ids: list
    held: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    index: np.ndarray

    @classmethod
    def of(cls, doc_ids: list, held: list, texts: list[bytes]) -> Block:
        found = [hashed_words(texts[a:b]) for a, b in in_blocks(texts)]
        sizes = np.concatenate([f[1] for f in found]) + 1
        tokens = np.full(int(sizes.sum()) + 1, END, np.uint64)
        inner = np.ones(len(tokens), bool)
        inner[np.cumsum(sizes) - 1] = inner[-1] = False
        tokens[inner] = np.concatenate([f[0] for f in found])
        tokens[-1] = BEGIN
        words, index = np.unique(tokens, return_inverse=True)
        return cls(doc_ids, np.array(held, bool), sizes, words, index[:-1].astype(PLACE))

    def packed(self) -> bytes:
        """Words by frequency, so that most places are small, and places as planes of bytes."""
        o = np.argsort(-np.bincount(self.index, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(o), np.uint32)
        rank[o] = np.arange(len(o))
        planes = rank[self.index].view(np.uint8).reshape(-1, 4)
        parts = [pack(pa.table({"doc_id": pa.array(self.doc_ids, pa.int64()), "held": self.held, "size": self.sizes})), pack(pa.table({"word": self.words[o]}))]
        return b"".join(len(p).to_bytes(8, "little") + p for p in parts) + pack(pa.table({str(k): np.ascontiguousarray(planes[:, k]) for k in range(4)}))

    @classmethod
    def opened(cls, blob: bytes) -> Block:
        a = 8 + int.from_bytes(blob[:8], "little")
        b = a + 8 + int.from_bytes(blob[a : a + 8], "little")
        docs = unpack(blob[8:a])
        held = docs.column("held").to_numpy(zero_copy_only=False).astype(bool)
        words, planes = unpack(blob[a + 8 : b]).column("word").to_numpy(), unpack(blob[b:])
        place = np.stack([planes.column(str(k)).to_numpy() for k in range(4)], 1).view(np.uint32).ravel()
        o = np.argsort(words)
        rank = np.empty(len(o), PLACE)
        rank[o] = np.arange(len(o))
        return cls(docs.column("doc_id").to_pylist(), held, docs.column("size").to_numpy(), words[o], rank[place])

    @property
    def train(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes)


@dataclass
class Grams:
    """A block's distinct n-grams of one order, by context and word: places of the context among the order before and of the word among the words, a token that ends each, and for each token its n-gram (-1: the text has no such n-gram there)."""

    context: np.ndarray
    word: np.ndarray
    token: np.ndarray
    at: np.ndarray

    def counts(self, which: np.ndarray) -> np.ndarray:
        """How many of the tokens (a mask) each ends."""
        some = self.at[which]
        return np.bincount(some[some >= 0], minlength=len(self.word))


def grams(x: Block, order: int) -> list[Grams]:
    """The n-grams of orders 2 to order. The first token's context is the beginning; from order 3 on, an n-gram reaches back to the beginning at most."""
    first = np.cumsum(x.sizes) - x.sizes
    offset = np.arange(len(x.index), dtype=PLACE) - np.repeat(first.astype(PLACE), x.sizes)
    before, n, out = np.append(PLACE(0), x.index[:-1]), len(x.words), []
    before[first] = np.searchsorted(x.words, BEGIN)
    for k in range(2, order + 1):
        own = np.flatnonzero(offset >= k - 2)
        key = before[own].astype(np.int64) * n + x.index[own]
        o = np.argsort(key)
        key, own = key[o], own[o].astype(PLACE)
        del o
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
        at = np.full(len(x.index), -1, PLACE)
        at[own] = np.cumsum(new, dtype=PLACE) - PLACE(1)
        key = key[new]
        out.append(Grams((key // n).astype(PLACE), (key % n).astype(PLACE), own[new], at))
        before = np.append(PLACE(-1), at[:-1])
    return out


@dataclass
class Known:
    """What a block knows of its n-grams of one order: hashes, counts in training, how heavy they are (bits of their counts beyond 8), and which no other block has."""

    hashes: np.ndarray
    count: np.ndarray
    heavy: np.ndarray
    alone: np.ndarray


@dataclass
class Layout:
    """How a block's n-grams of one order go to the buckets: their places in the order of sending, the buckets, and where each bucket's begin."""

    rows: np.ndarray
    bucket: np.ndarray
    edges: np.ndarray


def layout(x: Block, g: Grams, below: Known, suffix: np.ndarray, n: int, share: float) -> Layout:
    """n-grams that other blocks may have too and whose context came in training, by bucket, context and word.

    An n-gram is this block's alone if its context or its suffix, places of the order below, is. A context is dealt by its
    hash, and a heavy one also by word, to so many buckets that each gets about `share` tokens of it at most.
    """
    rows = np.flatnonzero((below.count > 0)[g.context] & ~below.alone[g.context] & ~below.alone[suffix])
    own, word = g.context[rows], g.word[rows]
    home = (below.hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    parts = np.clip(np.exp2(below.heavy.astype(float) + 8) / max(share, 1), 1, n).astype(np.uint64)
    parts[below.heavy == 0] = 1
    part = (mix(x.words) >> np.uint64(32))[word] * parts[own] >> np.uint64(32)
    bucket = ((home[own] + part) % np.uint64(n)).astype(np.int64)
    rank = np.empty(len(home), np.int64)
    rank[np.argsort(below.hashes)] = np.arange(len(home))
    o = np.argsort((bucket * len(home) + rank[own]) * len(x.words) + word).astype(PLACE)
    found, first = np.unique(bucket[o], return_index=True)
    return Layout(rows[o].astype(PLACE), found, np.append(first, len(o)))


_ROWS = "bucket int, block long, blob binary"


def _batch(got: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary())], ["bucket", "block", "blob"])


def _tokenised(block_text: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of documents in compact form."""
        first, n = TaskContext.get().partitionId() << 24, 0
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if size and size + len(t.as_buffer()) > block_text:
                    yield _batch([(0, first + n, Block.of(ids, held, texts).packed())])
                    n, ids, held, texts, size = n + 1, [], [], [], 0
                ids.append(i)
                held.append(h)
                texts.append(t.as_py())
                size += len(texts[-1]) + 1
        if ids:
            yield _batch([(0, first + n, Block.of(ids, held, texts).packed())])

    return work


def _word_counts(n: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's words with their counts, in training and held out, to the buckets of their hashes."""
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                x = Block.opened(blob)
                count, every = (np.bincount(x.index[w], minlength=len(x.words)) for w in (x.train, slice(None)))
                begin = np.searchsorted(x.words, BEGIN)
                count[begin], every[begin] = (~x.held).sum(), len(x.held)
                bucket = ((x.words >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
                found, first = np.unique(bucket, return_index=True)
                yield _batch([(int(k), block, pack(pa.table({"step": np.diff(x.words[a:b], prepend=np.uint64(0)), "count": narrow(count[a:b]), "held": narrow((every - count)[a:b])}))) for k, a, b in zip(found, first, [*first[1:], len(bucket)], strict=True)])

    return work


def _heavy(every: np.ndarray) -> np.ndarray:
    """Bits of a count beyond 8."""
    return np.maximum(np.frexp(every.astype(float))[1] - 8, 0).astype(np.uint8)


def _count_words(key, table):
    """For each block the counts of its words; on block -1 the bucket's sums, without the beginning."""
    parts = [unpack(b) for b in table.column("blob").to_pylist()]
    words = [np.cumsum(p.column("step").to_numpy(), dtype=np.uint64) for p in parts]
    seen, where = np.unique(np.concatenate(words), return_inverse=True)
    count, held = (np.bincount(where, np.concatenate([p.column(c).to_numpy() for p in parts]), len(seen)).astype(np.int64) for c in ("count", "held"))
    edges = np.cumsum([0, *map(len, words)])
    bucket, real = key[0].as_py(), seen != BEGIN
    heavy = _heavy(count + held)
    alone = np.bincount(where) == 1
    out = [(bucket, block, pack(pa.table({"count": narrow(count[where[a:b]]), "heavy": heavy[where[a:b]], "alone": alone[where[a:b]].view(np.uint8)}))) for block, a, b in zip(table.column("block").to_pylist(), edges[:-1], edges[1:], strict=True)]
    sums = pa.table({"tokens": [int(count[real].sum())], "words": [int((count[real] > 0).sum())], "every": [int((count + held)[real].sum())]})
    return pa.Table.from_batches([_batch([*out, (bucket, -1, pack(sums))])])


class Answered:
    """A block with what the buckets have answered for the orders up to `answered`: `known` of each order, and `codes` of the n-grams from order 2 on (0: also those that the block has alone)."""

    def __init__(self, blob: bytes, answers: pa.Table, order: int, answered: int, n: int, share: float):
        self.x = Block.opened(blob)
        rows = sorted(zip(answers.column("level").to_pylist(), answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True))
        got: dict[int, list[tuple[int, bytes]]] = {}
        for k, bucket, b in rows:
            got.setdefault(k, []).append((bucket, b))
        del rows
        words = [unpack(b) for _, b in got.pop(1)]
        self.known = [Known(self.x.words, *(np.concatenate([t.column(c).to_numpy() for t in words]) for c in ("count", "heavy", "alone")))]
        self.known[0].alone = self.known[0].alone.astype(bool)
        self.grams = grams(self.x, order)
        self.layouts: list[Layout] = []
        self.codes: list[np.ndarray] = []
        at = self.x.index
        for k, g in enumerate(self.grams):
            context = self.known[k]
            lay = layout(self.x, g, context, at[g.token], n, share)
            self.layouts.append(lay)
            at = g.at
            if k + 2 <= answered:
                self._take(g, context, lay, got.pop(k + 2, []), last=k + 2 == order == answered)

    def _take(self, g: Grams, context: Known, lay: Layout, answers: list[tuple[int, bytes]], last: bool) -> None:
        if [b for b, _ in answers] != lay.bucket.tolist():
            raise RuntimeError("the answers to a block are not those that it asked for")
        tails = [unpack(b) for _, b in answers]
        answer = lambda c: np.concatenate([np.empty(0, np.uint8), *(t.column(c).to_numpy() for t in tails)])
        code = np.zeros(len(g.word), np.uint8)
        code[lay.rows] = answer("code")
        self.codes.append(code)
        if last:
            return
        hashes = mix(context.hashes[g.context] * np.uint64(0x9E3779B97F4A7C15) + self.x.words[g.word])
        count, alone = g.counts(self.x.train), np.ones(len(g.word), bool)
        heavy = _heavy(g.counts(slice(None)))
        count[lay.rows], heavy[lay.rows], alone[lay.rows] = answer("count"), answer("heavy"), answer("alone").astype(bool)
        self.known.append(Known(hashes, count, heavy, alone))

    def probabilities(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the n-grams at place k, their probabilities' first terms, and their contexts' weights: those that the block has alone, and all weights, from a trie of the block's own."""
        g, context, lay = self.grams[k], self.known[k], self.layouts[k]
        mine = np.ones(len(g.word), bool)
        mine[lay.rows] = False
        count = g.counts(self.x.train)
        held = mine & (count > 0)
        trie, folder = mapped(level(np.arange(len(context.count)), context.count, g.context[held], g.word[held].astype(np.uint64), count[held]))
        code, weight = trie.lookup(np.arange(len(context.count), dtype=np.uint64), np.bincount(g.context, minlength=len(context.count)), g.word.astype(np.uint64))
        code[lay.rows] = self.codes[k][lay.rows]
        del trie
        folder.cleanup()
        return VALUES[code], np.where(context.count > 0, VALUES[weight], 1.0)


def _ask(order: int, n: int, share: float):
    def work(key, kept, answers):
        """Each block's n-grams of the order to their buckets: contexts with their counts in training, and words with theirs."""
        out = []
        for block, blob in zip(kept.column("block").to_pylist(), kept.column("blob").to_pylist(), strict=True):
            a = Answered(blob, answers, order, order - 1, n, share)
            x, g, lay, context = a.x, a.grams[-1], a.layouts[-1], a.known[-1]
            count = g.counts(x.train)
            held = g.counts(slice(None)) - count
            short = context.hashes >> np.uint64(64 - CONTEXT_BITS)
            words = x.words >> np.uint64(64 - WORD_BITS)
            for bucket, i, j in zip(lay.bucket.tolist(), lay.edges[:-1], lay.edges[1:], strict=True):
                own = lay.rows[i:j]
                before, word = g.context[own], words[g.word[own]]
                first = np.flatnonzero(np.diff(before, prepend=-1))
                head = pack(pa.table({"step": np.diff(short[before[first]], prepend=np.uint64(0)), "total": narrow(context.count[before[first]]), "n": narrow(np.diff(first, append=len(own)))}))
                tail = {"high": (word >> np.uint64(8)).astype(np.uint32), "low": (word & np.uint64(255)).astype(np.uint8), "count": narrow(count[own])}
                out.append((bucket, block, len(head).to_bytes(8, "little") + head + pack(pa.table(tail | {"held": narrow(held[own])}))))
        return pa.Table.from_batches([_batch(out)])

    return work


def level(contexts: np.ndarray, totals: np.ndarray, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> Trie:
    """A trie of contexts, ascending, with their counts, and n-grams by their context's place and by word, all counted at least once."""
    totals = totals.astype(float)
    prior = PRIOR_SCALE * totals**PRIOR_POWER
    first = np.searchsorted(context, np.arange(len(contexts) + 1))
    weight = quantised(np.divide(prior, totals + prior, out=np.ones(len(totals)), where=totals > 0))
    return Trie.build(contexts, first, word, quantised(count / (totals + prior)[context]), weight)


def _answer(last: bool):
    def work(key, table):
        """Build this bucket's part of the trie and answer each block from it."""
        heads, tails = [], []
        for blob in table.column("blob").to_pylist():
            h = 8 + int.from_bytes(blob[:8], "little")
            heads.append(unpack(blob[8:h]))
            tails.append(unpack(blob[h:]))
        runs = [h.column("n").to_numpy().astype(np.int64) for h in heads]
        context = np.concatenate([np.repeat(np.cumsum(h.column("step").to_numpy(), dtype=np.uint64), r) for h, r in zip(heads, runs, strict=True)])
        total = np.concatenate([np.repeat(h.column("total").to_numpy(), r) for h, r in zip(heads, runs, strict=True)])
        whole_ = lambda c: np.concatenate([t.column(c).to_numpy() for t in tails])
        word = whole_("high").astype(np.uint64) << np.uint64(8) | whole_("low")
        o = np.lexsort((word, context))
        context, word = context[o], word[o]
        fresh = np.concatenate([[True], context[1:] != context[:-1]])
        first = np.flatnonzero(fresh | np.concatenate([[True], word[1:] != word[:-1]]))
        times = np.diff(first, append=len(o))
        count = np.add.reduceat(whole_("count")[o].astype(np.int64), first)
        held = np.add.reduceat(whole_("held")[o].astype(np.int64), first)
        word, fresh = word[first], np.flatnonzero(fresh[first])
        context, total, each = context[first][fresh], total[o][first][fresh], np.diff(fresh, append=len(first))
        some = count > 0
        trie, folder = mapped(level(context, total, np.repeat(np.arange(len(each)), each)[some], word[some], count[some]))
        code = _spread(trie.lookup(context, each, word)[0], times, o)
        if not last:
            count, heavy, alone = (_spread(v, times, o) for v in (count, _heavy(count + held), times == 1))
        out, at, bucket = [], 0, key[0].as_py()
        for block, run in zip(table.column("block").to_pylist(), runs, strict=True):
            own = slice(at, at := at + int(run.sum()))
            more = {} if last else {"count": narrow(count[own]), "heavy": heavy[own], "alone": alone[own].view(np.uint8)}
            out.append((bucket, block, pack(pa.table({"code": code[own]} | more))))
        del trie
        folder.cleanup()
        return pa.Table.from_batches([_batch(out)])

    return work


def _spread(values: np.ndarray, times: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Values of distinct n-grams, back in the order of asking."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, times)
    return out


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finished(order: int, n: int, share: float, tokens: int, words: int):
    def work(key, kept, answers):
        """Put a block's answers together: from each order's probability and weight to the next."""
        out = []
        for blob in kept.column("blob").to_pylist():
            a = Answered(blob, answers, order, order, n, share)
            x = a.x
            for known in a.known:  # asked with, not needed for the answer
                known.hashes = known.heavy = known.alone = np.empty(0)
            low = (a.known[0].count + 1) / (tokens + words + 1)
            p, at = low, x.index
            token = low[x.index]
            for k, g in enumerate(a.grams):
                seen, weight = a.probabilities(k)
                p = seen + weight[g.context] * p[at[g.token]]
                at = g.at
                token[at >= 0] = p[at[at >= 0]]
            edge = np.cumsum(x.sizes) - x.sizes
            out.append(pa.table({
                "doc_id": pa.array(x.doc_ids, pa.int64()), "held_out": x.held, "n_tokens": x.sizes, "n_known": np.add.reduceat((a.known[0].count > 0)[x.index].astype(np.int64), edge),
                "train_tokens": np.full(len(x.sizes), tokens, np.int64), "base_score": np.add.reduceat(np.log10(low)[x.index], edge), "score": np.add.reduceat(np.log10(token), edge),
            }))
        return pa.concat_tables(out)

    return work


def score(docs: DataFrame, held_out, order: int = ORDER, block_text: int = BLOCK_TEXT, split: float = SPLIT) -> DataFrame:
    """Score whole texts under an n-gram model of the documents for which the column held_out is false.

    p(w | context) = c(context, w) / (T + m) + m / (T + m) * p(w | context without its first word), where T is the
    context's count and m = PRIOR_SCALE * T^PRIOR_POWER; the lowest order is the base score's add-one p(w). A text begins
    with a mark of the beginning and ends with one end token. The first term and the weight are kept as 8-bit codes in a
    trie for each order, in parts by ranges of contexts.

    Texts are read once and kept as blocks of tokens. Order by order, each block sends its distinct n-grams, with its
    counts and with the contexts' counts that it got with the order before, to buckets, which sum, build their part of
    the trie and answer. What a block has alone, for its context or its suffix came in no other block, it keeps in a part
    of the trie of its own. A context's count is known before its successors are dealt, so a heavy context can be dealt over
    many buckets, and a value does not depend on how n-grams are dealt. No task holds the model, and none is broadcast.

    A null or empty text is its end token alone; a null doc_id stays null; a null held_out is false; repeated rows count
    and are scored each; an empty table gives no rows; with no training text the model is the base. Other columns are not
    read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = 2 * buckets(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), whole().cast("binary").alias("text"))
    blocks = stored(rows.mapInArrow(_tokenised(block_text), _ROWS), "tokens")
    words = stored(blocks.mapInArrow(_word_counts(n), _ROWS).groupBy("bucket").applyInArrow(_count_words, _ROWS), "words")
    sums = [unpack(bytes(r[0])).to_pylist()[0] for r in words.where("block = -1").select("blob").collect()]
    tokens, kinds, every = (sum(s[k] for s in sums) for k in ("tokens", "words", "every"))
    share = every / (split * n)
    answers = words.where("block >= 0").withColumn("level", F.lit(1))
    for k in range(2, order + 1):
        asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_ask(k, n, share), _ROWS)
        got = stored(asked.groupBy("bucket").applyInArrow(_answer(k == order), _ROWS), f"order{k}")
        answers = answers.unionByName(got.withColumn("level", F.lit(k)))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finished(order, n, share, tokens, kinds), OUT)


def held_out(modulus: int = 7, rest: int = 2):
    """Whether crc32 of the id as text leaves this rest."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % modulus == rest


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of six sevenths of them."""
    return score(documents(spark, sf_dir), held_out())
