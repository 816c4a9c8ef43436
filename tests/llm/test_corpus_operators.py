"""Mixing, language-model scoring, suffix dedup, Jaccard join, packing, and the pipeline of them."""

import hashlib
import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from chunkmill.llm import lm_scoring, mixing, ngram_join, packing, quality, suffix_dedup
from chunkmill.llm.common import checkpoint_dir, scope
from chunkmill.llm.components import components
from chunkmill.llm.deep_shallow import sort_suffixes
from chunkmill.llm.elias_fano import EliasFano, Trie, mapped
from chunkmill.llm.tokenizing import CachedTokenizer, vocabulary

from .conftest import corpus, rows
from .test_text_operators import shingles

ORDER = lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())


def want_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / max(sum(weight[s] for s in free), 1e-9)
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            return capped | {s: weight[s] * level for s in free}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_targets(spark):
    for sizes in ({"a": 100, "b": 5, "c": 50, None: 7}, {"x": 10}, {f"s{i:02}": (i * 37) % 91 for i in range(20)}, {"a": 0, "b": 0}):
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = want_targets(sizes)
        assert {r["source"]: pytest.approx(r["target"]) for r in got} == want


def test_mix(spark, docs, none):
    for rows_ in (5, 1000):
        got = mixing.copies(docs, group_rows=rows_, fan_in=2).collect()
        again = mixing.copies(docs.repartition(5), group_rows=rows_, fan_in=2).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == docs.count()
        largest = {}
        taken, target = Counter(), {}
        for r in got:
            assert 0 <= r["n_copies"] <= 3
            taken[r["source"]] += r["n_copies"] * r["size"]
            target[r["source"]] = r["target"]
            largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
        assert all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in target)
    assert mixing.copies(none).count() == 0
    docs = docs.selectExpr("*", "doc_id + 1 AS col", "1 AS d", "2 AS rows")
    mix = mixing.mix_documents(docs, group_rows=5)
    assert all(r["col"] == r["doc_id"] + 1 for r in mix.where("doc_id is not null").collect())
    assert mix.columns == docs.columns and mix.count() == sum(r["n_copies"] for r in mixing.copies(docs, group_rows=5).collect())


def test_pivotal_step_keeps_mass_and_mean():
    rng = np.random.default_rng(0)
    for p, s, q, t in ((0.3, 10, 0.8, 3), (0.5, 4, 0.5, 4), (0.9, 1, 0.2, 100)):
        out = [mixing._pair(p, s, q, t, u) for u in rng.random(20_000)]
        assert all(abs(a * s + b * t - p * s - q * t) < 1e-9 and (a in (0, 1) or b in (0, 1)) for a, b in out)
        assert abs(np.mean([a for a, _ in out]) - p) < 0.015


def test_elias_fano_and_trie():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 5), (1000, 10), (150_000, 1 << 44), (70_000, 70_001)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e = EliasFano.build(v)
        q = np.sort(rng.integers(0, top, 500, dtype=np.uint64))
        at, equal = e.successors(q)
        assert (e.values() == v).all() and (at == np.searchsorted(v, q)).all() and (equal == np.isin(q, v)).all()
        some = np.flatnonzero(rng.random(n) < 0.3)
        assert (e.at(some) == v[some]).all()


def test_trie_finds_what_it_holds_and_nothing_else():
    rng = np.random.default_rng(2)
    pairs = np.unique(np.stack([rng.choice([5, 9, 40, 1 << 40], 400), rng.integers(0, 300, 400) << 7], 1), axis=0).astype(np.uint64)
    held, context, word = rng.random(len(pairs)) < 0.5, *pairs.T
    held &= context != 40
    own = np.array([3, 5, 7, 9, 1 << 40, 1 << 41], np.uint64)  # the first, the third and the last have no successors
    first = np.searchsorted(context[held], [*own, 1 << 60])
    codes = rng.integers(1, 256, held.sum()).astype(np.uint8)
    trie, folder = mapped(Trie.build(own, first, word[held], codes, np.array([9, 1, 9, 2, 3, 9], np.uint8)))
    asked, n = np.unique(context, return_counts=True)
    found, weights = trie.lookup(asked, n, word)
    want = np.zeros(len(pairs), np.uint8)
    want[held] = codes
    assert found.tolist() == want.tolist() and weights.tolist() == [1, 2, 0, 3]
    del trie
    folder.cleanup()
    nothing = Trie.build(own[:0], np.zeros(1, np.int64), word[:0], codes[:0], codes[:0])
    assert [x.tolist() for x in nothing.lookup(asked, n, word)] == [[0] * len(pairs), [0] * 4]


def quantum(p):
    """A probability as the trie keeps it."""
    return 10 ** -(min(math.ceil(-math.log10(p) * 32 - 1e-9), 254) / 32) if p else 0.0


def want_scores(order):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    every = [(i, [*(t or "").encode().lower().split(), 0]) for i, t, _, _ in corpus()]
    one, many = Counter(), Counter()
    for i, toks in every:
        if not held(i):
            one.update(toks)
            many.update(tuple([1, *toks][max(0, j - k) : j + 1]) for j in range(len(toks) + 1) for k in range(order) if j - k >= 0)
    n, v = sum(one.values()), len(one)

    def p(gram):
        if len(gram) == 1:
            return (one[gram[0]] + 1) / (n + v + 1)
        if not (total := many[gram[:-1]]):
            return p(gram[1:])
        prior = total**0.75
        return quantum(many[gram] / (total + prior)) + quantum(prior / (total + prior)) * p(gram[1:])

    for i, toks in every:
        low = [(one[w] + 1) / (n + v + 1) for w in toks]
        high = [p(tuple([1, *toks][max(0, j + 2 - order) : j + 2])) for j in range(len(toks))]
        yield i, held(i), len(toks), sum(one[w] > 0 for w in toks), n, sum(map(math.log10, low)), sum(map(math.log10, high))


@pytest.mark.parametrize("order,options", [(3, {}), (3, {"block_text": 20_000, "split": 1000.0}), (3, {"block_text": 2_000}), (2, {}), (4, {"block_text": 50_000, "split": 0.01})])
def test_scores_do_not_depend_on_how_work_is_dealt(spark, docs, order, options):
    key = lambda r: (r[0] is not None, r[0] or 0, round(r[5], 6))
    want = sorted(want_scores(order), key=key)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("2", "4", "13") if options else ("5",):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got = sorted((tuple(r) for r in lm_scoring.score(docs, lm_scoring.held_out(), order, **options).collect()), key=key)
            for a, b in zip(got, want, strict=True):
                assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-9, rel=1e-9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_block_keeps_its_places_in_32_bits():
    texts = [b"a b a b c " * 50, b"", b"a c " * 70]
    x = lm_scoring.Block.of([1, 2, 3], [False, True, False], texts)
    for block in (x, lm_scoring.Block.opened(x.packed())):
        assert block.index.dtype.itemsize == 4 and block.index.tolist() == x.index.tolist()
        for g in lm_scoring.grams(block, 3):
            assert all(a.dtype.itemsize == 4 for a in (g.context, g.word, g.token, g.at))


def test_scores_of_odd_tables(docs, none):
    assert lm_scoring.score(none, lm_scoring.held_out()).count() == 0
    base = lm_scoring.score(docs, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["score"] == pytest.approx(r["base_score"]) for r in base)


def test_suffixes_are_sorted():
    import random

    for seed in range(60):
        r = random.Random(seed)
        b = bytearray(r.randrange(r.choice([1, 2, 20])) for _ in range(r.randint(120, 500)))
        i, j = (r.randrange(len(b) - 50) for _ in range(2))
        b[j : j + 50] = b[i : i + 50]
        b, d = bytes(b), r.choice([5, 8, 24, 25, 100])
        starts = np.arange(len(b) - d + 1)
        order, fresh = sort_suffixes(np.frombuffer(b, np.uint8), starts, d)
        want = sorted(starts.tolist(), key=lambda p: (b[p : p + d], p))
        assert order.tolist() == want and fresh.tolist() == [k == 0 or b[p : p + d] != b[want[k - 1] : want[k - 1] + d] for k, p in enumerate(want)]


def removed(rows_, length=100):
    seen, out = set(), []
    for i, t in sorted(rows_, key=ORDER):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if (w := b[p : p + length]) in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), len(b) - len(kept), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("limits", [(64, 2000), (1, 2)])
def test_repeated_bytes_go(monkeypatch, docs, none, limits):
    monkeypatch.setattr(suffix_dedup, "HOT_LOCAL", limits[0])
    monkeypatch.setattr(suffix_dedup, "HOT_TOTAL", limits[1])
    monkeypatch.setattr(suffix_dedup, "COMBINE_BYTES", 3000)
    assert rows(suffix_dedup.removed(docs)) == sorted((r[:5] for r in removed([c[:2] for c in corpus()])), key=repr)
    assert suffix_dedup.removed(none).count() == 0


def linked(rows_):
    """(doc_id, shingles, component's id, whether it is the component's first) by comparing all pairs."""
    rows_ = sorted(rows_, key=ORDER)
    sets = [shingles(t) for _, t in rows_]
    root = list(range(len(rows_)))
    for i in range(len(rows_)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return [(i, len(s), rows_[r][0], r == k) for k, ((i, _), s, r) in enumerate(zip(rows_, sets, root, strict=True))]


def test_jaccard_components(docs, none):
    want = sorted((r[:3] for r in linked([c[:2] for c in corpus()])), key=repr)
    for fragments in (1, 2, 3, 5):
        assert rows(ngram_join.joined(docs, fragments=fragments, block_text=5000 * fragments, local_posts=3)) == want
    assert ngram_join.joined(none).count() == 0


def test_fragments_are_ranges_of_the_global_order():
    rng = np.random.default_rng(6)
    kind, x = rng.choice([1, 8, 8, 8, 20, 255], 20_000).astype(np.uint8), rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    at = ngram_join.place(kind, x)
    assert (np.argsort(at, kind="stable") == np.lexsort((x >> np.uint64(8), kind))).all()
    for n in (1, 2, 3, 5, 8):
        cuts = ngram_join.pivots(np.bincount(kind, minlength=256), n)
        share = np.bincount(np.searchsorted(cuts, at, "right"), minlength=n) / len(x)
        assert len(cuts) == n - 1 and abs(share - 1 / n).max() < 0.02
    assert ngram_join.pivots(np.zeros(256, np.int64), 4).tolist() == [0, 0, 0]


def test_copies_of_a_block_follow_a_lesser_one_of_another(spark):
    base = corpus()[0][1]
    near = base.split(" ")
    near[-1] = "changed"
    both = [(5, base), (6, base), (9, " ".join(near)), (1, base), (0, " ".join(near)), (2, "other words alone in here")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(both, 2), "doc_id long, text string")
    assert rows(ngram_join.joined(docs)) == sorted((r[:3] for r in linked(both)), key=repr)
    copies = docs.where(F.col("doc_id").isin(1, 5, 6))
    assert rows(ngram_join.joined(copies), "doc_id", "component_id") == [(1, 1), (5, 1), (6, 1)]


def test_bitmaps_rule_out_no_link():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(5, 400))
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        gone = int(rng.integers(0, n // 8 + 1))
        y = np.unique(np.concatenate([x[gone:], rng.integers(0, 1 << 63, gone // 2, dtype=np.uint64)]))
        x = np.unique(x)
        if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)):
            s = ngram_join.Sketches([1, 2], [len(x), len(y)], [len(x), len(y)], [ngram_join.bitmap(x, len(x)), ngram_join.bitmap(y, len(y))], 80)
            assert s.possible(1, np.array([2])).all()


def test_components_of_a_long_chain(spark):
    n = 40
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 102), (101, 102)], "a long, b long")
    got = dict(rows(components(links)))
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100, 102: 100}


def test_cached_tokenizer_agrees_with_whole_texts():
    for limit in (700_000, 20):
        cache = CachedTokenizer(vocabulary("word_bpe_49k.json"), limit)
        texts = [t for _, t, _, _ in corpus() if t] + ["The end. of’s DON'T can't, don't. <|endoftext|> a<|ENDOFTEXT|>, é. İ. ß. ΣΑΣ. ... 5.5, —."]
        got = [x.tolist() for x in cache.encode([t.encode() for t in texts])]
        assert got == [cache.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def packed(got, texts):
    """Check that pieces are whole documents and sequences; how many ids are padding."""
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in {*texts}}
    by_crc = Counter((len(x), zlib.crc32(x.tobytes())) for x in (ids[t] for t in texts))
    whole = Counter()
    pieces = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    sequences = {}
    for r in pieces:
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
        whole[r["doc_tokens"]] += r["length"]
    lengths = Counter(n for n, _ in by_crc.elements())
    assert whole == Counter({n: n * k for n, k in lengths.items()})
    same_size = {}
    for x in ids.values():
        same_size.setdefault(len(x), []).append(x)
    cover = {}
    for r in got:
        cover.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["start"] + r["length"]))
        assert r["ids_crc32"] in {zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) for x in same_size[r["doc_tokens"]]}
    for (_, n), parts in cover.items():  # each id lies in exactly one piece of each document
        step = np.zeros(n + 1, np.int64)
        for a, b in parts:
            step[a] += 1
            step[b] -= 1
        assert len({*np.cumsum(step)[:-1].tolist()}) == 1 and step.sum() == 0
    assert max(sequences.values(), default=0) <= 4096
    return sum(4096 - n for n in sequences.values() if n & (n - 1))


def test_packing(docs, none):
    texts = [t for _, t, _, _ in corpus()]
    for tokens in (3000, 1 << 21):
        got = packing.pack_documents(docs, group_tokens=tokens, with_ids=True).collect()
        assert packed(got, texts) == 0
        assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    by_step = Counter((r["step_group"], r["tier"]) for r in got)
    assert len({s for s, _ in by_step}) == len(by_step)
    assert packing.pack_documents(none).count() == 0


def test_stages_against_brute_force(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    kept = stages["quality rules"](spark, table, str(tmp_path))
    assert rows(kept, "doc_id", "text") == rows(quality.judged(table).where("kept"), "doc_id", "text")
    one = stages["n-gram Jaccard join"](spark, table, str(tmp_path))
    ordered = sorted((c[:2] for c in corpus()), key=ORDER)
    assert rows(one, "doc_id", "text") == sorted((r for r, k in zip(ordered, linked(ordered), strict=True) if k[3]), key=repr)
    cut = stages["suffix-array dedup"](spark, table, str(tmp_path))
    want = [(r[0], r[5].decode(errors="ignore") if r[2] else t) for r, (_, t) in zip(removed(ordered), ordered, strict=True)]
    assert rows(cut, "doc_id", "text") == sorted(want, key=repr)
    assert all(r["n_chars"] == len(r["text"] or "") for r in cut.collect())
    mix = stages["mixing sources to target weights"](spark, table, str(tmp_path))
    counts = Counter((r["doc_id"], r["text"]) for r in mix.select("doc_id", "text").collect())
    assert max(counts.values()) <= 9 and {k for k in counts} <= {*ordered}
    for out in (kept, one, cut, mix):
        assert out.columns == table.columns
    assert packed(stages["packing"](spark, table, str(tmp_path)).collect(), [t for _, t in ordered]) == 0


def test_runs_own_what_they_keep(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    kept = {*folder.rglob("*")}
    with scope():
        held = suffix_dedup.op5_suffix_dedup(spark, str(tmp_path))
        with scope():
            got = corpus_pipeline.run(spark, str(tmp_path))
            assert got.count() > 0 and {"doc_id", "start", "length", "sequence_id"} <= {*got.columns}
        assert held.count() == docs.count()
    corpus_pipeline.release()
    assert {*folder.rglob("*")} <= kept


def test_pipeline_of_nothing(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
