"""Licences, token counts, quality rules, toxicity and fingerprints."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from chunkmill.llm import fingerprints, license_texts, licenses, quality, token_counts, toxicity
from chunkmill.llm.common import hashed_words, shingled
from chunkmill.llm.tokenizing import vocabulary

from .conftest import corpus, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def test_hashed_words_are_words():
    texts = [(t or "").encode() for _, t, _, _ in corpus()]
    h, n = hashed_words(texts)
    flat = [w.lower() for t in texts for w in t.split()]
    assert n.tolist() == [len(t.split()) for t in texts] and len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
    s, m = shingled(texts)
    assert [len(set(x.tolist())) for x in np.split(s, np.cumsum(m)[:-1])] == [len(shingles(t.decode())) for t in texts]


def test_licences_are_found_in_any_dress(spark):
    mit, gpl = license_texts.LICENSES["MIT"], license_texts.LICENSES["GPL-3.0"]
    cases = [
        (1, mit, "MIT"), (2, "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + mit.upper().replace("\n", " \n "), "MIT"), (3, mit + " and more", None),
        (4, license_texts.LICENSES["ISC"].replace(",", ";"), "ISC"), (5, None, None), (6, "", None), (7, "Copyright 1999 X", None),
        (8, license_texts.LICENSES["Apache-2.0 notice"].replace("License", "Licence"), "Apache-2.0 notice"), (8, mit, "MIT"), (None, mit, "MIT"),
        (9, gpl, "GPL-3.0"), (10, "\r\n".join(" * " + x for x in gpl.split("\n")).replace("license", "licence").replace("program ", "programme "), "GPL-3.0"),
        (11, gpl.replace("program", "programmer"), None), (12, license_texts.LICENSES["Apache-2.0"].upper(), "Apache-2.0"), (13, license_texts.LICENSES["MPL-2.0"], "MPL-2.0"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")
    got = licenses.scan(df)
    assert rows(got, "doc_id", "license_id") == sorted(((c[0], c[2]) for c in cases), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [c[:2] for c in cases])
    assert sorted(con.execute(licenses.oracle()).fetchall(), key=repr) == rows(got, "doc_id", "digest", "license_id")


def test_licence_scan_of_odd_tables(docs, none):
    assert licenses.scan(none).count() == 0 and licenses.scan(docs).count() == docs.count()


def greedy(word, begin, go_on):
    at, n = next((e for e in range(len(word), -1, -1) if word[:e] in begin), -1), 1
    while 0 <= at < len(word):
        at, n = next((e for e in range(len(word), at, -1) if word[at:e] in go_on), -1), n + 1
    return n if at >= 0 else 1


def test_automaton_counts_as_greedy_matching_does():
    for seed in range(60):
        r = random.Random(seed)
        pieces = [{bytes(r.choice(b"abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))} for _ in range(2)]
        if seed % 3 == 0:
            pieces[0].add(b"")  # the blank alone
        a = token_counts.Automaton(*pieces)
        for _ in range(60):
            w = bytes(r.choice(b"abc") for _ in range(r.randint(1, 12)))
            assert a.count(w) == greedy(w, *pieces)


def test_token_counts(docs, none):
    begin, go_on = token_counts.pieces(vocabulary("byte_bpe_50k.json"))
    long = token_counts.automaton(vocabulary("byte_bpe_50k.json")).count("你好世界".encode())
    assert long == greedy("你好世界".encode(), begin, go_on) > 4
    known = {}
    count = lambda t: sum(known.setdefault(w, greedy(w, begin, go_on)) for w in (t or "").encode().split())
    want = sorted(((i, len((t or "").encode().split()), count(t)) for i, t, _, _ in corpus()), key=repr)
    assert rows(token_counts.count_tokens(docs)) == want == rows(token_counts.count_tokens(docs, limit=10))
    assert token_counts.count_tokens(none).count() == 0


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_measures_and_base_rule(docs, none):
    got = quality.judged(docs)
    m = [got["_m"][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    want = [(i, *measured(t)) for i, t, _, _ in corpus()]
    assert rows(got, "doc_id", *m, "base_failed") == sorted(((*w, w[1] < 10 or 100 * w[5] > 20 * w[1]) for w in want), key=repr)
    assert not [r for r in got.select("base_failed", "kept").collect() if r["base_failed"] and r["kept"]]
    assert quality.judged(none).count() == 0


def test_thresholds_follow_their_group(spark):
    rng = random.Random(1)
    clean = [(i, prose(rng, 60), "en", "a") for i in range(300)]
    noisy = [(1000 + i, prose(rng, 60).replace(" ", "# "), "xx", "b") for i in range(300)]
    odd = [(2000, prose(rng, 60).replace(" ", "### "), "en", "a"), (2001, prose(rng, 60), "en", None), (2002, prose(rng, 60).replace(" ", "# "), "en", "few")]
    got = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(clean + noisy + odd, "doc_id long, text string, lang string, source string")).select("doc_id", "kept").collect()}
    assert all(got[c[0]] for c in clean + noisy) and not got[2000] and got[2001] and not got[2002]


def test_filtered_keeps_columns(docs):
    out = quality.filtered(docs)
    assert out.columns == docs.columns and out.count() == quality.judged(docs).where("kept").count()
    clash = docs.selectExpr("*", "lang AS _lang", "source AS _source", "1 AS _b", "2 AS _r", "3 AS _m", "true AS kept")
    assert quality.filtered(clash).count() == out.count() and {"_lang", "_source", "_b", "_r"} <= {*quality.judged(clash).columns}
    assert rows(quality.filtered(clash), "_m", "kept")[0] == (3, True)


@pytest.fixture
def graded():
    rng = random.Random(2)
    bad = {1: ["meh", "poor"], 2: ["nasty", "ugly"], 3: ["vile", "hateful"]}
    out = []
    for i in range(1200):
        g = rng.choice([0, 0, 0, 1, 2, 3])
        w = prose(rng, 40).split()
        for _ in range(4 if g else 0):
            w[rng.randrange(40)] = rng.choice(bad[g])
        out.append((i, " ".join(w), g))
    return out


def test_ordinal_model_on_held_out_grades(spark, graded):
    df = spark.createDataFrame(graded, "doc_id long, text string, grade int")
    model = toxicity.train(df, df, "grade", held_out=1)
    assert model.grades == [0, 1, 2, 3] and list(model.cuts) == sorted(model.cuts)
    from pyspark.sql import functions as F

    test = df.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) < 1)
    got = toxicity.predict(test, model).join(test.select("doc_id", "grade"), "doc_id").collect()
    assert len(got) > 150
    assert np.mean([r["toxic"] == (r["grade"] > 0) for r in got]) > 0.97
    assert np.corrcoef([r["expected_severity"] for r in got], [r["grade"] for r in got])[0, 1] > 0.85
    p = model.probabilities(np.linspace(-5, 5, 7))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()


def test_fit_agrees_with_plain_gradient_descent():
    rng = np.random.default_rng(3)
    n, k, l1 = 120, 6, 1e-3
    x = rng.random((n, k)) < 0.4
    grades = np.clip((x @ np.array([1.5, -1, 0.8, 0, 0, 2]) + rng.logistic(size=n)).round(), 0, 3).astype(np.int64)
    counts = x.sum(axis=1)
    model = toxicity.fit(np.nonzero(x)[1].astype(np.int32), counts, grades, l1=l1, steps=4000, least_docs=1)
    levels = np.unique(grades)
    y, w, cuts = np.searchsorted(levels, grades), np.zeros(k), np.linspace(-1, 1, len(levels) - 1)

    def loss(w, cuts):
        up = np.hstack([np.zeros((n, 1)), 1 / (1 + np.exp(-(cuts[None, :] - (x @ w)[:, None]))), np.ones((n, 1))])
        return -np.log(np.diff(up)[np.arange(n), y]).mean() + l1 * np.abs(w).sum()

    for _ in range(3000):  # by differences
        at = np.concatenate([w, cuts])
        g = np.array([(loss(*np.split(at + e, [k])) - loss(*np.split(at - e, [k]))) / 2e-5 for e in 1e-5 * np.eye(len(at))])
        w, cuts = np.split(at - 0.5 * g, [k])
    assert model.grades == levels.tolist() and (np.diff(model.cuts) > 0).all()
    assert loss(model.weights[:k].astype(float), model.cuts) < loss(w, cuts) + 2e-3
    assert np.allclose(model.weights[:k], w, atol=0.12) and np.allclose(model.cuts, cuts, atol=0.12)


def test_one_row_of_an_id_is_fitted(monkeypatch, spark, graded):
    df = spark.createDataFrame(graded[:200], "doc_id long, text string, grade int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda s, n, g: seen.append(sorted(n.tolist())))
    toxicity.train(df, df, "grade", sample_docs=20)
    toxicity.train(df.crossJoin(spark.range(50)), df.unionByName(df), "grade", sample_docs=20)
    assert len(seen[0]) == 20 and seen[0] == seen[1]


def test_toxicity_of_odd_tables(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.predict(docs, toxicity.train(docs, labels)).count() == docs.count()
    assert toxicity.predict(none, toxicity.train(none, labels)).count() == 0
    alone = toxicity.train(docs, labels.where("toxic = 1"))
    assert {r["severity"] for r in toxicity.predict(docs, alone).collect()} == {1}


def test_fingerprints(docs, none):
    want = sorted(((i, t or "") for i, t, _, _ in corpus()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    got = sorted((tuple(r) for r in fingerprints.fingerprint_edits(docs).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(got) == len(want)
    by_key = Counter((r[0], r[1], r[2]) for r in got)
    errors, prints = [], {}
    for k, (i, t) in enumerate(want):
        after = want[(k + 1) % len(want)][1]
        new = fingerprints.edited(t, after)
        assert by_key[i, len(t), hashlib.sha256(new.encode()).hexdigest()]
        row = next(r for r in got if (r[0], r[1], r[2]) == (i, len(t), hashlib.sha256(new.encode()).hexdigest()))
        same = sum(row[3][k : k + 4] == row[4][k : k + 4] for k in range(0, len(row[3]), 4))
        assert row[5] == same / fingerprints.PERMUTATIONS
        assert prints.setdefault(t, row[3]) == row[3] and prints.setdefault(new, row[4]) == row[4]
        for other, near in ((new, row[5]), (after, row[6])):
            a, b = shingles(t), shingles(other)
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1))
    assert np.abs(errors).max() < 0.25 and np.std(errors) < 0.06
    assert fingerprints.fingerprint_edits(none).count() == 0


def test_near_duplicates_are_verified(unique):
    texts = {r["doc_id"]: r["text"] for r in unique.collect()}
    for a, b, j in rows(fingerprints.near_duplicates(unique)):
        x, y = shingles(texts[a]), shingles(texts[b])
        assert abs(j - len(x & y) / len(x | y)) < 1e-9 and j >= 0.8


def test_near_duplicates_are_all_pairs_and_copies(monkeypatch, spark):
    monkeypatch.setattr(fingerprints, "SLICE", 3)
    rng = random.Random(8)
    base = [rng.choice("abcdefgh") + str(i) for i in range(400)]
    texts = []
    for i in range(12):
        w = list(base)
        for j in range(4 if i < 8 else 7):
            w[(i * 31 + j * 57) % 400] = f"new{i}x{j}"
        texts.append(" ".join(w))
    docs = [*enumerate(texts), (20, texts[3]), (21, texts[3]), (None, texts[5]), (None, texts[5].upper()), (2, "another text of an id that is there twice"), (30, None)]
    ordered = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want, first = [], {}
    for i, t in ordered:
        s = frozenset(shingles(t))
        if s and s in first:
            want.append((first[s], i, 1.0))
        elif s:
            want += [(j, i, len(s & x) / len(s | x)) for x, j in first.items() if len(s & x) >= 0.8 * len(s | x)]
            first[s] = i
    assert len(want) > 30
    got = rows(fingerprints.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)))
    rounded = lambda x: sorted(((a, b, round(j, 9)) for a, b, j in x), key=repr)
    assert rounded(got) == rounded(want)
