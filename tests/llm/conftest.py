import random

import pytest

WORDS = "the of and to in a is that it for on with as was be by at this from or an are not have".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


def corpus() -> list[tuple]:
    """(doc_id, text, lang, source): prose with copies, near copies, shared passages, nulls, ties and odd texts."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    texts = list(base)
    for i in range(12):
        w = base[i].split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += base[:5] + [f"{prose(rng, 20)}\n{passage}\n{prose(rng, 15)}" for _ in range(6)]
    texts += [None, "", " \n\t ", "one two three", "ONE TWO three", "a b \x1c c", "line one here\n" * 30, "ab " * 400, "Ünïcödé straße " * 20, prose(rng, 20_000), "!!! ### $$$ %%%", "<|endoftext|> it's a test. İstanbul"]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(7, base[7], "en", "s3"), (7, "another text of the same id " * 8, "en", "s3"), (None, base[3], None, None), (None, None, None, None), (3, base[3], "de", "s3"), (-5, base[9], "en", None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """The corpus as documents, with columns whose names the operators use themselves."""
    rows = [(*r, len(r[1] or ""), 1, "x", b"y", 2.0, "z", 0, "w") for r in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, bucket string, blob binary, n double, _d string, kind int, _k string").repartition(3)


@pytest.fixture(scope="session")
def unique(spark):
    """Documents of unique ids, as a table file."""
    import tempfile

    rows = {r[0]: (*r, len(r[1] or "")) for r in corpus() if r[0] is not None}
    path = tempfile.mkdtemp() + "/documents.parquet"
    spark.createDataFrame(list(rows.values()), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def rows(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
