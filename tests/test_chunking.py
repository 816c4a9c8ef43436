import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkmill.functions import gear
from chunkmill.functions.digests import digest, lz4_size
from chunkmill.operators import chunking, dedup
from chunkmill.plans import experiment
from chunkmill.sources import byte_blocks

SMALL = gear.Profile(mask_bits=6, min_len=64)


def sequential(data: bytes, p: gear.Profile) -> list[int]:
    """Sizes by the definition, a byte at a time."""
    h, out, size = 0, [], 0
    for b in data:
        h = ((h << 1) + int(gear.GEAR[b])) % (1 << 64)
        size += 1
        if (h >> (64 - p.mask_bits) == 0 and size >= p.min_len) or size == p.max_len:
            out.append(size)
            size = 0
    return [*out, size]


def data(n: int, seed: int = 1) -> bytes:
    return np.random.default_rng(seed).integers(0, 256, n, dtype=np.uint8).tobytes()


@pytest.mark.parametrize("profile", [gear.Profile(9, 256), gear.Profile(9, 256, 700), gear.Profile(3, 1), gear.Profile(6, 64, 64)])
def test_chunks_are_those_of_the_sequential_definition(profile):
    for d in (b"", b"x", data(63), data(20_000), b"ab" * 3000):
        assert [n for _, n in gear.chunks(d, profile)] == sequential(d, profile)


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=600), st.integers(1, 200))
def test_candidates_do_not_depend_on_blocks(d, block):
    whole = gear.candidates(d, mask_bits=4).tolist()
    parts = [c + a for a in range(0, len(d), block) for c in gear.candidates(d[a : a + block], d[:a], 4).tolist()]
    assert parts == whole


def test_an_insertion_changes_few_chunks():
    d = data(1 << 16)
    e = d[:30_000] + b"0123456789" + d[30_000:]
    cut = lambda x: {x[a : a + n] for a, n in gear.chunks(x, gear.Profile(9, 256))}
    assert len(cut(e) - cut(d)) <= 3


def test_profiles_that_cannot_be_are_refused():
    with pytest.raises(ValueError):
        gear.Profile(min_len=10, max_len=5)


def test_char_candidates_are_those_of_the_definition():
    import hashlib

    t = "Öne two three, fünf! " * 40
    h = [int(hashlib.md5(c.encode()).hexdigest()[:8], 16) for c in t]
    want = [i + 1 for i in range(len(t)) if sum(h[i - k] << k for k in range(min(32, i + 1))) % (1 << 32) < 1 << 28]
    assert gear.char_candidates(t, 1 << 28).tolist() == want


@pytest.fixture
def files(tmp_path):
    contents = {"a": data(20_000) * 2, "b": data(20_000), "c": b"", "d": data(9000, 2)}
    for k, v in contents.items():
        (tmp_path / k).write_bytes(v)
    return tmp_path, contents


def test_file_chunks_equal_those_of_each_stream_for_any_block_size(spark, files):
    folder, contents = files
    paths = [str(folder / k) for k in "abcdb"]
    for block in (5000, 1 << 20):
        got = chunking.file_chunks(spark, paths, SMALL, store_data=True, block=block).orderBy("file_idx", "ord").toPandas()
        for i, k in enumerate("abcdb"):
            own = got[got.file_idx == i]
            assert own["size"].tolist() == sequential(contents[k], SMALL)
            assert b"".join(own["data"]) == contents[k]
            assert own["hash"].tolist() == [digest(bytes(x)) for x in own["data"]]
            assert own["lz4_size"].tolist() == [lz4_size(bytes(x)) for x in own["data"]]


def test_a_chunk_longer_than_a_piece_is_digested_whole(spark, tmp_path):
    data = bytes(10_000)
    (tmp_path / "zeros").write_bytes(data)
    one, *more = chunking.file_chunks(spark, [str(tmp_path / "zeros")], SMALL, block=1 << 10, piece=4096).orderBy("ord").collect()
    assert (one["size"], one["hash"], more) == (10_000, digest(data), [])
    assert one["lz4_size"] == 2 * lz4_size(data[:4096]) + lz4_size(data[8192:])


def test_merge_keeps_the_first_file_and_each_file_once(spark):
    occ = spark.createDataFrame([(0, 0, "x", 5), (0, 1, "x", 5), (1, 0, "y", 7), (2, 0, "y", 7), (2, 1, "x", 5)], "file_idx long, ord long, hash string, size long")
    got = {r["hash"]: (r["size"], r["first_seen_in"], r["seen_in"], r["n"]) for r in dedup.merge(occ).collect()}
    assert got == {"x": (5, 0, [0, 2], 3), "y": (7, 1, [1, 2], 2)}
    assert dedup.stats(occ).first().asDict() == {"total_len": 29, "chunk_bytes": 12, "dedup_ratio": round(12 / 29, 6)}
    assert sorted(map(tuple, dedup.segments(occ).collect())) == [(0, 0, 0), (0, 1, 0), (1, 0, 1), (2, 0, 1), (2, 1, 0)]
    assert sorted(map(tuple, dedup.new_bytes(occ).collect())) == [(0, 10, 5), (1, 7, 7), (2, 12, 0)]
    assert sorted(map(tuple, dedup.shared_bytes(occ).collect())) == [(0, 0, 5), (0, 2, 5), (1, 1, 7), (1, 2, 7), (2, 2, 12)]
    assert [r["hash"] for r in dedup.missing(occ, occ.where("file_idx = 0")).collect()] == ["y"]


def test_stats_of_nothing(spark):
    none = spark.createDataFrame([], "file_idx long, ord long, hash string, size long")
    assert dedup.stats(none).first().asDict() == {"total_len": 0, "chunk_bytes": 0, "dedup_ratio": None}


def test_estimate_of_a_file_twice_is_a_half(spark, files):
    folder, _ = files
    e = experiment.estimate(spark, [folder / "b", folder / "b"], images=True)
    assert (e.numfiles, e.total_len, e.dedup_ratio, e.bounded_dedup_ratio) == (2, 40_000, 0.5, 0.5)
    assert (folder / "b.png").read_bytes()[:4] == b"\x89PNG" and (folder / "merged.png").exists()
    listed = experiment.chunks(spark, [folder / "b", folder / "b"], store_data=True).collect()
    assert [r["seen_in"] for r in listed] == [[0, 1]] * len(listed) and all(r["first_seen_in"] == 0 for r in listed)


def test_estimates_of_no_bytes_and_no_files(spark, files):
    assert experiment.estimate(spark, [files[0] / "c"]).dedup_ratio is None
    with pytest.raises(ValueError):
        experiment.estimate(spark, [])
    with pytest.raises(FileNotFoundError):
        experiment.estimate(spark, [files[0] / "none"])


def test_approximate_stats_are_near(spark):
    occ = spark.range(20_000).selectExpr("0L AS file_idx", "id AS ord", "md5(cast(id % 5000 as string)) AS hash", "100L AS size")
    r = dedup.approximate_stats(occ).first()
    assert r["total_len"] == 2_000_000 and abs(r["chunk_bytes"] / 500_000 - 1) < 0.1


def test_blocks_of_a_long_text(spark):
    text = "äb\n😀c" * 2_000_003
    got = chunking.fixed_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "k long, t string"), "t", "k").cache()
    assert got.count() == -(-len(text) // 64) and got.agg({"size": "sum"}).first()[0] == len(text.encode())
    last = got.orderBy("ord", ascending=False).first()
    tail = text[64 * last["ord"] :].encode()
    assert (last["k"], last["hash"], last["size"]) == (1, hashlib.md5(tail).hexdigest(), len(tail))
    got.unpersist()


def test_small_blocks_share_partitions(spark, tmp_path):
    paths = []
    for i in range(40):
        paths.append(str(tmp_path / str(i)))
        (tmp_path / str(i)).write_bytes(bytes([i]) * (300 * i))
    blocks = byte_blocks.byte_blocks(spark, [*paths, paths[-1]], 1 << 10)
    assert blocks.rdd.getNumPartitions() < 8
    got = sorted(tuple(r) for r in blocks.select("file_idx", "start", "before", "bytes").collect())
    assert len(got) == sum(max(1, -(-300 * i // 1024)) for i in [*range(40), 39])
    for k, i in enumerate([*range(40), 39]):
        own = [r for r in got if r[0] == k]
        assert b"".join(bytes(r[3]) for r in own) == bytes([i]) * (300 * i) and [r[1] for r in own] == [1024 * j for j in range(len(own))]
        assert all(len(r[2]) == min(63, r[1]) for r in own)
    large = tmp_path / "large"
    large.write_bytes(bytes(9 << 20))
    assert byte_blocks.byte_blocks(spark, [str(large)]).rdd.getNumPartitions() == 3


def test_candidates_need_no_python_worker_beside_the_driver(spark, tmp_path, monkeypatch):
    def planned(*_):
        raise AssertionError("a Python data source was planned")

    data = [np.random.default_rng(i).bytes(n) for i, n in enumerate((0, 5000, 1024, 1))]
    for i, d in enumerate(data):
        (tmp_path / str(i)).write_bytes(d)
    large = tmp_path / "large"
    large.write_bytes(bytes(9 << 20))
    monkeypatch.setattr(type(spark.dataSource), "register", planned)
    for block in (1 << 10, 1 << 20):
        found = byte_blocks.block_candidates(spark, [str(tmp_path / str(i)) for i in (0, 1, 2, 3, 1)], 6, block)
        want = [(k, c) for k, i in enumerate((0, 1, 2, 3, 1)) for c in gear.candidates(data[i], mask_bits=6).tolist()]
        assert len(want) > 100 and sorted(map(tuple, found.collect())) == want
    assert byte_blocks.block_candidates(spark, [str(large)], 16).rdd.getNumPartitions() == 3


def test_cuts_of_files_are_not_broadcast(spark, tmp_path):
    data = [np.random.default_rng(i).bytes(n) for i, n in enumerate((5000, 0, 70000))]
    for i, d in enumerate(data):
        (tmp_path / str(i)).write_bytes(d)
    found = chunking.file_chunks(spark, [str(tmp_path / str(i)) for i in range(3)], SMALL, block=1 << 10)
    want = [(i, *c) for i, d in enumerate(data) for c in gear.chunks(d, SMALL)]
    assert len(want) > 10 and [tuple(r) for r in found.select("file_idx", "start", "size").orderBy("file_idx", "start").collect()] == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
