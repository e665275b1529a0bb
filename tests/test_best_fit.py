"""Best-fit packing against one sequence after the other."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnloom import fill_rate, pack_best_fit
from turnloom.operators.best_fit import best_fit_runs


def one_by_one(lengths, block_len):
    """The block and offset of each length, longest first, and the number of blocks."""
    rooms, places = [], []
    for n in sorted(lengths, reverse=True):
        fits = [(r, b) for b, r in enumerate(rooms) if r >= n]
        if not fits:
            rooms.append(block_len)
            fits = [(block_len, len(rooms) - 1)]
        room, block = min(fits)
        places.append((n, block, block_len - room))
        rooms[block] -= n
    return places, len(rooms)


@pytest.mark.parametrize("seed", range(60))
def test_runs_are_those_of_one_by_one(seed):
    rng = random.Random(seed)
    block_len = rng.choice([1, 2, 7, 32, 100])
    shape = rng.choice([lambda: rng.randint(1, block_len), lambda: min(block_len, int(rng.expovariate(4 / block_len)) + 1),
                        lambda: rng.choice([1, max(1, block_len // 3), max(1, block_len // 2)])])
    lengths = [shape() for _ in range(rng.randint(0, 400))]
    runs, n_blocks = best_fit_runs(Counter(lengths), block_len)
    places = []
    for run in runs:
        for i in range(run.blocks * run.per_block):
            places.append((run.length, run.block + i // run.per_block, run.offset + i % run.per_block * run.length))
    assert (places, n_blocks) == one_by_one(lengths, block_len)
    firsts = Counter()
    for run in runs:
        assert run.first == firsts[run.length]
        firsts[run.length] += run.blocks * run.per_block


def test_a_long_histogram_needs_few_runs():
    histogram = {n: 10**9 // n for n in range(1, 2049)}
    runs, n_blocks = best_fit_runs(histogram, 2048)
    assert len(runs) < 50_000
    tokens = sum(n * c for n, c in histogram.items())
    assert -(-tokens // 2048) <= n_blocks <= 1.001 * tokens / 2048


def expected(rows, block_len, overlong="split"):
    """``rows``: (key, text)."""
    from hashlib import md5

    parts = []
    for key, text in rows:
        tokens = (text or "").split()
        cuts = [tokens[i : i + block_len] for i in range(0, len(tokens), block_len)]
        parts += [(len(c), key, i, md5(" ".join(c).encode()).hexdigest(), " ".join(c)) for i, c in enumerate(cuts[:1] if overlong == "truncate" else cuts)]
    parts.sort(key=lambda p: (-p[0], p[1] is not None, p[1], *p[2:]))
    places, n_blocks = one_by_one([p[0] for p in parts], block_len)
    blocks = [[] for _ in range(n_blocks)]
    for (n, block, offset), part in zip(places, parts):
        blocks[block].append((offset, n, part[4]))
    return [(i, sum(n for _, n, _ in b), [n for _, n, _ in sorted(b)], " ".join(t for *_, t in sorted(b))) for i, b in enumerate(blocks)]


def texts(n, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(int(rng.expovariate(1 / 12))))) for i in range(n)]


@pytest.mark.parametrize("overlong", ["split", "truncate"])
@pytest.mark.parametrize("block_len", [1, 16, 64])
def test_texts(spark, overlong, block_len):
    rows = texts(300) + [(1000, None), (1001, ""), (1002, " x \n y\t"), (1003, "long " * 500), (7, "same key"), (None, "no key")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(5)
    got = pack_best_fit(df, "id", "text", block_len, overlong, buckets=9)
    assert got.columns == ["block", "n_tokens", "lengths", "content"]
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, block_len, overlong)


def test_token_arrays_and_two_keys(spark):
    df = spark.createDataFrame([("a", 1, [1, 2, 3]), ("a", 2, [4]), ("b", 1, []), ("b", 2, [5, 6]), ("c", 0, None)], "a string, b int, ids array<int>")
    got = pack_best_fit(df, ["a", "b"], "ids", 4).orderBy("block").collect()
    assert [(r["n_tokens"], r["lengths"], r["tokens"]) for r in got] == [(4, [3, 1], [1, 2, 3, 4]), (2, [2], [5, 6])]


def test_a_hot_length_and_copies_are_spread(spark):
    """A third of all rows are equal; no task ranks them alone."""
    rows = [(1, "same words here")] * 4000 + texts(8000, 3)
    df = spark.createDataFrame(rows, "id int, text string").repartition(6)
    packed = pack_best_fit(df, "id", "text", 32, buckets=40)
    assert sorted(tuple(r) for r in packed.collect()) == expected(rows, 32)
    import turnloom.operators.best_fit as module

    seen = []
    real = module.with_running_start
    module.with_running_start = lambda *a, **k: seen.append(real(*a, **k)) or seen[-1]
    try:
        pack_best_fit(df, "id", "text", 32, buckets=40)
    finally:
        module.with_running_start = real
    assert seen[0].groupBy("bucket").count().agg(F.max("count")).head()[0] < 1500


def test_fill_rate(spark):
    df = spark.createDataFrame(texts(2000, 5), "id int, text string")
    tokens = sum(len(t.split()) for _, t in texts(2000, 5))
    r = fill_rate(pack_best_fit(df, "id", "text", 64), 64).head()
    assert r["n_tokens"] == tokens and r["fill"] > 0.99 and r["n_blocks"] == round(tokens / r["fill"] / 64)
    none = fill_rate(pack_best_fit(df.limit(0), "id", "text", 64), 64).head()
    assert tuple(none) == (0, 0, 0, 0, None)


def test_same_in_any_partitioning(spark):
    df = spark.createDataFrame(texts(500, 6), "id int, text string")
    first = sorted(map(tuple, pack_best_fit(df.repartition(1), "id", "text", 40).collect()))
    assert first == sorted(map(tuple, pack_best_fit(df.repartition(9), "id", "text", 40, buckets=5).collect()))


@pytest.mark.parametrize("wrong", [{"overlong": "drop"}, {"block_len": 0}])
def test_wrong_settings(spark, wrong):
    with pytest.raises(ValueError):
        pack_best_fit(spark.createDataFrame([(1, "a")], "id int, text string"), "id", "text", **wrong)
