import math
import random

import numpy as np
import pytest
from conftest import ordered
from pyspark.sql import functions as F

from turnloom.llm import impact_index as ii


def brute(rows, k, is_query):
    good = [(i, v, [math.floor(256 * x) for x in x]) for i, (v, x) in enumerate(rows)
            if v is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for i, q, x in good:
        if is_query(q):
            scores = sorted((-sum(a * b for a, b in zip(x, y)), v) for j, v, y in good if j != i)[:k]
            out += [(q, rank, v, -s) for rank, (s, v) in enumerate(scores, 1)]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").select(
        "*", F.lit("clash").alias("row"), F.lit("clash").alias("x"), F.lit("clash").alias("key")
    )


@pytest.mark.parametrize("shard, block, held, rows", [(8192, 512, 1 << 25, 64), (37, 5, 40_000, 2), (37, 5, 1, 64)])
def test_against_brute_force(spark, monkeypatch, shard, block, held, rows):
    for name, value in {"_SHARD": shard, "_BLOCK": block, "_TILE_BYTES": held, "_TILE_ROWS": rows}.items():
        monkeypatch.setattr(ii, name, value)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.12) for _ in range(24)]) for i in range(400)]
    rows += [(400 + i, list(rows[i % 7][1])) for i in range(60)]  # ties
    rows += [(500, None), (510, [1.0, None]), (520, [float("nan")]), (530, [float("inf")]), (540, []), (550, [0.0] * 24),
             (560, [0.5] * 3), (570, [0.25] * 40), (None, [0.5] * 24), (600, [0.3] * 24), (600, [0.3] * 24)]
    got = ii.top_k(table(spark, [(*r, 0) for r in rows]), F.col("vec_id") % 10 == 0).collect()
    assert ordered(got) == ordered(brute(rows, 5, lambda v: v % 10 == 0))


def test_few_and_no_rows(spark):
    rows = [(0, [0.5, 0.5], 0), (50, [0.25, -1.0], 0)]
    df = table(spark, rows)
    assert ordered(ii.top_k(df, F.col("vec_id") % 50 == 0).collect()) == [(0, 1, 50, -24576), (50, 1, 0, -24576)]
    assert ii.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ii.top_k(df, F.lit(False)).count() == 0


def test_stops_on_proof_only():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 30, (3000, 48))).astype(np.int64)
    x[:200] = x[0] + rng.integers(-1, 2, (200, 48))
    queries = x[::100]
    members = ii.ImpactIndex(x).search(queries, 6)
    for q, found in zip(queries, members):
        scores = x @ q
        least = np.sort(scores)[-6]
        assert set(np.flatnonzero(scores >= least)) <= set(found.tolist())
    assert np.mean([len(f) for f in members]) < 1000  # the bounds do exclude rows


@pytest.mark.parametrize("width", [16, 768, 4096])
def test_bounds_hold_in_single_precision(width):
    """Whatever rounding does, no member is lost; all products of one sign make the sums largest."""
    rng = np.random.default_rng(width)
    x = rng.integers(1, 255, (300, width))
    x[100:] = x[:1] + rng.integers(0, 2, (200, width))
    for q, found in zip(x[::30], ii.ImpactIndex(x).search(x[::30], 4)):
        scores = x @ q
        assert set(np.flatnonzero(scores >= np.sort(scores)[-4])) <= set(found.tolist())


def test_segments_are_ordered_by_impact():
    index = ii.ImpactIndex(np.array([[3, -100, 0], [90, 7, 1]]))
    assert list(index.levels) == sorted(index.levels, reverse=True)
    assert sum(index.ends - index.starts) == 5


def test_scores_reached_elsewhere_leave_out_rows():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 30, (2000, 32))).astype(np.int64)
    queries = x[:40]
    index = ii.ImpactIndex(x)
    scores = x @ queries.T
    least = np.sort(scores, axis=0)[-3].astype(float)  # two rows are better, one is equal
    for i, found in enumerate(index.search(queries, 6, least)):
        assert set(np.flatnonzero(scores[:, i] >= least[i])) <= set(found.tolist())
    unreachable = index.search(queries, 6, np.full(40, 1e9))
    assert not any(len(found) for found in unreachable)


def test_vectors_of_any_size(spark):
    """Components are packed as narrow as they fit; none changes."""
    rows = [(i, [float(v), 1.0 * i]) for i, v in enumerate([1, 127, -128, 128, 40_000, -3e9, 2**31])]
    got = ii.top_k(table(spark, [(*r, 0) for r in rows]), F.col("vec_id") >= 0, scale=1, k=3).collect()
    x = {i: [math.floor(c) for c in v] for i, v in rows}
    for q in x:
        best = sorted((-sum(a * b for a, b in zip(x[q], x[v])), v) for v in x if v != q)[:3]
        assert [(-s, v) for s, v in best] == [(r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])
                                              if r["query_id"] == q]
