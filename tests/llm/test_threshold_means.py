import hashlib
import math
import random

import numpy as np
import pytest
from conftest import SF, ordered
from pyspark.sql import functions as F

from turnloom.llm import threshold_means as tm

LARGEST = 2**63 - 1


def brute(rows, k=8, rounds=10, width=64, scale=1024):
    """``rows``: (vec_id, components); plain k-means in whole numbers."""
    good = [(v, [max(-(2**63), min(LARGEST, math.floor(scale * c))) for c in x]) for v, x in rows
            if x is not None and len(x) == width and all(c is not None and math.isfinite(c) for c in x)]
    draw = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(good, key=draw)[:k]]
    gap = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    near = lambda x: min((gap(x, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        mine = [[] for _ in centroids]
        for _, x in good:
            mine[near(x)[1]].append(x)
        centroids = [[sum(col) // len(m) for col in zip(*m)] if m else c for m, c in zip(mine, centroids)]
    found = [(v, *near(x)) for v, x in good]
    total = sum(d for _, d, _ in found)
    sums = [sum(d for _, d, c in found if c == i) for i in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(v, c, min(d, LARGEST), min(sums[c], LARGEST), min(total, LARGEST), names[c]) for v, d, c in found]


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return df.select("*", *[F.lit("clash").alias(c) for c in ("key", "x", "cluster", "exact", "c", "d", "n", "s")])


@pytest.mark.parametrize("k", [1, 3, 8, 40])
@pytest.mark.parametrize("kind", [np.int64, object])
def test_nearest_is_exact_and_stops_on_proof(k, kind):
    rng = np.random.default_rng(k)
    centres = rng.integers(-500, 500, (k, 16))
    centres[k // 2] = centres[0]  # equal centroids: the smaller number
    x = np.concatenate([rng.integers(-500, 500, (300, 16)), centres + rng.integers(-2, 3, centres.shape), centres])
    best, distance, rounds = tm.SortedCentroids(centres.astype(kind)).nearest(x.astype(kind))
    gaps = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert best.tolist() == gaps.argmin(axis=1).tolist() and distance.tolist() == gaps.min(axis=1).tolist()
    assert rounds.max() <= k
    if k == 40:
        assert rounds[-k:].mean() < 8  # a vector beside its centroid does not walk the lists to their ends


def test_walk_measures_fewer_centroids():
    """What the frontiers rule out is never measured."""
    lists = tm.SortedCentroids(np.array([[0, 0], [10, 10], [1000, 1000], [2000, 2000]]))
    _, _, rounds = lists.nearest(np.array([[1, 1], [1001, 999], [5, 5]]))
    assert rounds.tolist() == [1, 1, 2]  # equally near ones are both measured


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 5, 0.6) for _ in range(64)]) for i in range(250)]
    rows += [(300 + i, list(rows[i % 4][1])) for i in range(90)] + [(7, rows[9][1]), (7, rows[9][1]), (None, rows[3][1])]
    rows += [(400, None), (401, [1.0] * 63), (402, [1.0] * 65), (403, [None] + [1.0] * 63), (404, [float("nan")] * 64),
             (405, [float("inf")] + [0.0] * 63), (406, []), (407, [0.0] * 64)]
    got = tm.clusters(table(spark, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert ordered(got.collect()) == ordered(brute(rows))


def test_large_components(spark):
    rows = [(i, [(-1) ** i * 10.0 ** (i % 21)] * 64) for i in range(40)]
    assert ordered(tm.clusters(table(spark, rows)).collect()) == ordered(brute(rows))


def test_few_and_no_rows(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert ordered(tm.clusters(table(spark, rows)).collect()) == ordered(brute(rows))
    assert tm.clusters(table(spark, rows).limit(0)).count() == 0


def test_floats_of_the_given_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert ordered(tm.clusters(df).collect()) == ordered(brute(rows))
