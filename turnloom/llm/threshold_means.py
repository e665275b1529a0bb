"""Centroid clustering: the threshold algorithm finds each vector's nearest centroid.

Every dimension has its centroids sorted by value. From a vector's own value the lists are walked
outward, one centroid per dimension and round; a centroid seen for the first time is measured
exactly. What no list has reached yet is at least as far as the frontiers of all lists together, so
a vector is done once the sum of its squared frontier distances is strictly above its best distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import by_value
from turnloom.plans.scratch import scratch_table

by_value(__name__)

_BLOCK = 2048  # vectors walked at once
_NARROW = 1 << 26  # below it 64 squared differences and their sums fit into 64 bits
_WIDEST = 1 << 16  # dimensions for which that holds with _NARROW / 1024
_LARGEST = (1 << 63) - 1


def usable(vector: Column, width: int) -> Column:
    """Whether a vector has ``width`` components, none of them NULL, NaN or infinite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(vector) == width) & F.forall(vector, finite), F.lit(False))


class SortedCentroids:
    """Per dimension the centroids in order of their values, between two ends that are never reached."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids  # k x width
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of ``x`` the nearest centroid, the smaller number of equally near ones, its
        squared distance, and how many rounds of the lists that took."""
        n, width = x.shape
        k = len(self.centroids)
        kind = self.centroids.dtype
        best = np.zeros(n, np.int64)
        distance = np.zeros(n, kind)
        rounds = np.zeros(n, np.int64)
        # The first list entry at or above each value; everything below it is walked to the left.
        right = np.empty((n, width), np.int64)
        for d in range(width):
            right[:, d] = np.searchsorted(self.values[:, d], x[:, d])
        left = right - 1
        seen = np.zeros((n, k), bool)
        active = np.arange(n)
        dims = np.arange(width)[None, :]
        while len(active):
            lo, hi, v = left[active], right[active], x[active]
            below, above = self._gap(lo, v, dims), self._gap(hi, v, dims)
            go_left = (hi >= k) | ((lo >= 0) & (below <= above))
            reached = self.order[np.where(go_left, lo, hi), dims]
            left[active] = lo = lo - go_left
            right[active] = hi = hi + ~go_left
            fresh = np.zeros((len(active), k), bool)
            fresh[np.arange(len(active))[:, None], reached] = True
            fresh &= ~seen[active]
            for c in np.flatnonzero(fresh.any(axis=0)).tolist():
                rows = active[fresh[:, c]]
                gap = x[rows] - self.centroids[c]
                exact = (gap * gap).sum(axis=1)
                unmeasured = ~seen[rows].any(axis=1)
                closer = unmeasured | (exact < distance[rows]) | ((exact == distance[rows]) & (c < best[rows]))
                best[rows[closer]], distance[rows[closer]] = c, exact[closer]
                seen[rows, c] = True
            rounds[active] += 1
            below, above = self._gap(lo, v, dims), self._gap(hi, v, dims)
            frontier = np.where((hi >= k) | ((lo >= 0) & (below <= above)), below, above)
            done = seen[active].all(axis=1) | ((frontier * frontier).sum(axis=1) > distance[active])
            active = active[~done]
        return best, distance, rounds

    def _gap(self, at: np.ndarray, v: np.ndarray, dims: np.ndarray) -> np.ndarray:
        """Distances of the values to list entries; to the nearest end where there is none."""
        return np.abs(self.values[np.clip(at, 0, len(self.centroids) - 1), dims] - v)


def _exact(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, SortedCentroids]:
    """64-bit integers where no square or sum can overflow, whole numbers of any size elsewhere."""
    largest = max((abs(c) for row in centroids for c in row), default=0)
    width = max(x.shape[1], 1)
    bound = _NARROW if width <= 64 else _NARROW >> 5 if width <= _WIDEST else 0
    kind = np.int64 if largest < bound and (not x.size or -bound < x.min() <= x.max() < bound) else object
    return x.astype(kind), SortedCentroids(np.array(centroids, kind).reshape(-1, width))


def assigned(x: np.ndarray, centroids: list[list[int]]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Blocks of the rows of ``x`` with their clusters and squared distances."""
    for at in range(0, len(x), _BLOCK):
        part = slice(at, min(at + _BLOCK, len(x)))
        block, lists = _exact(x[part], centroids)
        best, distance, _ = lists.nearest(block)
        yield part, best, distance


def _matrix(column: pa.ListArray | pa.ChunkedArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _sums(vectors: DataFrame, centroids: list[list[int]], width: int) -> dict[int, tuple[int, list[int]]]:
    """Per cluster its count and componentwise sums; every task sends one row per cluster and dimension."""
    k = len(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * k, np.zeros((k, width), object)
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            narrow = not x.size or max(abs(int(x.min())), abs(int(x.max()))) < 1 << 50  # 2048 of them fit
            for part, best, _ in assigned(x, centroids):
                block = x[part] if narrow else x[part].astype(object)
                for c in np.unique(best).tolist():
                    mine = block[best == c]
                    counts[c] += len(mine)
                    sums[c] += mine.sum(axis=0).astype(object)
        rows = [(c, d, counts[c], Decimal(sums[c, d])) for c in range(k) if counts[c] for d in range(width)]
        columns = zip(*rows) if rows else ((), (), (), ())
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["c", "d", "n", "s"])

    parts = vectors.select("x").mapInArrow(partial, "c int, d int, n long, s decimal(38,0)")
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # k * width rows
        count, total = found.setdefault(r["c"], (r["n"], [0] * width))
        total[r["d"]] = int(r["s"])
    return found


def clusters(
    df: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector.

    Usable vectors have ``width`` components, none NULL or non-finite; a component becomes
    ``floor(scale * x)``, cut to a long. The first centroids are the vectors whose key has the smallest
    sha256 of ``seed:key``, in that order, a NULL key last and equal keys by their vectors. Each round assigns
    all vectors to the nearest centroid (of equally near ones the smaller number) and moves every
    centroid that has vectors to the floor of their mean. ``distance`` is squared; it and the
    sums over a cluster and over all vectors are exact, and the largest long where they
    exceed it. Fewer vectors than ``k`` make fewer centroids, an empty table gives an empty one.
    Repeated rows are vectors of their own. Other columns are ignored.

    The vectors are written once as integers; a round is one pass over them, and ``k * width`` sums
    come to the driver. A round that moves no centroid is the last, as the others would repeat it.
    """
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    vectors = scratch_table(df.filter(usable(F.col(vector), width)).select(F.col(key).alias("key"), whole.alias("x")), "vectors")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = vectors.orderBy(draw.asc_nulls_last(), "x").limit(k).collect()
    centroids = [list(r["x"]) for r in first]
    for _ in range(rounds if centroids else 0):
        moved = list(centroids)
        for c, (count, total) in _sums(vectors, centroids, width).items():
            moved[c] = [s // count for s in total]
        if moved == centroids:
            break
        centroids = moved

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            for part, best, distance in assigned(x, centroids):
                own = batch.column("key").slice(part.start, part.stop - part.start)
                exact = pa.array([Decimal(int(d)) for d in distance], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([own, pa.array(best, pa.int32()), exact], ["key", "cluster", "exact"])

    kind = vectors.schema["key"].dataType.simpleString()
    near = scratch_table(vectors.mapInArrow(place, f"key {kind}, cluster int, exact decimal(38,0)"), "nearest")
    sums = {r["cluster"]: int(r["s"]) for r in near.groupBy("cluster").agg(F.sum("exact").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    per_cluster = [min(sums.get(c, 0), _LARGEST) for c in range(len(centroids))]

    def of_cluster(values: list, kind: str) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))

    return near.select(
        F.col("key").alias(key), "cluster", F.least("exact", F.lit(Decimal(_LARGEST))).cast("long").alias("distance"),
        of_cluster(per_cluster, "bigint").alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), _LARGEST)).cast("long").alias("inertia"),
        of_cluster(digests, "string").alias("centroid_sha256"),
    )
