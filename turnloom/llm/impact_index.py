"""Exact top-k inner products with an impact-ordered index, a score at a time.

A shard of vectors is indexed by postings: for a dimension, a sign and a quantised size the
rows that have it. Segments of postings are processed by descending quantised impact for a block
of queries at once. What is not processed yet, and what quantising hides, is bounded by the
norms of the query and of the rest of each vector (Cauchy-Schwarz). Once few rows can
still belong to the best k, which their bounds prove, only those are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import by_value
from turnloom.plans.scratch import scratch_table

by_value(__name__)

_SHARD = 8192
_BLOCK = 512
_TILE_BYTES = 32 << 20  # of queries, and of vectors, that a task holds at once
_TILE_ROWS = 64  # so many tasks at least share the shards, if there are as many
_LEVEL_BITS = 6
_FEW = 64  # members per query that are cheaper to score than to bound further


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def scaled(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``key, x``: components floored after scaling; vectors with a NULL or non-finite
    component, and NULL vectors, are left out."""
    floored = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return df.filter(_usable(F.col(vector))).select(F.col(key), floored.alias("x"))


def _matrix(rows: pd.Series) -> np.ndarray:
    """Vectors as rows of one matrix; shorter ones are filled up with zeros."""
    width = max((len(x) for x in rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


class ImpactIndex:
    """The postings of one shard, in descending order of quantised impact."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        sizes = np.abs(x)
        shift = max(0, int(sizes.max(initial=0)).bit_length() - _LEVEL_BITS)
        self.step = 1 << shift
        rows, dims = np.nonzero(x)
        level, positive = sizes[rows, dims] >> shift, x[rows, dims] > 0
        order = np.lexsort((rows, positive, dims, -level))
        rows, dims, level, positive = (a[order] for a in (rows, dims, level, positive))
        change = (np.diff(level) != 0) | (np.diff(dims) != 0) | (np.diff(positive) != 0)
        self.starts = np.concatenate(([0], np.flatnonzero(change) + 1)) if len(rows) else np.zeros(0, int)
        self.ends = np.append(self.starts[1:], len(rows)) if len(rows) else np.zeros(0, int)
        self.rows, self.dims, self.levels = rows, dims[self.starts], level[self.starts]
        self.signs = np.where(positive[self.starts], 1.0, -1.0)
        self.norms = np.sqrt((sizes.astype(np.float64) ** 2).sum(axis=1))

    def impact(self, level: int) -> float:
        return level * self.step + (self.step - 1) / 2

    def rest(self, level: int) -> np.ndarray:
        """Norms of what remains of each vector once all levels from ``level`` on are done."""
        sizes = np.abs(self.x).astype(np.float64)
        done = (sizes >= max(level * self.step, 1)).astype(np.float64)
        middle = (sizes // self.step) * self.step + (self.step - 1) / 2
        left = sizes - done * middle
        return np.sqrt((left * left).sum(axis=1))

    def search(self, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> list[np.ndarray]:
        """For each query all rows that can be among its best ``k``, ties included.

        ``least`` are scores that each query has reached ``k`` times elsewhere; rows that are
        proved to stay below are left out, too.
        """
        n, width = self.x.shape
        if not n:
            return [np.empty(0, np.int64) for _ in queries]
        least = np.full(len(queries), -np.inf) if least is None else least
        q = np.zeros((len(queries), width), np.float32)
        shared = min(width, queries.shape[1])
        q[:, :shared] = queries[:, :shared]
        weights = np.ascontiguousarray(q.T)
        lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        sums = np.zeros((n, len(queries)), np.float32)
        # Of single precision: no more than so many roundings of 2**-24 each, of sums within these norms.
        roundings = (shared + 3) * 2.0**-24
        middles = self.norms + self.step / 2 * np.sqrt(width)
        slack = roundings / (1 - roundings) * middles
        possible = np.ones_like(sums, bool)
        levels = np.unique(self.levels)[::-1].tolist()
        tried = 0.25 * np.median(self.norms) / 0.8
        for level in levels:
            for s in np.flatnonzero(self.levels == level):
                rows = self.rows[self.starts[s] : self.ends[s]]
                sums[rows] += np.float32(self.signs[s] * self.impact(level)) * weights[self.dims[s]]
            rest = self.rest(level)
            # A proof costs as much as many postings: tried whenever the rest has shrunk enough.
            if level != levels[-1] and np.median(rest) > 0.8 * tried:
                continue
            tried = np.median(rest)
            bound = (rest + slack)[:, None] * lengths[None, :]
            floor = np.partition(sums - bound, n - k, axis=0)[n - k] if n > k else -np.inf
            possible = sums + bound >= np.maximum(floor, least)
            if possible.sum() <= max(_FEW, 8 * k) * len(queries):
                break
        return [np.flatnonzero(possible[:, i]) for i in range(len(queries))]


class Best:
    """The best ``k`` of a block of queries over the shards seen so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.rows, self.queries, self.k = ids, rows, queries, k
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]  # keys, scores
        self.least = np.full(len(ids), -np.inf)

    def meet(self, index: ImpactIndex, ids: np.ndarray, rows: np.ndarray) -> None:
        shared = min(index.x.shape[1], self.queries.shape[1])
        members_of = index.search(self.queries, self.k + 1, self.least)  # one may be the query itself
        for i, members in enumerate(members_of):
            members = members[rows[members] != self.rows[i]]
            scores = np.concatenate((self.found[i][1], index.x[members, :shared] @ self.queries[i, :shared]))
            keys = np.concatenate((self.found[i][0], ids[members]))
            best = np.lexsort((keys, -scores))[: self.k]
            self.found[i] = keys[best], scores[best]
            if len(best) == self.k:
                self.least[i] = scores[best[-1]]

    def frame(self) -> pd.DataFrame:
        counts = [len(scores) for _, scores in self.found]
        return pd.DataFrame({
            "query_row": np.repeat(self.rows, counts), "query_id": np.repeat(self.ids, counts),
            "found": np.concatenate([keys for keys, _ in self.found]),
            "score": np.concatenate([scores for _, scores in self.found]),
        })


def _packs(vectors: DataFrame, count: int, query: bool) -> DataFrame:
    """The vectors dealt out by their row numbers into ``count`` rows, components as narrow as they can be."""

    def pack(number: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["x"])
        kind = np.result_type(np.min_scalar_type(x.min(initial=0)), np.min_scalar_type(x.max(initial=0)), np.int8)
        kind = kind if kind.kind == "i" else np.dtype(np.int64)
        return pd.DataFrame({
            "query": [query], "number": [int(number[0])], "width": [x.shape[1]], "kind": [kind.newbyteorder("<").str],
            "ids": [pdf["key"].to_numpy("<i8").tobytes()], "rows": [pdf["row"].to_numpy("<i8").tobytes()],
            "x": [x.astype(kind.newbyteorder("<")).tobytes()],
        })

    dealt = vectors.withColumn("number", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int"))
    return dealt.groupBy("number").applyInPandas(
        pack, "query boolean, number int, width int, kind string, ids binary, rows binary, x binary"
    )


def _unpacked(pack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, rows = (np.frombuffer(pack[c], "<i8") for c in ("ids", "rows"))
    x = np.frombuffer(pack["x"], pack["kind"]).reshape(len(ids), pack["width"])
    return ids, rows, x.astype(np.int64)


def _tiles(packs: int, rows: int, width: int, least: int) -> int:
    """In how many parts to take packs of so many vectors: at least ``least``, one pack each at most."""
    held = max(1, _TILE_BYTES // (8 * rows * max(width, 1)))
    return max(-(-packs // held), min(packs, least))


def top_k(
    df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256
) -> DataFrame:
    """``query_id, rank, key, score`` of each query row's ``k`` best other rows.

    Components become ``floor(scale * x)``, the score is their exact inner product, ties
    go to the smaller key, fewer rows than ``k`` are all returned. A row never meets itself,
    but a repeated row is another row. Vectors that are NULL or hold a NULL or non-finite
    component take no part; shorter vectors count as filled up with zeros; keys must not be NULL
    (such rows take no part). Scores must fit into a long. Other columns are ignored.

    Shards of about 8192 vectors and blocks of about 512 queries meet in tiles: a task holds
    some 32 MB of blocks and indexes each of its shards once for all of them. What the
    blocks found in one shard bounds what they look for in the next. A tile returns ``k`` rows per query, cut
    again before the last shuffle.
    """
    valid = scaled(df.filter(F.col(key).isNotNull()), key, vector, scale)
    vectors = scratch_table(
        valid.select(F.col(key).cast("long").alias("key"), "x", F.monotonically_increasing_id().alias("row")),
        "vectors",
    )
    asked = is_query if is_query is not None else F.lit(True)
    wanted = vectors.withColumnRenamed("key", key).filter(asked).withColumnRenamed(key, "key")
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).head()
    shards, blocks = max(1, -(-n // _SHARD)), max(1, -(-wanted.count() // _BLOCK))
    down, across = _tiles(shards, _SHARD, width, _TILE_ROWS), _tiles(blocks, _BLOCK, width, 1)

    def numbers(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    place = F.pmod("number", F.lit(down))
    pairs = (
        _packs(vectors, shards, False).select("*", place.alias("down"), numbers(across).alias("across"))
    ).unionByName(
        _packs(wanted, blocks, True)
        .select("*", F.pmod("number", F.lit(across)).alias("across"), numbers(down).alias("down"))
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        packs = pdf.sort_values("number").to_dict("records")
        held = [Best(*_unpacked(p), k) for p in packs if p["query"]]
        for p in packs:
            if held and not p["query"]:
                ids, rows, x = _unpacked(p)
                index = ImpactIndex(x)
                for best in held:
                    best.meet(index, ids, rows)
        nothing = pd.DataFrame(columns=["query_row", "query_id", "found", "score"], dtype="int64")
        return pd.concat([best.frame() for best in held]) if held else nothing

    tiles = pairs.repartition(min(4 * down * across, 1 << 15), "down", "across")
    found = tiles.groupBy("down", "across").applyInPandas(
        search, "query_row long, query_id long, found long, score long"
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "found")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("found").alias(key), "score")
