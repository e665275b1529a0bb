"""SimHash near-duplicates, found with BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import by_value
from turnloom.llm.components import connected
from turnloom.plans.scratch import scratch_table

by_value(__name__)

_BLOCK_WORDS = 1 << 16
_CELL = 4096
_MOST_CELLS = 16  # of one group; larger ones get finer masks
_MOST_MASKS = 4096
_GROUP = 64


def shingle_hashes(text: str | None, words_per_shingle: int = 3) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles in order, in blocks; none for one without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # ASCII only
    if not words:
        return
    size = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK_WORDS):
        stop = min(n, at + _BLOCK_WORDS)
        cuts = zip(starts[at:stop].tolist(), ends[at + size - 1 : stop + size - 1].tolist())
        yield np.fromiter((digest(joined[a:b], 42) for a, b in cuts), np.uint64, stop - at)


def fingerprint_of(text: str | None, words_per_shingle: int = 3) -> int:
    """The signed 64-bit SimHash of a text, 0 for one without words."""
    n, counts = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, words_per_shingle):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    value = sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp`` of every row, the whole text hashed; ``fp`` is a signed long."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")

    return docs.select(F.col(key), simhash(F.col(text).cast("string")).alias("fp"))


class BKTree:
    """Children are keyed by their Hamming distance to the parent.

    By the triangle inequality a code within ``radius`` of a query lies below an edge whose
    key differs from the query's distance to the node by ``radius`` at most.
    """

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, code: int) -> int:
        codes, children = self.codes, self.children
        new = len(codes)
        codes.append(code)
        children.append({})
        if new:
            node = 0
            while True:
                distance = (codes[node] ^ code).bit_count()
                child = children[node].setdefault(distance, new)
                if child == new:
                    break
                node = child
        return new

    def within(self, code: int, radius: int) -> Iterator[int]:
        codes, children = self.codes, self.children
        stack = [0] if codes else []
        while stack:
            node = stack.pop()
            distance = (codes[node] ^ code).bit_count()
            if distance <= radius:
                yield node
            for edge, child in children[node].items():
                if -radius <= edge - distance <= radius:
                    stack.append(child)


def _links(tree_codes: list[int], queries: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is within ``radius``: a spanning forest, not all pairs.

    Without ``queries`` the codes are compared among themselves.
    """
    codes = tree_codes if queries is None else tree_codes + queries
    parent = list(range(len(codes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    tree, links = BKTree(), []
    if queries is not None:
        for code in tree_codes:
            tree.add(code)
    for at in range(0 if queries is None else len(tree_codes), len(codes)):
        for found in tree.within(codes[at], radius):
            a, b = root(at), root(found)
            if a != b:
                parent[a] = b
                links.append((codes[at], codes[found]))
        if queries is None:
            tree.add(codes[at])
    return links


def _masks(n: int, radius: int) -> list[int]:
    """Masks of which two codes within ``radius`` agree under one at least.

    Of ``k`` blocks, ``radius`` differing bits leave ``k - radius`` untouched. More blocks give
    longer keys; as many are used as keep chance groups small at ``n`` codes.
    """
    for blocks in range(radius + 1, radius + 6):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
        masks = [sum(kept) for kept in combinations(parts, blocks - radius)]
        if n / 2 ** min(m.bit_count() for m in masks) <= _GROUP:
            break
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _finer(mask: int, radius: int) -> list[int]:
    """Masks within a group: of its free bits so many are kept that distinct codes fill one cell at most.

    Two codes of the group within ``radius`` agree under one at least. Empty if that took more than 4096 masks.
    """
    free = [b for b in range(64) if not mask >> b & 1]
    room = _CELL.bit_length() - 1
    blocks = next((b for b in range(radius + 1, len(free) + 1) if radius * -(-len(free) // b) <= room), None)
    if not blocks or comb(blocks, radius) > _MOST_MASKS:
        return []
    parts = [sum(1 << b for b in free[i::blocks]) for i in range(blocks)]
    whole = mask & (1 << 64) - 1
    masks = [whole + sum(kept) for kept in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _divided(keyed: DataFrame, sizes: DataFrame, masks: list[int], radius: int) -> tuple[DataFrame, DataFrame]:
    """``keyed`` and ``sizes`` with groups of more than 16 cells replaced by those of finer masks."""
    finer = [(i, m) for i, mask in enumerate(masks) for m in _finer(mask, radius)]
    large = sizes.filter(F.col("n") > _CELL * _MOST_CELLS).join(
        F.broadcast(sizes.sparkSession.createDataFrame(sorted({(i,) for i, _ in finer}), "m int")), "m"
    )
    if not finer or not large.head(1):
        return keyed, sizes
    numbered = [(i, len(masks) + at, m) for at, (i, m) in enumerate(finer)]
    table = F.broadcast(sizes.sparkSession.createDataFrame(numbered, "m int, to int, mask long"))  # some ten thousand rows
    again = scratch_table(
        keyed.join(large.select("m", "v"), ["m", "v"], "left_semi").join(table, "m").select(
            "fp", F.col("to").alias("m"), F.col("fp").bitwiseAND(F.col("mask")).alias("v")
        ),
        "finer",
    )
    kept = keyed.join(large.select("m", "v"), ["m", "v"], "left_anti").unionByName(again)
    counted = again.groupBy("m", "v").agg(F.count("*").alias("n")).filter("n > 1")
    return kept, sizes.join(large.select("m", "v"), ["m", "v"], "left_anti").unionByName(counted)


def similar(codes: DataFrame, radius: int = 3) -> DataFrame:
    """``a, b``: links that connect all distinct codes ``fp`` within ``radius`` bits.

    Codes meet in groups that agree under a mask; every pair within the radius shares one. Each
    group is a shard with a BK-tree of its own. A group of more than 4096 codes is cut
    into cells, and each pair of cells is a shard, so that no task holds more than two cells. A group of more
    than 16 cells is divided by finer masks (220 at most at three bits), whose groups cannot have more than
    4096 distinct codes: the work stays in proportion to the codes, however close they lie.
    """
    n = codes.count()
    masks = _masks(n, radius)
    keys = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("v"))
                     for i, m in enumerate(masks)])
    keyed = codes.select("fp", F.explode(keys).alias("k")).select("fp", "k.m", "k.v")
    sizes = scratch_table(keyed.groupBy("m", "v").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    keyed, sizes = _divided(keyed, sizes, masks, radius)
    cells = F.ceil(F.col("n") / _CELL).cast("int")
    own = F.pmod(F.xxhash64("fp"), cells.cast("long")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("cells") - 1),
        lambda i: F.struct(F.least(i, F.col("own")).alias("a"), F.greatest(i, F.col("own")).alias("b")),
    )
    members = (
        keyed.join(sizes, ["m", "v"])
        .select("m", "v", "fp", cells.alias("cells"), own.alias("own"))
        .select("m", "v", "fp", "own", F.explode(pairs).alias("p"))
        .select("m", "v", F.col("p.a").alias("a"), F.col("p.b").alias("b"), "own", "fp")
    )
    order = ["m", "v", "a", "b", "own", "fp"]

    def link(batches):
        def solve(rows: np.ndarray) -> list[tuple[int, int]]:
            first, second = int(rows[0, 2]), int(rows[0, 3])
            found = [x & (2**64 - 1) for x in rows[:, 5].tolist()]
            if first == second:
                return _links(found, None, radius)
            split = int((rows[:, 4] == first).sum())
            return _links(found[:split], found[split:], radius)

        def frame(links):
            signed = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"a": signed[:, 0], "b": signed[:, 1]})

        held, out = np.empty((0, 6), np.int64), []
        for batch in batches:
            rows = np.concatenate([held, batch[order].to_numpy(np.int64)])
            if not len(rows):
                continue
            new = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            edges = [0, *new.tolist()]
            for a, b in zip(edges, edges[1:]):
                out += solve(rows[a:b])
            held = rows[edges[-1] :]
            if out:
                yield frame(out)
                out = []
        if len(held):
            yield frame(solve(held))

    # One task's rows are sorted, so a group is a run of rows.
    dealt = members.repartition("m", "v", "a", "b").sortWithinPartitions(*order)
    return dealt.mapInPandas(link, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3
) -> DataFrame:
    """``key, fp, component_id`` of every row.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and into shingles of three
    words, repeats included; a text with fewer words is one shingle, one without words (NULL,
    empty) has fingerprint 0. Fingerprints that differ in ``radius`` bits or less
    are linked, also through others, and a component bears its smallest key (NULL if
    it has none). Equal fingerprints are one node; copies are never paired. An empty table
    gives an empty one; other columns are ignored.
    """
    marked = scratch_table(fingerprints(docs, key, text), "fingerprints")
    nodes = scratch_table(marked.groupBy("fp").agg(F.min(key).alias("first")), "codes")
    links = scratch_table(similar(nodes.select("fp"), radius), "links")
    roots = connected(links)  # node, root; only of linked nodes
    rooted = scratch_table(
        nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        ),
        "rooted",
    )
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.select("fp", "root").join(names, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select(key, "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
