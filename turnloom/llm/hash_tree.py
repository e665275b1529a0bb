"""Sharding by a hierarchical weighted hash tree.

A tree has regions, a region racks and a rack shards, each shard with a weight. A key
descends: at each level every child draws a number from the hash of the key and the
child's name, made exponential with the weight of the child's subtree, and the smallest draw
wins. A child is chosen with a share proportional to its weight, and a draw only changes with
the child's own weight: raising one shard's weight moves keys into its rack and region, none
between other racks or regions, and lowering it only moves keys out of them.

All draws are native expressions; placing a table is one projection without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import buckets_for, text_or_empty
from turnloom.plans.ordered import with_running_start
from turnloom.plans.scratch import scratch_table

Rack = tuple[tuple[int, float], ...]
Tree = tuple[tuple[Rack, ...], ...]

_REGION, _RACK, _SHARD = 1, 2, 3
_ROWS_PER_BUCKET = 5_000


def uniform_tree(regions: int, racks: int, shards: int) -> Tree:
    """``regions * racks * shards`` shards of weight 1, numbered from 0."""
    number = iter(range(regions * racks * shards))
    return tuple(
        tuple(tuple((next(number), 1.0) for _ in range(shards)) for _ in range(racks))
        for _ in range(regions)
    )


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """One more shard, in a rack and a region of its own.

    No other subtree's weight changes, so keys move into the new shard only.
    """
    number = 1 + max(shard for region in tree for rack in region for shard, _ in rack)
    return (*tree, (((number, weight),),))


def _draw(key: Sequence[Column], level: int, child: Column) -> Column:
    """Exponential with the child's weight; the lowest draw of a level wins."""
    bits = F.shiftrightunsigned(F.xxhash64(*key, F.lit(level), child["id"]), 11)
    unit = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)  # never 0 or 1
    return F.struct((-F.log(unit) / child["weight"]).alias("draw"), child["id"].alias("id"))


def _children(nodes: Sequence[tuple[int, float]]) -> Column:
    structs = [
        F.struct(F.lit(int(i)).alias("id"), F.lit(float(w)).alias("weight"))
        for i, w in nodes
        if w > 0
    ]
    return F.array(*structs)


def _winner(key: Sequence[Column], level: int, children: Column) -> Column:
    return F.array_min(F.transform(children, lambda c: _draw(key, level, c)))["id"]


def shard_of(tree: Tree, *key: Column) -> Column:
    """The shard of a key, a native expression. NULL keys are keys like others."""
    weight = lambda rack: sum(w for _, w in rack)
    regions, racks, shards, number = [], {}, {}, 0
    for r, region in enumerate(tree):
        racks[r] = []
        for rack in region:
            racks[r].append((number, weight(rack)))
            shards[number] = list(rack)
            number += 1
        regions.append((r, sum(w for _, w in racks[r])))
    if not any(w > 0 for _, w in regions):
        raise ValueError("a tree needs a shard with a positive weight")

    def below(groups: dict[int, list], parent: Column) -> Column:
        pairs = [x for g, nodes in groups.items() for x in (F.lit(g), _children(nodes))
                 if any(w > 0 for _, w in nodes)]
        return F.element_at(F.create_map(*pairs), parent)

    region = _winner(key, _REGION, _children(regions))
    # One-item arrays hand each level's winner to the next without computing it again.
    rack = F.transform(F.array(region), lambda r: _winner(key, _RACK, below(racks, r)))
    shard = F.transform(rack, lambda k: _winner(key, _SHARD, below(shards, k)))
    return F.get(shard, F.lit(0))


def place(
    df: DataFrame, tree: Tree, key: str, text: str, larger: Tree | None = None
) -> DataFrame:
    """``key, size, text_crc32, shard, slot`` and with ``larger`` also ``grown_shard``.

    ``size`` is the text's UTF-8 bytes plus 16 (NULL and empty texts: 16), ``text_crc32`` its
    unsigned CRC-32 (NULL: 0). ``slot`` numbers each shard's rows from 0 without gaps in order
    of key, checksum and size; rows that are equal in all three are interchangeable. Other
    columns are not read. An empty table gives an empty one.

    Only these narrow rows are shuffled, in buckets of the order: no shard meets in one task, and a
    salt spreads rows that are equal in all three.
    """
    grown_shard = shard_of(larger, F.col(key)) if larger else F.lit(None).cast("int")
    placed = df.select(
        F.col(key),
        (F.octet_length(text_or_empty(text)).cast("long") + F.lit(16)).alias("size"),
        F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
        shard_of(tree, F.col(key)).alias("shard"),
        grown_shard.alias("grown_shard"),
        F.xxhash64(F.monotonically_increasing_id()).alias("_salt"),
    ).withColumn("one", F.lit(1))
    placed = scratch_table(placed, "placed")  # the salt is drawn once
    order = [key, "text_crc32", "size", "_salt"]
    slots = with_running_start(
        placed, order, "one", group=["shard"],
        buckets=buckets_for(placed.count(), _ROWS_PER_BUCKET),
    )
    return slots.select(
        key, "size", "text_crc32", "shard", F.col("start").cast("long").alias("slot"), "grown_shard"
    )
