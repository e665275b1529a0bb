"""Turn tables (one row per message) to conversations and question/answer pairs.

A conversation is collected in one group only while it is short. Longer ones are
found by a count beforehand and cut into parts of ``max_messages`` messages, so
that no group grows with the data, however the turns are spread. The caller has to choose
that length, as it decides which rows come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.plans.ordered import with_running_start
from turnloom.plans.scratch import scratch_table

_FEW = 200_000  # long conversations whose list is broadcast: some megabytes
_SALTS = 32


def collect_messages(
    df: DataFrame,
    conv: str,
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    *,
    max_messages: int,
    max_bytes: int | None = None,
) -> DataFrame:
    """``conv, part, is_last, messages``, messages being ``{turn, role, content}``.

    They are in turn order; equal turns are ordered by role and then by the md5 of their text. A
    conversation of up to ``max_messages`` is one row, part 0; a longer one has
    several parts. A part is one row, so ``max_messages`` texts must fit into one.

    ``max_bytes`` bounds the texts of a part, too: a conversation with more bytes (of UTF-8) has
    parts of as many messages as would fit if all were as long as its longest, one at least.
    """
    rows, long = _split_long(df, conv, turn, role, text, max_messages, max_bytes)
    rows = rows.withColumnRenamed("text", "content")
    # Collecting on the map side would only sort the rows twice.
    short = rows.repartition("conv").groupBy("conv").agg(
        F.lit(0).cast("long").alias("part"),
        F.lit(True).alias("is_last"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("turn", "role", "mark", "content"))),
            lambda m: F.struct(m["turn"].alias("turn"), m["role"].alias("role"), m["content"].alias("content")),
        ).alias("messages"),
    )
    if long is None:
        return short.withColumnRenamed("conv", conv)

    placed = with_running_start(long, ["turn", "role", "mark"], "copies", ["conv"], ["text"])
    low = F.greatest(F.col("start"), F.col("part") * F.col("part_len"))
    high = F.least(F.col("start") + F.col("copies"), (F.col("part") + 1) * F.col("part_len"))
    touched = F.expr("sequence(start div part_len, (start + copies - 1) div part_len)")
    message = F.struct("turn", "role", F.col("text").alias("content")).alias("message")
    parts = (
        placed.select("conv", "n", "part_len", "start", "copies", message, F.explode(touched).alias("part"))
        .select(
            "conv", "n", "part_len", "part", low.alias("pos"), (high - low).cast("int").alias("times"), "message"
        )
        .groupBy("conv", "n", "part_len", "part")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "times", "message"))).alias("items"))
        .select(
            "conv",
            "part",
            F.expr("part = (n - 1) div part_len").alias("is_last"),
            F.flatten(
                F.transform("items", lambda i: F.array_repeat(i["message"], i["times"]))
            ).alias("messages"),
        )
    )
    return short.unionByName(parts).withColumnRenamed("conv", conv)


def collect_pairs(
    df: DataFrame,
    conv: str,
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    *,
    max_messages: int,
) -> DataFrame:
    """``conv, turn, question, answer``: each user turn directly followed by an
    assistant turn. ``turn`` is that of the user."""
    rows, long = _split_long(df, conv, turn, role, text, max_messages)
    pairs = _adjacent(
        rows.select("*", F.lit(True).alias("own")),
        Window.partitionBy("conv").orderBy("turn", "role", "mark", "text"),
    )
    if long is not None:
        ranked = with_running_start(
            long.select("*", F.lit(1).cast("long").alias("one")),
            ["turn", "role", "mark"], "one", ["conv"], ["text"],
        )
        # The first row of each block is also seen by the block before it.
        block = F.expr(f"start div {max_messages}")
        seen_by = F.when(
            (F.col("start") > 0) & (F.col("start") % max_messages == 0),
            F.array(block, block - 1),
        ).otherwise(F.array(block))
        blocks = ranked.select("*", F.explode(seen_by).alias("block")).withColumn(
            "own", F.col("block") == block
        )
        pairs = pairs.unionByName(
            _adjacent(blocks, Window.partitionBy("conv", "block").orderBy("start"))
        )
    return pairs.withColumnsRenamed({"conv": conv, "turn": turn})


def _adjacent(rows: DataFrame, order) -> DataFrame:
    following = F.lead(F.struct("role", "text")).over(order)
    return (
        rows.withColumn("following", following)
        .filter("own AND role = 'user' AND following.role = 'assistant'")
        .select(
            "conv",
            "turn",
            F.col("text").alias("question"),
            F.col("following.text").alias("answer"),
        )
    )


def _split_long(
    df: DataFrame, conv: str, turn: str, role: str, text: str, max_messages: int, max_bytes: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """The turns of short conversations, and those of long ones if there are any.

    Long ones have their number of messages ``n`` and the length of their parts ``part_len``.
    Copies of one turn in a long conversation become one row with their number,
    before they are shuffled, so a turn that fills much of the table stays small.
    """
    rows = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
    )
    rows = rows.withColumn("mark", F.md5("text"))
    part_len, measures = F.lit(max_messages).cast("long"), [F.count("*").alias("n")]
    if max_bytes is not None:
        size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
        measures += [F.sum(size).alias("bytes"), F.max(size).alias("longest")]
        fitting = F.expr(f"greatest({max_bytes}L div greatest(longest, 1L), 1L)")
        part_len = F.when(F.col("bytes") > max_bytes, F.least(part_len, fitting)).otherwise(part_len)
    counts = rows.groupBy("conv").agg(*measures).select("conv", "n", part_len.alias("part_len"))
    counts = counts.filter(F.col("n") > F.col("part_len"))
    known = scratch_table(counts, "long-conversations")
    n_long = known.count()
    if n_long == 0:
        return rows, None
    if n_long <= _FEW:
        known, salted = F.broadcast(known), rows
    else:  # the rows of a long conversation are spread before they are joined
        salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
        known = known.withColumn("salt", salts)
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("turn", "role", "mark"), F.lit(_SALTS)).cast("int"))
    known = known.withColumnsRenamed({"conv": "long_conv", "salt": "long_salt"})
    is_long = F.col("conv").eqNullSafe(F.col("long_conv"))
    if n_long > _FEW:
        is_long = is_long & (F.col("salt") == F.col("long_salt"))
    long = (
        salted.join(known, is_long)
        .groupBy("conv", "n", "part_len", "turn", "role", "mark", "text")
        .agg(F.count("*").alias("copies"))
    )
    short = salted.join(known, is_long, "left_anti").drop("salt")
    return short, scratch_table(long, "long-turns")
