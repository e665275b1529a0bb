"""Removing lines that many documents share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import SPACE, ascii_lower, let, text_or_empty
from turnloom.plans.scratch import scratch_table

_HOT_SHARE = 1000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _without(lines: Column, dropped: Column) -> Column:
    """The lines whose positions are not in the sorted array ``dropped``, in linear time:
    the slices between one dropped position and the next."""
    cuts = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
    return let(
        F.struct(lines.alias("lines"), cuts.alias("cuts")),
        lambda x: F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.size(x["cuts"]) - 2),
                lambda i: F.slice(
                    x["lines"],
                    F.get(x["cuts"], i) + 2,
                    F.get(x["cuts"], i + 1) - F.get(x["cuts"], i) - 1,
                ),
            )
        ),
    )


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 3, min_chars: int = 20
) -> DataFrame:
    """``docs`` with shared lines taken out of ``text``, plus ``n_lines`` and ``n_dropped``.

    Texts are split at line feeds; a NULL or empty text is one empty line. Lines are compared
    without outer ASCII white space and with A-Z in lower case. A line of at least
    ``min_chars`` code points that occurs under at least ``min_docs`` different keys is
    dropped everywhere but in the row(s) with the largest key that holds it. A NULL key counts as no
    document, and its row loses shared lines. Rows that repeat a key are one document, and each
    is treated like its first. A NULL text becomes empty. Other columns pass unchanged;
    existing columns ``n_lines`` and ``n_dropped`` are replaced.

    Lines travel as 16-byte hashes with their positions. Counting is pre-aggregated per
    document and task. Lines so frequent that a shuffle by hash would be lopsided, at most
    1000 of them by definition, are looked up in a broadcast; others are joined by hash. Texts are
    shuffled once, to meet the positions that they lose.
    """
    tag = uuid.uuid4().hex[:8]  # internal names that no caller's column has
    k, th, pos, h, cut = (f"_{name}_{tag}" for name in ("key", "text", "pos", "hash", "cut"))
    body = text_or_empty(text)
    source = docs.withColumn(th, F.xxhash64(body))

    line = F.btrim(F.col("col"), F.lit(SPACE))
    exploded = source.select(
        F.col(key).alias(k), th, F.posexplode(_lines(ascii_lower(body))).alias("pos", "col")
    )
    lines = scratch_table(
        exploded.select(k, th, F.col("pos").alias(pos), line.alias("line"))
        .filter(F.char_length("line") >= min_chars)
        .select(k, th, pos, F.unhex(F.md5("line")).alias(h)),
        "lines",
    )

    shared = scratch_table(
        lines.groupBy(h)
        .agg(F.countDistinct(k).alias("docs"), F.max(k).alias("last"), F.count("*").alias("n"))
        .filter(F.col("docs") >= min_docs)
        .select(h, "last", "n"),
        "shared-lines",
    )
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    hot = F.col("n") * _HOT_SHARE >= total
    frequent = F.broadcast(shared.filter(hot).select(h, "last"))  # at most 1000 rows
    other = shared.filter(~hot).select(h, "last")
    lost = lines.join(frequent, h).unionByName(
        lines.join(frequent.select(h), h, "left_anti").join(other, h)
    )
    cuts = (
        lost.filter(~F.col(k).eqNullSafe(F.col("last")))
        .groupBy(k, th)
        .agg(F.sort_array(F.collect_set(pos)).alias(cut))
        .withColumnRenamed(th, f"{th}_cut")
    )
    same = source[key].eqNullSafe(cuts[k]) & (source[th] == cuts[f"{th}_cut"])
    joined = source.join(cuts, same, "left")
    kept = F.when(F.col(cut).isNull(), body).otherwise(
        F.array_join(_without(_lines(body), F.col(cut)), "\n")
    )
    n_lines = F.size(_lines(body)).cast("long")
    n_dropped = F.coalesce(F.size(F.col(cut)), F.lit(0)).cast("long")
    replaced = {text: kept, "n_lines": n_lines, "n_dropped": n_dropped}
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    return joined.select(*[replaced.get(c, F.col(f"`{c}`")).alias(c) for c in names])
