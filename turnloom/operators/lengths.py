"""How long sequences are, exactly, and what a greatest length would cut off."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (50, 90, 95, 99, 100)


def length_histogram(df: DataFrame, by: Sequence[str] = (), tokens: str = "tokens") -> DataFrame:
    """``by..., n_tokens, n_sequences``: how many sequences of each group have each length.

    Counts are made before the shuffle, so a task sends one row per group and length, however many
    sequences it has. Sequences that are NULL are left out. Histograms of parts of the data can be added up.
    """
    sizes = df.filter(F.col(tokens).isNotNull()).select(*by, F.size(tokens).cast("long").alias("n_tokens"))
    return sizes.groupBy(*by, "n_tokens").agg(F.count("*").alias("n_sequences"))


def merge_histograms(histograms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One histogram from several that were put below each other."""
    return histograms.groupBy(*by, "n_tokens").agg(F.sum("n_sequences").alias("n_sequences"))


def length_percentiles(
    histogram: DataFrame, by: Sequence[str] = (), percentiles: Sequence[float | str] = PERCENTILES
) -> DataFrame:
    """``by..., percentile, n_tokens``: the least length that so many percent of the sequences do not exceed.

    Exact: a running sum over a group's lengths, of which there are as many as differ. 0 gives the
    shortest. Fractions of a percent may be given as texts, such as "99.9".
    """
    shares = [(str(p), Fraction(str(p)) / 100) for p in percentiles]
    if any(not 0 <= share <= 1 for _, share in shares):
        raise ValueError(f"percentiles lie between 0 and 100, not {list(percentiles)}")
    group = list(by) or [F.lit(0)]
    so_far = Window.partitionBy(*group).orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    running = histogram.select(
        *by, "n_tokens", F.sum("n_sequences").over(so_far).alias("__upto"),
        F.sum("n_sequences").over(Window.partitionBy(*group)).alias("__all"),
    )

    def rank(share: Fraction):
        """The share of all, rounded up, at least one: in whole numbers."""
        part = F.col("__all") * F.lit(share.numerator)
        rest = F.pmod(part, F.lit(share.denominator))
        up = ((part - rest) / share.denominator).cast("long") + F.when(rest > 0, 1).otherwise(0)
        return F.greatest(up, F.lit(1).cast("long"))

    wanted = F.array(*[F.struct(F.lit(name).alias("percentile"), rank(share).alias("rank")) for name, share in shares])
    found = running.select(*by, "n_tokens", "__upto", F.inline(wanted)).filter(F.col("__upto") >= F.col("rank"))
    return found.groupBy(*by, "percentile").agg(F.min("n_tokens").alias("n_tokens"))


def length_coverage(histogram: DataFrame, max_lengths: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """``by..., max_length, n_sequences, n_truncated, n_tokens, kept_tokens``: what each greatest length keeps."""
    if any(m < 1 for m in max_lengths):
        raise ValueError(f"lengths are at least 1, not {list(max_lengths)}")
    tried = F.explode(F.array(*[F.lit(m).cast("long") for m in max_lengths])).alias("max_length")
    n, count = F.col("n_tokens"), F.col("n_sequences")
    return histogram.select("*", tried).groupBy(*by, "max_length").agg(
        F.sum(count).alias("n_sequences"),
        F.sum(F.when(n > F.col("max_length"), count).otherwise(0)).alias("n_truncated"),
        F.sum(n * count).alias("n_tokens"),
        F.sum(F.least(n, F.col("max_length")) * count).alias("kept_tokens"),
    )


def least_length(histogram: DataFrame, keep: float | str, by: Sequence[str] = ()) -> DataFrame:
    """``by..., max_length``: the least greatest length that keeps this share of a group's tokens.

    ``keep`` lies above 0 and at most at 1. Between two lengths that occur, each step keeps one more token of every
    longer sequence, so the answer follows from the running sums at the lengths that do. Groups
    without tokens are left out.
    """
    share = Fraction(str(keep))
    if not 0 < share <= 1:
        raise ValueError(f"keep is a share above 0, not {keep}")
    group = list(by) or [F.lit(0)]
    order = Window.partitionBy(*group).orderBy("n_tokens")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    n, count = F.col("n_tokens"), F.col("n_sequences")
    zero = F.lit(0).cast("long")
    shorter = F.coalesce(F.sum(n * count).over(before), zero)
    longer = F.sum(count).over(whole) - F.coalesce(F.sum(count).over(before), zero)  # these have n tokens or more
    last = F.coalesce(F.lag("n_tokens").over(order), zero)
    tokens = F.sum(n * count).over(whole)
    part = tokens * F.lit(share.numerator)
    rest = F.pmod(part, F.lit(share.denominator))
    needed = ((part - rest) / share.denominator).cast("long") + F.when(rest > 0, 1).otherwise(0)
    steps = histogram.select(*by, n, shorter.alias("__shorter"), longer.alias("__longer"), last.alias("__last"), needed.alias("__needed"))
    # With a greatest length m from the last length to this one, shorter + longer * m tokens are kept.
    enough = F.ceil((F.col("__needed") - F.col("__shorter")) / F.col("__longer")).cast("long")
    reached = steps.filter((n > 0) & (F.col("__shorter") + F.col("__longer") * n >= F.col("__needed")))
    at = F.greatest(enough, F.col("__last") + F.lit(0), F.lit(1).cast("long"))
    return reached.groupBy(*by).agg(F.min(at).alias("max_length")).filter(F.col("max_length").isNotNull())
