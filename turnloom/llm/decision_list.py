"""Quality rules: decision lists learned from labelled statistics of texts.

The statistics and the finished rules are native expressions. Learning happens on the
driver over a bounded number of labelled rows of numbers, never of texts.
"""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import bounded_sample, let, text_or_empty

MAX_LABELLED = 20_000
_SPACE = r"[\x20\x09-\x0D]"
_POSITION = (1 << 20) - 1  # bits of a position when it shares a long with a hash

#: What rules may test, each computed from the statistics.
FEATURES = {
    "words": lambda: F.col("n_words"),
    "chars_per_word": lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    "symbols_per_word": lambda: F.col("n_symbols") / F.greatest("n_words", F.lit(1)),
    "dup_lines_per_line": lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    "repeat_share": lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
    "distinct_share": lambda: F.col("n_distinct_words") / F.greatest("n_words", F.lit(1)),
}


def _covered(hashes: Column, keyed: Column, position) -> Column:
    """Words under windows whose hash occurs again. ``keyed``: sorted hashes with positions."""
    at = lambda k: F.get(hashes, position(k).cast("int"))

    def positions(ks: Column) -> Column:
        again = lambda k, i: (at(F.get(ks, i - 1)) == at(k)) | (at(F.get(ks, i + 1)) == at(k))
        return F.sort_array(F.transform(F.filter(ks, again), position))

    # Each window covers its three words, or those up to the next repeated window.
    lengths = lambda ps: F.transform(ps, lambda p, i: F.least(F.get(ps, i + 1) - p, F.lit(3)))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    return let(keyed, lambda ks: let(positions(ks), lambda ps: total(lengths(ps))))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in ``words``.

    Most texts have no such window, which their distinct hashes tell. Otherwise hashes are
    sorted with their positions, packed into one long (the upper 44 bits of the hash; neighbours
    are compared by their whole hashes) or, above a million words, as pairs.
    """
    size = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(0), size - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def count(hs: Column) -> Column:
        pack = lambda h, i: h.bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("long"))
        packed = F.sort_array(F.transform(hs, pack))
        pairs = F.sort_array(
            F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))
        )
        low = lambda k: k.bitwiseAND(F.lit(_POSITION))
        return (
            F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long"))
            .when(F.size(hs) <= _POSITION, _covered(hs, packed, low))
            .otherwise(_covered(hs, pairs, lambda k: k["i"]))
        )

    return F.when(size < 3, F.lit(0).cast("long")).otherwise(let(hashes, count))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and the long columns ``n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_distinct_words``; columns of these names are replaced.

    Words are runs of anything but ASCII white space, as written. ``n_lines`` are lines with
    a word. A NULL or empty text has zeros throughout.
    """
    body = text_or_empty(text)
    words = F.filter(F.split(body, f"{_SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            F.size(F.array_distinct(w)).cast("long").alias("distinct"),
            _repeat_words(w).alias("repeat"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
        ),
    )
    # A one-row generator keeps the structs from being computed once per field.
    tag = uuid.uuid4().hex[:8]  # internal names that no caller's column has
    words_tag, lines_tag = f"_words_{tag}", f"_lines_{tag}"
    measured = docs.withColumn(words_tag, F.explode(F.array(of_words))).withColumn(
        lines_tag, F.explode(F.array(of_lines))
    )
    columns = {
        "n_words": F.col(words_tag)["n"],
        "word_chars": (F.char_length(body) - F.regexp_count(body, F.lit(_SPACE))).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": F.col(lines_tag)["n"],
        "n_dup_lines": F.col(lines_tag)["dup"],
        "n_repeat_words": F.col(words_tag)["repeat"],
        "n_distinct_words": F.col(words_tag)["distinct"],
    }
    return measured.withColumns(columns).drop(words_tag, lines_tag)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(feature, "<=" or ">", threshold)``, and how it did in training."""

    conditions: tuple[tuple[str, str, float], ...]
    rejected: int
    wrongly: int

    def expression(self) -> Column:
        test = F.lit(True)
        for feature, sign, bound in self.conditions:
            value = FEATURES[feature]().cast("double")
            test = test & (value <= F.lit(bound) if sign == "<=" else value > F.lit(bound))
        return test

    def __str__(self) -> str:
        return " and ".join(f"{f} {s} {b:.6g}" for f, s, b in self.conditions)


def verdict(rules: Sequence[Rule]) -> Column:
    """True to keep: the first rule that applies rejects, and nothing else does."""
    column = F.lit(True)
    for rule in reversed(rules):
        column = F.when(rule.expression(), F.lit(False)).otherwise(column)
    return column


# --- learning ------------------------------------------------------------------

Example = tuple[tuple[float, ...], bool]  # feature values, bad


def _covers(conditions: Sequence[tuple[int, str, float]], x: Sequence[float]) -> bool:
    return all(x[f] <= b if s == "<=" else x[f] > b for f, s, b in conditions)


def _counts(conditions, examples: Sequence[Example]) -> tuple[int, int]:
    covered = [bad for x, bad in examples if _covers(conditions, x)]
    return sum(covered), len(covered) - sum(covered)


def _best_literal(examples: Sequence[Example]) -> tuple[float, tuple[int, str, float]] | None:
    """The threshold with the highest information gain (bits saved on the bad examples)."""
    bad = sum(b for _, b in examples)
    if not bad or bad == len(examples):
        return None
    prior = math.log2(bad / len(examples))
    best = None
    for f in range(len(examples[0][0])):
        ordered = sorted((x[f], b) for x, b in examples)
        below = seen = 0
        for (value, b), (after, _) in zip(ordered, ordered[1:]):
            below, seen = below + b, seen + 1
            if value == after:
                continue
            bound = (value + after) / 2
            for sign, p, n in (("<=", below, seen), (">", bad - below, len(ordered) - seen)):
                if p:
                    gain = p * (math.log2(p / n) - prior)
                    if best is None or gain > best[0]:
                        best = (gain, (f, sign, bound))
    return best


def learn_rules(
    examples: Sequence[Example],
    names: Sequence[str],
    min_precision: float = 0.98,
    min_support: int = 5,
    max_rules: int = 20,
    seed: int = 42,
) -> list[Rule]:
    """Sequential covering. A rule is grown on two thirds of what is left, pruned on the rest
    to its most precise beginning, and kept if on all that is left it rejects at least
    ``min_support`` bad examples and ``min_precision`` of what it rejects is bad."""
    left = list(examples)
    random.Random(seed).shuffle(left)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        cut = 2 * len(left) // 3
        covered, held_out = left[:cut], left[cut:]
        conditions: list[tuple[int, str, float]] = []
        while len(conditions) < 6 and (found := _best_literal(covered)) and found[0] > 0:
            conditions.append(found[1])
            covered = [e for e in covered if _covers(conditions[-1:], e[0])]
        if not conditions:
            break

        def worth(length: int) -> float:
            p, n = _counts(conditions[:length], held_out)
            return (p - n) / (p + n) if p + n else -1.0

        length = max(range(1, len(conditions) + 1), key=lambda k: (worth(k), -k))
        conditions = conditions[:length]
        p, n = _counts(conditions, left)
        if p < min_support or p < min_precision * (p + n):
            break
        rules.append(Rule(tuple((names[f], s, b) for f, s, b in conditions), p, n))
        left = [e for e in left if not _covers(conditions, e[0])]
    return rules


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_labelled: int = MAX_LABELLED,
    **options,
) -> list[Rule]:
    """Rules that reject texts like those labelled 0, from at most ``max_labelled`` labelled keys.

    With more of them, those with the smallest hashes are taken, and where keys repeat with other texts, so are
    at most as many different examples. Labels of NULL
    or without a document are left out, as are texts that fail the base rules, which never
    reach the list. Without any label, or with labels of one kind, there are no rules.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    known = known.filter(F.col("_label").isNotNull())
    chosen = bounded_sample(known, "_key", max_labelled)
    chosen = known.join(F.broadcast(chosen), "_key").groupBy("_key").agg(F.min("_label").alias("_label"))
    labelled = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(
        F.broadcast(chosen), "_key"  # bounded by max_labelled
    )
    rows = (
        with_statistics(labelled, "_text")
        .filter(~base_failed())
        .select(
            *[f().cast("double").alias(n) for n, f in FEATURES.items()],
            (F.col("_label") == 0).alias("bad"),
        )
        .groupBy(*FEATURES, "bad").count()  # repeated rows are one example each time
        .orderBy(F.xxhash64(*FEATURES, "bad"), *FEATURES, "bad").limit(max_labelled).collect()
    )
    rows.sort(key=tuple)
    examples = [(tuple(r[:-2]), r["bad"]) for r in rows for _ in range(min(r["count"], max_labelled))]
    return learn_rules(examples, list(FEATURES), **options)


def judge(docs: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """:func:`with_statistics` plus ``base_failed`` and ``kept``; one projection, no shuffle."""
    failed = base_failed()
    judged = with_statistics(docs, text).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(rules))
