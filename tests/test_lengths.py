import math
import random

import pytest
from pyspark.sql import functions as F

from turnloom import least_length, length_coverage, length_histogram, length_percentiles, merge_histograms


def table(spark, n=3000):
    rng = random.Random(9)
    rows = [(rng.choice("ab") if i % 3 else "hot", int(rng.expovariate(1 / 40))) for i in range(n)] + [(None, 5), ("none", 0)]
    df = spark.createDataFrame(rows, "source string, n int").repartition(4)
    tokens = F.when(F.col("n") > 0, F.array_repeat(F.lit("t"), F.col("n"))).otherwise(F.array().cast("array<string>"))
    sizes = {}
    for s, k in rows:
        sizes.setdefault(s, []).append(k)
    return df.select("source", tokens.alias("tokens")), {s: sorted(v) for s, v in sizes.items()}


def test_percentiles(spark):
    df, sizes = table(spark)
    wanted = (0, 1, 50, 90, "99.9", 100)
    got = {(r["source"], r["percentile"]): r["n_tokens"] for r in length_percentiles(length_histogram(df, ["source"]), ["source"], wanted).collect()}
    assert got == {(s, str(p)): v[max(1, math.ceil(round(float(p) * len(v) / 100, 9))) - 1] for s, v in sizes.items() for p in wanted}
    every = sorted(k for v in sizes.values() for k in v)
    one = {r["percentile"]: r["n_tokens"] for r in length_percentiles(length_histogram(df)).collect()}
    assert one == {str(p): every[math.ceil(p * len(every) / 100) - 1] for p in (50, 90, 95, 99, 100)}


def test_parts_add_up(spark):
    df, _ = table(spark)
    parts = length_histogram(df.filter("source = 'a'")).unionByName(length_histogram(df.filter("source <> 'a' OR source IS NULL")))
    assert sorted(merge_histograms(parts).collect()) == sorted(length_histogram(df).collect())


def test_coverage(spark):
    df, sizes = table(spark)
    got = length_coverage(length_histogram(df, ["source"]), [1, 32, 10**6], ["source"]).collect()
    assert len(got) == 3 * len(sizes)
    for r in got:
        v, m = sizes[r["source"]], r["max_length"]
        assert tuple(r)[2:] == (len(v), sum(k > m for k in v), sum(v), sum(min(k, m) for k in v))


@pytest.mark.parametrize("keep", [0.001, 0.5, "0.95", 0.999, 1])
def test_least_length(spark, keep):
    df, sizes = table(spark)
    got = {r["source"]: r["max_length"] for r in least_length(length_histogram(df, ["source"]), keep, ["source"]).collect()}
    for s, v in sizes.items():
        if sum(v) == 0:
            assert s not in got
            continue
        need = math.ceil(round(float(keep) * sum(v), 6))
        assert got[s] == next(m for m in range(1, max(v) + 1) if sum(min(k, m) for k in v) >= need)


def test_nothing_and_wrong_settings(spark):
    df, _ = table(spark, 3)
    none = length_histogram(df.limit(0))
    assert none.count() == length_percentiles(none).count() == length_coverage(none, [5]).count() == least_length(none, 0.5).count() == 0
    histogram = length_histogram(df)
    for wrong in (lambda: length_percentiles(histogram, (), [101]), lambda: length_coverage(histogram, [0]), lambda: least_length(histogram, 0)):
        with pytest.raises(ValueError):
            wrong()


def test_counts_before_the_shuffle(spark):
    df, _ = table(spark)
    plan = length_histogram(df, ["source"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Python" not in plan
