import math
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from turnloom import first_n, holdout
from turnloom.functions.exact import exact_text
from turnloom.operators import first as first_module
from turnloom.operators.holdout import _copies


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("n", [2, 10, 11, 999, 1000, 1001])
def test_exact_size_disjoint_and_covering(spark, n):
    train, test = holdout(spark.range(n), "id")
    assert test.count() == math.ceil(0.1 * n)
    assert sorted(ids(train) + ids(test)) == list(range(n))


def test_same_rows_as_ranking_by_hash(spark):
    _, test = holdout(spark.range(5000), "id", seed=9, fraction=0.25)
    ranked = sorted(range(5000), key=lambda i: md5(f"9:{i}".encode()).hexdigest())
    assert ids(test) == sorted(ranked[:1250])


def test_independent_of_partitioning_but_not_of_the_seed(spark):
    df = spark.range(2000)
    first = ids(holdout(df, "id", seed=1)[1])
    assert first == ids(holdout(df.repartition(17), "id", seed=1)[1])
    assert first != ids(holdout(df, "id", seed=2)[1])


@pytest.mark.parametrize("n, fraction", [(0, 0.1), (1, 0.1), (10, 0.95), (10, 0.0)])
def test_an_empty_side_raises(spark, n, fraction):
    with pytest.raises(ValueError, match="leaves a side empty"):
        holdout(spark.range(n), "id", fraction=fraction)


def test_composite_key(spark):
    df = spark.range(300).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    train, test = holdout(df, ["a", "b"])
    assert (train.count(), test.count()) == (270, 30)


def test_many_rows_walk_down_several_histograms(spark):
    df = spark.range(200_000)
    train, test = holdout(df, "id", fraction=0.3)
    assert test.count() == 60_000
    assert train.join(test, "id").count() == 0


@pytest.mark.parametrize("fraction", [0.1, 0.5, 0.9])
def test_copies_of_one_row_are_divided(spark, fraction):
    """A third or more of all rows are equal; the border may lie among them."""
    df = spark.range(600).select(
        F.when(F.col("id") < 400, F.lit("same")).otherwise(F.col("id").cast("string")).alias("content")
    )
    train, test = holdout(df, fraction=fraction)
    got = Counter(r["content"] for r in train.collect())
    held = Counter(r["content"] for r in test.collect())
    assert sum(held.values()) == math.ceil(fraction * 600)
    assert got + held == Counter(r["content"] for r in df.collect())


@pytest.mark.parametrize("fraction", [0.2, 0.5, 0.8])
def test_null_and_empty_are_not_copies_of_each_other(spark, fraction):
    df = spark.createDataFrame([(None,)] * 40 + [("",)] * 40, "content string")
    train, test = holdout(df, fraction=fraction)
    assert test.count() == 80 * fraction
    assert Counter(r[0] for r in train.union(test).collect()) == {None: 40, "": 40}


def test_rows_that_share_a_key_are_told_apart(spark):
    df = spark.range(600).select(
        F.when(F.col("id") < 500, F.lit(0)).otherwise(F.col("id")).alias("key"), "id"
    )
    for seed in range(4):
        train, test = holdout(df, "key", seed=seed, fraction=0.5)
        assert test.count() == 300
        assert sorted(ids(train) + ids(test)) == list(range(600))


def test_copies(spark):
    one = spark.createDataFrame([("x", [1, 2])], "a string, b array<int>")
    for n in (1, 9, 10, 11, 35):
        rows = _copies(one, n, chunk=10).collect()
        assert len(rows) == n and set(map(str, rows)) == {"Row(a='x', b=[1, 2])"}


def test_first_n(spark):
    df = spark.range(1000).repartition(9)
    assert ids(first_n(df, 50, "id")) == list(range(50))
    assert first_n(df, 2000, "id").count() == 1000


@pytest.mark.parametrize("n", [1, 100, 999, 1000, 1001])
def test_first_many(spark, monkeypatch, n):
    monkeypatch.setattr(first_module, "_SMALL", 0)
    df = spark.range(1000).repartition(9)
    assert ids(first_n(df, n, "id")) == list(range(min(n, 1000)))


@pytest.mark.parametrize("n", [5, 10, 200, 500, 612])
def test_first_many_with_nulls_and_a_hot_key(spark, monkeypatch, n):
    monkeypatch.setattr(first_module, "_SMALL", 0)
    key = F.when(F.col("id") < 10, None).when(F.col("id") < 600, 7).otherwise(F.col("id"))
    df = spark.range(900).select(key.alias("key"), "id").repartition(9)
    rows = first_n(df, n, "key").collect()
    expected = sorted((r["key"] for r in df.collect()), key=lambda k: -1 if k is None else k)[:n]
    assert Counter(r["key"] for r in rows) == Counter(expected)
    assert len({r["id"] for r in rows}) == n


@pytest.mark.parametrize("small", [0, 10_000])
def test_ties_are_ordered_alike_in_any_partitioning(spark, monkeypatch, small):
    df = spark.range(500).select((F.col("id") % 3).alias("key"), "id", F.lit("x").alias("t"))
    expected = ids(first_n(df.repartition(1), 200, "key"))
    monkeypatch.setattr(first_module, "_SMALL", small)
    for parts in (3, 11):
        assert ids(first_n(df.repartition(parts), 200, "key")) == expected


@pytest.mark.parametrize("small", [0, 10_000])
def test_first_by_two_keys(spark, monkeypatch, small):
    monkeypatch.setattr(first_module, "_SMALL", small)
    df = spark.range(300).select((F.col("id") % 7).alias("a"), F.col("id").alias("id")).repartition(5)
    rows = sorted((i % 7, i) for i in range(300))
    assert ids(first_n(df, 100, ["a", "id"])) == sorted(i for _, i in rows[:100])


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo", "UTC"])
def test_local_times_as_keys(spark, monkeypatch, zone):
    monkeypatch.setattr(first_module, "_SMALL", 0)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        at = "timestamp_ntz'2024-03-10 01:59:59.999990' + make_dt_interval(0, 0, 0, cast(id as decimal(18, 6)) / 1000000)"
        df = spark.range(3000).selectExpr(f"{at} as at", "id").repartition(4)
        assert ids(first_n(df, 1234, "at")) == list(range(1234))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


PAIRS_OF_VALUES = {
    "timestamp_ntz": "timestamp_ntz'2020-01-01 00:00:00.000001' + make_dt_interval(0, 0, 0, cast(id as decimal(18, 6)) / 1000000)",
    "timestamp": "timestamp_micros(1600000000000000 + id)",
    "double": "case when id = 0 then 0.0D when id = 1 then -0.0D else id / 3.0D end",
    "decimal": "cast(id / 1000 as decimal(20, 4))",
    "date": "date_add(date'2020-01-01', cast(id as int))",
    "binary": "case when id = 0 then null else unhex(hex(id)) end",
    "string": "cast(unhex(concat('FF', lpad(hex(id), 4, '0'))) as string)",
    "array": "case when id = 0 then array() when id = 1 then array(null) else array(null, id) end",
    "struct": "named_struct('a', case when id % 2 = 0 then cast(id as string) end, 'b', case when id % 2 = 1 then cast(id - 1 as string) end)",
    "map": "map('k', id)",
    "nested": "array(named_struct('t', timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, 0, cast(id as decimal(18, 6)) / 1000000)))",
}


@pytest.mark.parametrize("kind", PAIRS_OF_VALUES)
@pytest.mark.parametrize("key", [(), "k"])
def test_no_row_is_taken_for_a_copy_of_another(spark, kind, key):
    df = spark.range(40).selectExpr("'same' as k", f"{PAIRS_OF_VALUES[kind]} as v").repartition(3)
    train, test = holdout(df, key, fraction=0.3)
    exact = lambda x: sorted(r[0] for r in x.select(exact_text(df.schema)).collect())
    assert test.count() == 12
    assert len(set(exact(df))) == 40
    assert exact(train.unionByName(test)) == exact(df)


@pytest.mark.parametrize("groups", [2, 10, 99])
def test_groups_stay_together(spark, groups):
    df = spark.range(1000).select((F.col("id") % groups).alias("g"), "id").repartition(5)
    train, test = holdout(df, "id", fraction=0.3, together="g")
    sides = [{r["g"] for r in side.select("g").distinct().collect()} for side in (train, test)]
    assert not sides[0] & sides[1] and len(sides[1]) == math.ceil(0.3 * groups)
    assert sorted(ids(train) + ids(test)) == list(range(1000))
