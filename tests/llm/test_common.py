import pytest
from pyspark.sql import functions as F

import brute
from turnloom.llm import common


@pytest.mark.parametrize("rows, most", [(0, 10), (50, 100), (3000, 100), (3000, 2999), (3000, 1)])
def test_bounded_sample(spark, rows, most):
    df = spark.range(rows).withColumnRenamed("id", "k").unionByName(spark.createDataFrame([(None,)], "k long"))
    df = df.unionByName(df).repartition(5)
    got = {r["k"] for r in common.bounded_sample(df, "k", most).collect()}
    assert len(got) <= most and None not in got
    assert got == {r["k"] for r in common.bounded_sample(df.repartition(3), "k", most).collect()}
    if 2 * rows <= most:
        assert got == set(range(rows))
    if rows > most >= 100:
        assert len(got) >= most / 2


@pytest.mark.parametrize("distinct, most", [(1000, 3000), (1000, 1000), (10, 100), (5000, 300)])
def test_repeated_keys_do_not_shrink_the_sample(spark, distinct, most):
    """As many of the distinct keys as are allowed, however often they repeat."""
    df = spark.range(200_000).select((F.col("id") % distinct).alias("k"))
    got = {r["k"] for r in common.bounded_sample(df, "k", most).collect()}
    assert got == {r["k"] for r in common.bounded_sample(spark.range(distinct).withColumnRenamed("id", "k"), "k", most).collect()}
    assert len(got) == distinct if distinct <= most else most / 2 <= len(got) <= most


def test_ascii_lower(spark):
    texts = ["ABC xyz", "ÀÉ ABC", "İI", "", "ẞ Z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(common.ascii_lower(F.col("t"))).collect()] == [t.translate(brute.LOWER) for t in texts]
