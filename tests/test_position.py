"""Rows in the order of their files."""

import pytest
from pyspark.sql import functions as F

from turnloom import batch_infer, first_n, with_position
from turnloom.operators import position as position_module

FORMATS = ["parquet", "orc", "json", "csv", "text"]


def written(spark, folder, fmt, parts=7, rows=500):
    """Files of different lengths, an empty one among them; the texts say where they lie."""
    sizes = [(rows * (i + 1)) // (parts * (parts + 1) // 2) for i in range(parts)]
    expected = []
    for i, size in enumerate(sizes):
        own = [f"{i}-{j:04d} text" for j in range(0 if i == 2 else size)]
        expected += own
        df = spark.createDataFrame([(t,) for t in own], "text string").coalesce(1)
        part = f"{folder}/part{i}"
        df.write.format(fmt).save(part)
    df = spark.read.format(fmt).schema("text string").load([f"{folder}/part{i}" for i in reversed(range(parts))])
    return df, expected


@pytest.mark.parametrize("fmt", FORMATS)
def test_positions(spark, tmp_path, fmt):
    df, expected = written(spark, tmp_path, fmt)
    got = {r["position"]: r["text"] for r in with_position(df).collect()}
    assert [got[i] for i in range(len(expected))] == expected and len(got) == len(expected)


@pytest.mark.parametrize("fmt", FORMATS)
@pytest.mark.parametrize("small", [10_000, 0])
def test_first_rows(spark, tmp_path, monkeypatch, fmt, small):
    monkeypatch.setattr(position_module, "_SMALL", small)
    df, expected = written(spark, tmp_path, fmt)
    for n in (0, 18, 211, len(expected), 10_000) if small else (1, 211):
        assert sorted(r["text"] for r in first_n(df, n).collect()) == expected[:n]


@pytest.mark.parametrize("fmt", ["json", "text", "csv"])
def test_files_in_many_pieces(spark, tmp_path, fmt):
    """A file that is read by several tasks keeps its order."""
    df, expected = written(spark, tmp_path, fmt, rows=20_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        assert df.rdd.getNumPartitions() > 20
        got = {r["position"]: r["text"] for r in with_position(df).collect()}
        assert [got[i] for i in range(len(expected))] == expected
        assert sorted(r["text"] for r in first_n(df, 9000).collect()) == expected[:9000]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_left_out_before(spark, tmp_path):
    df, expected = written(spark, tmp_path, "parquet")
    some = df.filter(F.col("text").rlike("[02468] text$"))
    left = [t for t in expected if t[-6] in "02468"]
    for n in (1, 40, 100):
        assert sorted(r["text"] for r in first_n(some, n).collect()) == left[:n]
    with pytest.raises(ValueError, match="left out"):
        with_position(some)


def test_only_the_files_that_are_needed_are_read(spark, tmp_path):
    df, expected = written(spark, tmp_path, "parquet")
    first = first_n(df, 20)
    first.collect()
    scan = first._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan or "file_path" in scan
    last = max(p for p in (tmp_path / "part6").glob("*.parquet"))
    last.write_bytes(last.read_bytes()[:8] + b"broken")
    assert sorted(r["text"] for r in first.collect()) == expected[:20]
    with pytest.raises(Exception):
        df.collect()


def test_columns_and_errors(spark, tmp_path):
    df, _ = written(spark, tmp_path, "parquet")
    made = df.select(F.upper("text").alias("a b"), F.lit(1).alias("n"))
    assert with_position(made, "at").columns == ["a b", "n", "at"]
    with pytest.raises(ValueError, match="already a column"):
        with_position(made, "n")
    with pytest.raises(ValueError, match="read from files"):
        with_position(spark.range(3))
    assert with_position(df.filter("false")).count() == 0
    assert first_n(df.filter("false"), 5).count() == 0


def test_inference_without_a_key(spark, tmp_path):
    df, expected = written(spark, tmp_path, "json")
    echo = lambda **_: lambda prompts: [p.split("\n")[1] for p in prompts]
    for n, some in ((None, expected), (33, expected[:33])):
        got = batch_infer(df, None, echo, n=n).collect()
        assert [r["output"] for r in sorted(got, key=lambda r: r["position"])] == some
        assert sorted(r["position"] for r in got) == list(range(len(some)))
