from collections import defaultdict

import oracle
import pytest
from conftest import ordered
from pyspark.sql import functions as F

import brute
from turnloom.llm import queries, systematic


def targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = sum(weight[s] for s in names if s not in capped)
        level = (total - sum(cap * sizes[s] for s in capped)) / free if free else 0
        over = {s for s in names if weight[s] * level > cap * sizes[s]} | capped
        if over == capped or not free:
            return {s: cap * sizes[s] if s in capped else weight[s] * level for s in names}
        capped = over


def test_targets_and_copies(documents):
    rows = systematic.mix(documents, keep=["source"]).collect()
    by_source, sizes, longest = defaultdict(int), defaultdict(int), max(r["size"] for r in rows)
    for r in rows:
        sizes[r["source"]] += r["size"]
        by_source[r["source"]] += r["copies"] * r["size"]
        assert 0 <= r["copies"] <= 3
    expected = targets(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(expected[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
    assert all(abs(by_source[s] - expected[s]) <= 2 * longest for s in sizes)
    got = sorted((r["size"] for r in rows))
    assert got == sorted(len(brute.words(r["text"])) for r in documents.collect())


def test_excess_is_shared_again(spark):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 4}" if i >= 40 else "tiny") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = systematic.mix(df, weights=(1, 2, 30), keep=["source"]).groupBy("source", "source_size").agg(
        F.first("target"), F.sum(F.col("copies") * F.col("size"))
    ).collect()
    assert sum(r[2] for r in got) == pytest.approx(sum(r[1] for r in got))
    assert all(t <= 3 * s + 1e-6 and abs(t - taken) <= 10 for _, s, t, taken in got)


def test_reruns_agree_in_any_partitioning(documents):
    columns = ["doc_id", "size", "source_size", "target", "copies"]
    one = systematic.mix(documents.repartition(1)).select(columns).collect()
    assert ordered(one) == ordered(systematic.mix(documents.repartition(11)).select(columns).collect())


def test_odd_tables(documents, no_documents, spark):
    assert systematic.mix(no_documents).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r["size"], r["target"], r["copies"]) for r in systematic.mix(empty).collect()} == {(0, 0.0, 0)}


def test_query_equals_its_oracle(spark):
    for name in ("op3_impact_index", "op5_line_dedup", "op10_systematic"):
        assert oracle.difference(spark, name, "/root/testdata/sf0.001") is None


def test_oracle_shares_the_excess(spark, tmp_path):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 4}" if i >= 40 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    next((tmp_path / "in").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert oracle.difference(spark, "op10_systematic", str(tmp_path)) is None
