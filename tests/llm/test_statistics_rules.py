import random

import pytest
from conftest import ordered
from pyspark.sql import functions as F

import brute
from turnloom.llm import decision_list as dl
from turnloom.llm import queries

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics(documents, doc_rows):
    got = dl.with_statistics(documents).select("doc_id", *BASE).collect()
    expected = [(k, *[brute.statistics(t)[c] for c in BASE]) for k, t in doc_rows]
    assert ordered(got) == ordered(expected)


def test_repeated_windows(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = dict(dl.with_statistics(df).select("doc_id", "n_repeat_words").collect())
    assert got == {i: brute.statistics(t)["n_repeat_words"] for i, t in enumerate(texts)}


def test_windows_as_pairs(spark, monkeypatch):
    """The way of texts with over a million words."""
    monkeypatch.setattr(dl, "_POSITION", 3)
    df = spark.createDataFrame([(1, "a b c d a b c x y a b c d z")], "doc_id long, text string")
    assert dl.with_statistics(df).head()["n_repeat_words"] == brute.statistics("a b c d a b c x y a b c d z")["n_repeat_words"]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op7_decision_list(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    for key, text in rows:
        s = brute.statistics(text)
        assert [got[key][c] for c in BASE] == [s[c] for c in BASE]
        failed = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
        assert got[key]["base_failed"] == failed
        assert not (failed and got[key]["kept"])


def test_held_out_labels(spark):
    """Rules from half of the labels hold for the other half, and hardly reject good texts."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rules = dl.fit(docs, labels.filter("doc_id % 2 = 0"))
    assert rules
    judged = dl.judge(docs, rules).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed")
    good, lost, bad, caught = judged.agg(
        F.count(F.when(F.col("quality") == 1, 1)), F.count(F.expr("case when quality = 1 and not kept then 1 end")),
        F.count(F.when(F.col("quality") == 0, 1)), F.count(F.expr("case when quality = 0 and not kept then 1 end")),
    ).head()
    assert lost <= 0.01 * good and caught >= 0.9 * bad


def test_learner():
    rng = random.Random(3)
    xs = [(rng.random(), rng.random()) for _ in range(2000)]
    rules = dl.learn_rules([(x, x[0] > 0.6 and x[1] <= 0.5) for x in xs], ["words", "repeat_share"])
    assert rules and sum(r.wrongly for r in rules) <= 5
    assert sum(r.rejected for r in rules) >= 0.95 * sum(x[0] > 0.6 and x[1] <= 0.5 for x in xs)
    assert dl.learn_rules([], ["words"]) == []
    assert dl.learn_rules([((1.0,), True)] * 50, ["words"]) == []
    assert dl.learn_rules([((1.0,), i % 2 == 0) for i in range(50)], ["words"]) == []


def test_odd_labels(documents, no_documents):
    labels = documents.sparkSession.createDataFrame([(None, 0), (1, None), (1, 0), (1, 1)], "doc_id long, quality int")
    assert dl.fit(documents, labels) == dl.fit(no_documents, labels) == dl.fit(documents, labels.limit(0)) == []
    assert dl.judge(no_documents, []).count() == 0


@pytest.mark.parametrize("name", ["base_failed", "kept", "key"])
def test_columns(documents, name):
    assert dl.judge(documents, []).columns.count(name) == 1


def test_plan_is_native(documents):
    rules = [dl.Rule((("words", "<=", 60.0), ("repeat_share", ">", 0.1)), 1, 0)]
    plan = dl.judge(documents, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
