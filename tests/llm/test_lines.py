import hashlib

from conftest import ordered

import brute
from turnloom.llm import lines, queries

COLUMNS = ["doc_id", "n_lines", "n_dropped", "text"]


def test_against_brute_force(documents, doc_rows):
    got = lines.dedup_lines(documents).select(COLUMNS).collect()
    assert ordered(got) == ordered(brute.dedup(doc_rows))


def test_other_thresholds(documents, doc_rows, monkeypatch):
    monkeypatch.setattr(lines, "_HOT_SHARE", 3)  # some shared lines take the broadcast, some the join
    got = lines.dedup_lines(documents, min_docs=2, min_chars=1).select(COLUMNS).collect()
    assert ordered(got) == ordered(brute.dedup(doc_rows, 2, 1))


def test_other_columns_stay(documents, no_documents):
    out = lines.dedup_lines(documents)
    assert set(out.columns) == {*documents.columns, "n_dropped"}
    assert out.filter("line = 'clash' and pos = 'clash'").count() == documents.count()
    assert lines.dedup_lines(no_documents).count() == 0


def test_planted_passage(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"own line number {i}\n{passage.upper() if i % 2 else passage}  \nend {i}") for i in range(30)]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert all(kept[i] == f"own line number {i}\nend {i}" for i in range(29)) and "word5" in kept[29].lower()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(*r[:3], sha(r[3])) for r in brute.dedup(rows)]
    assert ordered(queries.op5_line_dedup(spark, sf).collect()) == ordered(expected)


def test_plan_is_native(documents):
    plan = lines.dedup_lines(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
