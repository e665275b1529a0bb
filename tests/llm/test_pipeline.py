"""Every stage against a version without Spark, on what the stage before it kept."""

from collections import Counter

import pytest

import brute
import corpus_pipeline as cp
from turnloom.llm import decision_list, pieces, queries
from turnloom.plans.scratch import scratch_table

SF = "/root/testdata/sf0.01"


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        before, docs = docs, scratch_table(stage(spark, docs, SF), "stage")
        out.append((before, docs))
    return out


def test_columns(stages):
    for before, after in stages[:-1]:
        assert before.columns == after.columns and before.schema == after.schema


def test_quality(spark, stages):
    before, after = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdicts = {r["doc_id"]: r["kept"] for r in decision_list.judge(before, decision_list.fit(before, labels)).collect()}
    for r in rows(before):
        s = brute.statistics(r["text"])
        if s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]:
            assert not verdicts[r["doc_id"]]
    assert {r["doc_id"] for r in rows(after)} == {k for k, v in verdicts.items() if v}
    good = [r["doc_id"] for r in labels.filter("quality = 1").collect()]
    words = {r["doc_id"]: brute.statistics(r["text"])["n_words"] for r in rows(before)}
    lost = [k for k in good if not verdicts[k] and words[k] >= 50]
    assert len(lost) <= 0.02 * len(good)


def test_lines(stages):
    before, after = stages[1]
    expected = {k: t for k, _, _, t in brute.dedup([(r["doc_id"], r["text"]) for r in rows(before)])}
    for r in rows(after):
        assert r["text"] == expected[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert len(expected) == after.count()


def test_near_copies(stages):
    before, after = stages[2]
    groups = brute.components([(r["doc_id"], r["text"]) for r in rows(before)])
    assert sorted(r["doc_id"] for r in rows(after)) == sorted({c for _, _, c in groups})


def test_near_copies_without_or_with_repeated_ids(spark):
    """Every group leaves one document: a missing or repeated id loses no other text."""
    first, second, third = (" ".join(f"{w}{i}" for i in range(80)) for w in ("apple", "stone", "river"))
    given = [
        (None, first, "a"), (None, second, "b"), (None, second, "b"), (5, third, "c"), (5, first, "d"),
        (3, third, "e"), (5, "other words of a repeated id", "f"), (None, None, "g"), (9, "", "h"), (7, "lone text", None),
    ]
    docs = spark.createDataFrame(given, "doc_id long, text string, _had_text string").repartition(4)
    stays = {(5, first), (None, second), (3, third), (5, "other words of a repeated id"), (9, ""), (7, "lone text")}
    for many in (docs, docs.repartition(1)):
        kept = cp.near_copies(spark, many, SF).collect()
        assert {(r["doc_id"], r["text"]) for r in kept} == stays and len(kept) == len(stays)
    after = cp.line_dedup(spark, docs, SF)
    assert after.columns == docs.columns and Counter(r[2] for r in after.collect()) == Counter(x[2] for x in given)


def test_mixture(stages):
    before, after = stages[3]
    size = lambda rs: Counter({s: sum(len(brute.words(r["text"])) for r in rs if r["source"] == s) for s in {r["source"] for r in rs}})
    old, new = rows(before), rows(after)
    sizes, taken = size(old), size(new)
    longest = max(len(brute.words(r["text"])) for r in old)
    import test_systematic

    for source, target in test_systematic.targets(sizes).items():
        assert abs(taken[source] - target) <= 2 * longest
    assert max(Counter(r["doc_id"] for r in new).values()) <= 3
    texts = {r["doc_id"]: r for r in old}
    assert all(texts[r["doc_id"]] == r for r in new)


def test_encoding(stages):
    before, after = stages[4]
    codec = pieces.Codec(pieces.load_vocabulary(queries.VOCABULARY))
    expected = Counter((r["doc_id"], tuple(codec.encode(r["text"])[0])) for r in rows(before))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows(after)) == expected
    assert all(r["round_trip"] for r in rows(after))


def test_odd_rows(spark, documents, no_documents):
    for docs in (documents, no_documents):
        for name, stage in cp.STAGES:
            before, docs = docs, scratch_table(stage(spark, docs, "/root/testdata/sf0.001"), "odd")
            if name != cp.STAGES[-1][0]:
                assert docs.columns == before.columns


def test_run(spark, stages):
    assert cp.run(spark, SF).count() == stages[-1][1].count()
