import math
import random
import re

import numpy as np
import pytest
from brute import LOWER
from conftest import ordered
from pyspark.sql import functions as F

from turnloom.llm import mask_search as ms


def terms(text):
    return [t.translate(LOWER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(items, docs, k=50):
    lists = [(key, terms(t)) for key, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in lists), sum(len(w) for _, w in lists)
    df = {}
    for _, w in lists:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for key, w in lists:
            m = 50 + (50 * len(w) * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10**9 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in set(terms(text)) & set(w))
            if score > 0:
                found.append((-score, key is None, key))
        out += [(item, rank, key, -s) for rank, (s, _, key) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


@pytest.fixture(scope="module")
def items(doc_rows):
    rng = random.Random(2)
    words = sorted({w for _, t in doc_rows for w in terms(t)})
    rows = [(i, " ".join(rng.sample(words, min(len(words), n)))) for i, n in enumerate([1, 2, 3, 10, 63, 64, 65, 130, 400])]
    rows += [(20 + i, t) for i, (_, t) in enumerate(doc_rows[::17]) if t is not None and len(t) < 4000]
    return rows + [(50, None), (51, ""), (52, "... --- !!!"), (53, "nowherefound"), (54, "É é a A"), (3, "word word again"), (None, "word x line")]


def tables(spark, items):
    df = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    return df.select("*", *[F.lit("clash").alias(c) for c in ("row", "item", "terms", "rank", "doc_id")])


@pytest.mark.parametrize("block, batch", [(100_000, 10_000), (300, 37)])
def test_against_brute_force(spark, monkeypatch, documents, doc_rows, items, block, batch):
    """In one block of items, and in several over many blocks of documents."""
    monkeypatch.setattr(ms, "BLOCK_TERMS", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = ms.rank(tables(spark, items), documents)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ordered(got.collect()) == ordered(brute(items, doc_rows))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_few_places(spark, documents, doc_rows, items):
    got = ms.rank(tables(spark, items), documents, k=2)
    assert ordered(got.collect()) == ordered(brute(items, doc_rows, 2))


def test_no_rows(spark, documents, no_documents, items):
    asked = tables(spark, items)
    assert ms.rank(asked, no_documents).count() == 0
    assert ms.rank(asked.limit(0), documents).count() == 0
    assert ms.rank(asked.filter("text = ''"), documents).count() == 0


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(ms, "_PIECE", 16)
    for text in ("one TWO, three-four " * 50, "x" * 200, "é" * 99 + " É.b", "", None, "   ", "a" * 15 + " b"):
        found = [t.decode() for words in ms.term_lists(text) for t in words]
        assert found == terms(text)
        ids = {t.encode(): i for i, t in enumerate(sorted(set(found))[::2])}
        n, at, counts = ms.counted(text, ids)
        assert n == len(found)
        assert dict(zip(at.tolist(), counts.tolist())) == {i: found.count(t.decode()) for t, i in ids.items()}
        assert list(at) == sorted(at)


def test_safe_stop_leaves_groups_unscored():
    """Groups whose bound is below the last place are not scored, equal ones are."""
    rng = np.random.default_rng(1)
    n = 4000
    sizes = np.where(np.arange(n) < 60, 3, 1)
    held = np.concatenate([[0, 1, 2]] * 60 + [[2]] * (n - 60))
    found = ms.Postings(np.arange(n)[::-1].copy(), rng.integers(60, 70, n), sizes, held, np.ones(len(held), np.int64))
    best = ms.Best(50)
    scored = found.search(ms.Item(0, np.array([0, 1, 2, 9])), np.array([900, 800, 10] + [0] * 7), best)
    assert scored == 60 and len(best.docs) == 50
    same = ms.Postings(np.arange(n)[::-1].copy(), np.full(n, 64), np.ones(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64))
    best = ms.Best(50)
    same.search(ms.Item(0, np.array([0])), np.array([5]), best)
    assert best.docs.tolist() == list(range(50))
