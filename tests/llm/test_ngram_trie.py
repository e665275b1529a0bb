import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from turnloom.llm import ngram_trie as nt
from turnloom.llm import queries


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(brute.LOWER))


def model(rows, held, discount=0.75, order=2):
    """(key, held, n_tokens, n_known, N, base, score) per row, with dictionaries and without quantising."""
    single, pairs, after = Counter(), Counter(), defaultdict(set)
    triples, later = Counter(), defaultdict(set)
    for key, text in rows:
        if not held(key):
            words = [*tokens(text), None]
            single.update(words)
            for u, w in zip([None, *words], words):
                pairs[u, w] += 1
                after[u].add(w)
            for t, u, w in zip([None, *words], words, words[1:]):
                triples[t, u, w] += 1
                later[t, u].add(w)
    n, v = sum(single.values()), len(single)
    out = []
    for key, text in rows:
        words, base, score = [*tokens(text), None], 0.0, 0.0
        for t, u, w in zip([0, None, *words], [None, *words], words):  # 0 is no word
            p = (single[w] + 1) / (n + v + 1)
            base += math.log10(p)
            if single[u]:
                p = max(pairs[u, w] - discount, 0) / single[u] + discount * len(after[u]) / single[u] * p
            if order > 2 and t != 0 and pairs[t, u]:
                p = max(triples[t, u, w] - discount, 0) / pairs[t, u] + discount * len(later[t, u]) / pairs[t, u] * p
            score += math.log10(p)
        out.append((key, held(key), len(words), sum(single[w] > 0 for w in words), n, base, score))
    return out


def is_held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


def held_column():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def same(got, expected):
    got, expected = (sorted(map(tuple, x), key=repr) for x in (got, expected))
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5], rel=1e-9)
        assert abs(g[6] - e[6]) <= g[2] / 4096  # half a step for either term


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("chunk, shard, noted", [(1_000_000, 1_000_000, 8), (500, 3000, 2), (2000, 50_000, 1)])
def test_against_dictionaries(documents, doc_rows, monkeypatch, chunk, shard, noted, order):
    """In one piece, and with small chunks and shards, where many contexts are spread."""
    monkeypatch.setattr(nt, "_NOTED", noted)
    monkeypatch.setattr(nt, "_CHUNK_TOKENS", chunk)
    monkeypatch.setattr(nt, "_SHARD_TOKENS", shard)
    got = nt.score(documents, held_column(), order=order).collect()
    same(got, model(doc_rows, is_held, order=order))


def test_order():
    with pytest.raises(ValueError):
        nt.score(None, None, order=4)


def test_repeated_passages_score_higher_with_three_words(spark):
    """After two words of a passage that training holds the third is known, after one it is not."""
    rng = random.Random(3)
    passage = " ".join(rng.choice("abcd") + rng.choice("xy") for _ in range(80))
    rows = [(i, passage if i < 5 else " ".join(rng.sample(passage.split(), 80))) for i in range(40)] + [(100, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    two, three = (
        next(r["score"] for r in nt.score(df, F.col("doc_id") == 100, order=n).collect() if r["doc_id"] == 100) for n in (2, 3)
    )
    assert three > two


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op6_ngram_trie(spark, sf).collect()
    same(got, model(rows, is_held, order=3))
    assert {type(v) for r in got for v in r} == {int, bool, float}
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # better than words alone


def test_nothing_to_learn(documents, doc_rows, no_documents):
    assert nt.score(no_documents, held_column()).count() == 0
    assert nt.score(no_documents, held_column(), order=3).count() == 0
    for order in (2, 3):
        same(nt.score(documents, F.lit(True), order=order).collect(), model(doc_rows, lambda k: True, order=order))


def test_distributions_sum_to_one(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(6))) for i in range(50)]
    probe = [(100 + i, f"a {w}") for i, w in enumerate("abcdefghz")] + [(200, "a")]
    df = spark.createDataFrame(rows + probe, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in nt.score(df, F.col("doc_id") >= 100).collect()}
    trained = model(rows, lambda k: False)[0][4]
    end = {w: s for w, s in zip("abcdefghz", (got[100 + i] for i in range(9)))}
    assert trained and all(math.isfinite(x) for x in end.values())
    exact = model(rows + probe, lambda k: k >= 100)
    for r in exact:
        if r[0] >= 100:
            assert got[r[0]] == pytest.approx(r[6], abs=0.01)


@pytest.mark.parametrize("top", [10, 2**20, 2**63, 2**64 - 1])
def test_elias_fano(top):
    rng = random.Random(top)
    values = np.array(sorted({rng.randint(0, top) for _ in range(500)}), np.uint64)
    coded = nt.EliasFano.of(values)
    assert (coded[np.arange(len(values))] == values).all()
    asked = np.array([*values.tolist(), *(rng.randint(0, top) for _ in range(500)), 0, top], np.uint64)
    assert (coded.next_at(asked) == np.searchsorted(values, asked)).all()
    expected = [int(np.searchsorted(values, q)) if q in values else -1 for q in asked]
    assert coded.find(asked).tolist() == expected


@pytest.mark.parametrize("top", [2**21, 2**40, 2**62])
def test_elias_fano_is_compact(top):
    """With its directory it takes the low bits and some five more an entry, far below the sorted array."""
    values = np.unique(np.random.default_rng(7).integers(0, top, 1_000_000).astype(np.uint64))
    coded = nt.EliasFano.of(values)
    assert coded.nbytes * 8 <= len(values) * (coded.low_bits + 5.5) + 4096 < len(values) * 64
    at = np.random.default_rng(8).integers(0, len(values), 10_000)
    assert (coded[at] == values[at]).all() and (coded.find(values[at]) == at).all()


def test_long_runs_of_bits():
    """Entries far apart and many equal ones: runs of zeros and of ones longer than the directory's step."""
    for values in ([0] * 1000 + [5] * 300 + [100_000], [2**50, 2**50 + 1], [0], [7] * 257):
        values = np.array(values, np.uint64)
        coded = nt.EliasFano.of(values)
        assert (coded[np.arange(len(values))] == values).all()
        asked = np.unique(np.concatenate([values, values + np.uint64(1), [np.uint64(3)]]))
        assert (coded.next_at(asked) == np.searchsorted(values, asked)).all()


def test_empty_and_repeated_sequences():
    assert nt.EliasFano.of(np.empty(0, np.uint64)).find(np.array([0, 5], np.uint64)).tolist() == [-1, -1]
    twice = nt.EliasFano.of(np.array([0, 0, 3, 3, 3, 9], np.uint64))
    assert twice.next_at(np.array([0, 1, 3, 4, 10], np.uint64)).tolist() == [0, 2, 2, 5, 6]


def test_pack():
    for values in (np.arange(1000, dtype=np.int64), np.empty(0, np.uint16), np.array([2**40, 1], np.uint64)):
        assert nt.unpack(nt.pack(values)).tolist() == values.tolist()


def test_trie_is_one_buffer():
    rng = np.random.default_rng(1)
    contexts, words = rng.integers(0, 50, 3000).astype(np.uint64) << np.uint64(50), rng.integers(0, 90, 3000).astype(np.uint64)
    counts = rng.integers(0, 3, 3000)
    trie = nt.Trie(nt.Trie.build(contexts, words, counts).buffer)
    total = Counter()
    for c, w, n in zip(contexts.tolist(), words.tolist(), counts.tolist()):
        total[c, w] += n
    own = Counter()
    for (c, _), n in total.items():
        own[c] += n
    asked = [(c << 50, w) for c in range(52) for w in range(92)]
    rank, totals, _ = trie.context(np.array([c for c, _ in asked], np.uint64))
    found = nt.restore(trie.successor(rank, np.array([w for _, w in asked], np.uint64)))
    for (c, w), t, p in zip(asked, totals.tolist(), found.tolist()):
        assert t == own[c]
        assert p == (pytest.approx(total[c, w] - 0.75, rel=2e-3) if total[c, w] else 0.0)
    kinds = np.diff(trie.pointers[np.arange(trie.n_contexts + 1)].astype(np.int64))
    assert kinds.tolist() == [sum(1 for (a, _), n in total.items() if a == c and n) for c in sorted(own) if own[c]]


def test_memory_of_a_chunk():
    """Asking, answering and scoring take some 60 bytes a token at their peaks, beside what they are given."""
    rng = np.random.default_rng(5)
    n = 400_000
    numbers = np.minimum(rng.zipf(1.3, n), 60_000).astype(np.uint32)
    hashes = np.unique(rng.integers(0, 1 << 63, 70_000).astype(np.uint64))
    ends = np.arange(500, n + 1, 500)
    row = {
        "chunk": 0, "keys": list(range(len(ends))), "held": bytes(len(ends)), "ends": nt.pack(ends),
        "words": hashes.tobytes(), "tokens": nt.pack(numbers),
    }
    hot = nt.Hot(np.empty(0, np.uint64), np.empty(0))

    def peak(work):
        tracemalloc.start()
        try:
            return work(), tracemalloc.get_traced_memory()[1] / n
        finally:
            tracemalloc.stop()

    asked, asking = peak(lambda: next(nt._questions(7, hot, 3)(iter([pd.DataFrame([row])]))))
    answers, answering = peak(lambda: nt._answers(nt.DISCOUNT, hot)(asked))
    none = np.zeros(0, np.int64)
    scores, scoring = peak(
        lambda: nt._scores(7, n, 60_000, nt.DISCOUNT, hot, none, none, 3)(pd.DataFrame([row]), answers)
    )
    assert len(scores) == len(ends) and scores["score"].gt(2 * scores["base_score"]).all()
    assert max(asking, answering, scoring) < 80, (asking, answering, scoring)
