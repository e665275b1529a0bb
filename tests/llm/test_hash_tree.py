from collections import Counter, defaultdict

from pyspark.sql import functions as F

import brute
from turnloom.llm import hash_tree as ht
from turnloom.llm import queries


def placed(df, tree):
    return dict(df.select("id", ht.shard_of(tree, F.col("id"))).collect())


def test_shares_follow_weights(spark):
    tree = (((((0, 1.0), (1, 3.0)), ((2, 2.0),))), (((3, 4.0), (4, 0.0)),))
    tree = ((((0, 1.0), (1, 3.0)), ((2, 2.0),)), (((3, 4.0), (4, 0.0)),))
    counts = Counter(placed(spark.range(40_000), tree).values())
    assert set(counts) == {0, 1, 2, 3}
    for shard, weight in ((0, 1), (1, 3), (2, 2), (3, 4)):
        assert abs(counts[shard] / 40_000 - weight / 10) < 0.01


def test_growth_moves_keys_into_the_new_shard_only(spark):
    ids, tree = spark.range(20_000), ht.uniform_tree(5, 2, 4)
    for _ in range(3):
        larger = ht.grown(tree)
        before, after = placed(ids, tree), placed(ids, larger)
        new = max(after.values())
        moved = [k for k in before if before[k] != after[k]]
        assert moved and all(after[k] == new for k in moved)
        assert len(moved) < 20_000 / new * 1.3
        tree = larger


def test_a_weight_moves_keys_in_its_own_subtrees_only(spark):
    ids, tree = spark.range(20_000), ht.uniform_tree(2, 2, 2)
    heavier = (((((0, 2.0), (1, 1.0))), tree[0][1]), tree[1])
    before, after = placed(ids, tree), placed(ids, heavier)
    # Shards 0-1 are the first rack, 0-3 the first region; the rest neither gives nor takes otherwise.
    for k in before:
        if before[k] != after[k]:
            assert after[k] in (0, 1, 2, 3)
            assert after[k] in (0, 1) or before[k] >= 4
            assert after[k] == 0 or before[k] != after[k] and before[k] not in (0, 1) or after[k] != 1


def test_placement(documents, doc_rows, no_documents):
    tree = ht.uniform_tree(5, 2, 4)
    rows = ht.place(documents, tree, "doc_id", "text", ht.grown(tree)).collect()
    expected = Counter((k, len((t or "").encode()) + 16, brute.crc(t)) for k, t in doc_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    slots = defaultdict(list)
    shard = {}
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
        assert shard.setdefault(r["doc_id"], r["shard"]) == r["shard"]  # the key decides
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert ht.place(no_documents, tree, "doc_id", "text").count() == 0


def test_query(spark):
    rows = queries.op2_hash_tree(spark, "/root/testdata/sf0.01").collect()
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(40)) and len(rows) == 1000 and max(counts.values()) < 60
    assert all(r["law"] == "key" for r in rows)
    assert set(rows) == set(queries.op2_hash_tree(spark, "/root/testdata/sf0.01").collect())
