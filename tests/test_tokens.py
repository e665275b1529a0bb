import random
from hashlib import md5

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom import length_statistics, pack_wrapped, tokenise, truncate_tokens
from turnloom.operators import packing


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


def test_whitespace_tokens(spark):
    values = ["a b", "  a\t\nb\x0bc\r\n", "", " \n", "one", "a b"]
    rows = tokenise(texts(spark, values), ["id"]).orderBy("id").collect()
    assert [r["tokens"] for r in rows] == [["a", "b"], ["a", "b", "c"], [], [], ["one"], ["a b"]]


def test_user_tokenizer_gets_batches(spark):
    def tokenizer():
        return lambda batch: [[len(batch), len(text)] for text in batch]

    df = texts(spark, ["a", "bb", "ccc", "dddd", "eeeee"]).coalesce(1)
    rows = tokenise(df, ["id"], tokenizer=tokenizer, batch_size=2).orderBy("id").collect()
    assert [r["tokens"] for r in rows] == [[2, 1], [2, 2], [2, 3], [2, 4], [1, 5]]


def test_truncate_and_statistics(spark):
    tokens = tokenise(texts(spark, ["a b c d", "a", "", "a b"]), ["id"])
    rows = truncate_tokens(tokens, 2).orderBy("id").collect()
    assert [(r["n_tokens"], r["tokens"]) for r in rows] == [
        (4, ["a", "b"]), (1, ["a"]), (0, []), (2, ["a", "b"]),
    ]
    assert length_statistics(tokens, 2).head().asDict() == {
        "n_sequences": 4, "n_tokens": 7, "min_tokens": 0, "max_tokens": 4,
        "n_truncated": 1, "kept_tokens": 5,
    }


def mark(value):
    return md5(",".join(map(str, value)).encode()).hexdigest()


def pack(rows, block_len):
    """Brute force: all tokens in order, cut."""
    rows = sorted(rows, key=lambda row: (row[0], mark(row[1])))
    tokens = [t for _, value in rows for t in value]
    return [tokens[i : i + block_len] for i in range(0, len(tokens), block_len)]


def packed(df, block_len, buckets=None, **options):
    blocks = pack_wrapped(df, "id", "value", block_len, buckets, **options)
    if "content" in blocks.columns:
        blocks = blocks.withColumn("tokens", F.split("content", " "))
    rows = blocks.orderBy("block").collect()
    assert [r["block"] for r in rows] == list(range(len(rows)))
    assert [r["n_tokens"] for r in rows] == [len(r["tokens"]) for r in rows]
    return [r["tokens"] for r in rows]


@pytest.mark.parametrize("block_len", [1, 7, 64, 100_000])
@pytest.mark.parametrize("buckets", [1, 2, 13, 200])
def test_pack_ids(spark, block_len, buckets):
    rng = random.Random(block_len)
    rows = [(i * 3, [rng.randrange(99) for _ in range(rng.choice([0, 1, 2, 30]))]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, value array<int>").repartition(6)
    assert packed(df, block_len, buckets) == pack(rows, block_len)


def test_pack_text(spark):
    rows = [(i, " ".join(f"w{i}.{j}" for j in range(i % 5))) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, value string")
    assert packed(df, 8) == pack([(i, t.split()) for i, t in rows], 8)


@pytest.mark.parametrize("max_copies", [0, 10, 4096])
@pytest.mark.parametrize("block_len", [1, 9, 64, 5000])
@pytest.mark.parametrize("same", [False, True])
def test_pack_with_a_hot_key(spark, monkeypatch, same, block_len, max_copies):
    """A third of the rows share one key, and perhaps also their tokens."""
    monkeypatch.setattr(packing, "_BLOCKS_PER_CHUNK", 3)
    rows = [(i, [i, i + 1][: i % 3]) for i in range(100)]
    rows += [(50, [7, 8, 0 if same else i]) for i in range(50)]
    rows += [(60, []), (60, []), (70, [1]), (70, [1])]
    df = spark.createDataFrame(rows, "id long, value array<int>").repartition(6)
    assert packed(df, block_len, 16, max_copies=max_copies) == pack(rows, block_len)


def test_pack_copies_of_a_text(spark):
    rows = [(i, f"w{i} v{i}") for i in range(20)] + [(None, " a  b c")] * 40 + [(5, "x y")] * 30
    df = spark.createDataFrame(rows, "id long, value string").repartition(6)
    texts = ["a b c"] * 40 + [f"w{i} v{i}" for i in range(5)]
    five = sorted(["w5 v5"] + ["x y"] * 30, key=lambda t: md5(t.encode()).hexdigest())
    texts += five + [f"w{i} v{i}" for i in range(6, 20)]
    tokens = " ".join(texts).split()
    expected = [tokens[i : i + 7] for i in range(0, len(tokens), 7)]
    for max_copies in (10, 4096):
        assert packed(df, 7, 8, max_copies=max_copies) == expected


def test_pack_string_keys_and_null(spark):
    rows = [("b", [1]), ("a", [2, 3]), (None, [4]), ("é", [5]), ("a\"\\", [6])]
    df = spark.createDataFrame(rows, "id string, value array<int>")
    assert packed(df, 2, 4) == [[4, 2], [3, 6], [1, 5]]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.integers(0, 9), max_size=6), min_size=1, max_size=20), st.integers(1, 9))
def test_pack_keeps_every_token(spark, values, block_len):
    df = spark.createDataFrame(list(enumerate(values)), "id long, value array<int>")
    assert packed(df, block_len, 5) == pack(list(enumerate(values)), block_len)


def test_nothing_to_pack(spark):
    df = spark.createDataFrame([(1, [])], "id long, value array<int>")
    assert packed(df, 4) == []
    assert packed(df.filter(F.lit(False)), 4) == []
