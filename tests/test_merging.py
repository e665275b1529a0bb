"""Merge coding against merging by hand, and against two public implementations."""

import base64
import pickle
import random

import pytest

from turnloom import MergeCoder, load_merge_coder, parse_ids, tokenise
from turnloom.functions import merging

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
JSON = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def coder(spark):
    return load_merge_coder(spark, RANKS)


def one_by_one(piece, rank, ids):
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(r, i) for i in range(len(parts) - 1) if (r := rank(parts[i], parts[i + 1])) is not None]
        if not pairs:
            return [ids[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("few", [0, 24])
@pytest.mark.parametrize("listed", [False, True])
@pytest.mark.parametrize("seed", range(10))
def test_against_merging_by_hand(monkeypatch, seed, listed, few):
    monkeypatch.setattr(merging, "_FEW", few)
    rng = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    merges = []
    for _ in range(60):  # any tokens over few letters, not only those that training would find
        a, b = rng.choice(tokens[97:100] + tokens[256:]), rng.choice(tokens[97:100] + tokens[256:])
        if a + b not in tokens:
            tokens.append(a + b)
            merges.append((a, b))
    rng.shuffle(merges)
    ids = {t: i for i, t in enumerate(tokens)}
    coder = MergeCoder(ids, r"[a-z]+|[^a-z]+", merges if listed else None)
    rank = (lambda x, y: {p: i for i, p in enumerate(merges)}.get((x, y))) if listed else (lambda x, y: ids.get(x + y))
    for _ in range(60):
        piece = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        expected = [ids[piece.encode()]] if not listed and piece.encode() in ids else one_by_one(piece.encode(), rank, ids)
        assert coder.encode(piece) == expected


def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    odd = ["", " ", "\n\n  x", "it's we'll I'VE", "é😀 日本語", "a" * 3000, "ab" * 2000, " " * 500, "\x00\x7f", "1234567", "<|endoftext|>", "�", "­̀"]
    return [r["text"] for r in rows] + odd


def test_against_a_public_implementation(spark, coder):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    other = tiktoken.Encoding("own", pat_str=merging.PIECES, mergeable_ranks=ranks, special_tokens={})
    for text in texts(spark):
        ids = coder.encode(text)
        assert ids == other.encode_ordinary(text)
        assert coder.decode(ids) == text


def test_json_vocabulary(spark):
    from tokenizers import Tokenizer

    coder = load_merge_coder(spark, JSON)
    other = Tokenizer.from_file(JSON)
    other.encode_special_tokens = True
    for text in texts(spark):
        ids = coder.encode(text)
        assert ids == other.encode(text, add_special_tokens=False).ids
        assert coder.decode(ids) == text
    assert coder.decode([50256, *coder.encode("a")]) == "a"
    assert coder.decode([50256], skip_special=False) == "<|endoftext|>"
    with pytest.raises(ValueError, match="byte-level"):
        load_merge_coder(spark, "/opt/tokenizers/word_bpe_49k.json")


def test_long_pieces_take_near_linear_time(coder):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(200_000))
    assert coder.decode(coder.encode(text)) == text


def test_memory_is_bounded(coder, monkeypatch):
    monkeypatch.setattr(merging, "_REMEMBERED", 10)
    small = MergeCoder(coder.ranks)
    for i in range(100):
        assert small.encode(f"word{i}") == coder.encode(f"word{i}")
        assert len(small._known) <= 10
    assert pickle.loads(pickle.dumps(coder)).encode("some text") == coder.encode("some text")


def test_over_a_table(spark, coder):
    rows = [(i, t) for i, t in enumerate(texts(spark))] + [(None, None)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(4)
    tokens = tokenise(df, ["id"], tokenizer=coder.tokenizer)
    got = {r["id"]: r["tokens"] for r in tokens.collect()}
    assert got == {i: None if t is None else coder.encode(t) for i, t in rows}
    raw = tokens.filter("id is not null").selectExpr("id", "tokens AS ids", "0 AS prompt_len")
    back = parse_ids(raw, coder.decoder, marker=-1)
    assert {r["id"]: r["output"] for r in back.collect()} == {i: t.strip("\n") for i, t in rows if i is not None}


def test_a_vocabulary_needs_all_bytes():
    with pytest.raises(ValueError, match="lacks 255"):
        MergeCoder({b"a": 0})
