import random
from hashlib import md5
from itertools import groupby

import pytest

from turnloom import collect_messages, collect_pairs, to_content
from turnloom.operators import conversations as conversations_module
from turnloom.plans.ordered import with_running_start

SCHEMA = "conv long, turn long, role string, text string"


def order(row):
    """By conversation, turn, role and the md5 of the text."""
    return tuple((v is not None, v) for v in (*row[:-1], md5(row[-1].encode()).hexdigest(), row[-1]))


def conversations(rows):
    rows = sorted(rows, key=order)
    return {c: [r[1:] for r in group] for c, group in groupby(rows, key=lambda r: r[0])}


def make_rows(kind):
    rng = random.Random(5)
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system"])
            rows.append((conv, turn, role, f"{conv}-{turn} {rng.random()}"))
    if kind == "long":  # a third of all rows in one conversation
        rows += [(99, t, ("user", "assistant")[t % 2], f"long {t}") for t in range(90)]
    if kind == "same turn":  # all of them with the same number
        rows += [(99, 0, ("user", "assistant")[t % 2], f"{'x' * 40}{t}") for t in range(90)]
    if kind == "copies":  # and the same text
        rows += [(99, 0, "user", "copy")] * 90 + [(99, 1, "assistant", "end")]
    if kind == "null key":
        rows += [(None, t, ("user", "assistant")[t % 2], f"null {t}") for t in range(90)]
    rng.shuffle(rows)
    return rows


KINDS = ["short", "long", "same turn", "copies", "null key"]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("max_messages", [9, 16, 4096])
def test_messages_are_whole_and_in_order(spark, kind, max_messages):
    rows = make_rows(kind)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    parts = collect_messages(df, "conv", max_messages=max_messages).collect()
    assert len({(p["conv"], p["part"]) for p in parts}) == len(parts)
    got = {}
    for p in sorted(parts, key=lambda p: p["part"]):
        whole = got.setdefault(p["conv"], [])
        assert len(whole) == p["part"] * max_messages
        assert 0 < len(p["messages"]) <= max_messages
        whole += [(m["role"], m["content"]) for m in p["messages"]]
        assert p["is_last"] == (len(p["messages"]) + p["part"] * max_messages == sum(
            r[0] == p["conv"] for r in rows
        ))
    assert got == {c: [t[1:] for t in turns] for c, turns in conversations(rows).items()}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("max_bytes", [1, 120, 1 << 30])
def test_bytes_of_a_part(spark, kind, max_bytes):
    """Parts are whole, and hold no more bytes than asked for unless they are one message."""
    rows = make_rows(kind)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    parts = collect_messages(df, "conv", max_messages=16, max_bytes=max_bytes).orderBy("conv", "part").collect()
    got = {}
    for p in parts:
        assert p["part"] == got.setdefault(p["conv"], [0, []])[0]
        got[p["conv"]][0] += 1
        got[p["conv"]][1] += [tuple(m) for m in p["messages"]]
        size = sum(len(m["content"].encode()) for m in p["messages"])
        assert len(p["messages"]) <= 16 and (size <= max_bytes or len(p["messages"]) == 1)
    expected = conversations(rows)
    assert {c: messages for c, (_, messages) in got.items()} == expected
    for conv, messages in expected.items():
        sizes = [len(m[-1].encode()) for m in messages]
        length = 16 if sum(sizes) <= max_bytes else min(16, max(max_bytes // max(sizes), 1))
        assert got[conv][0] == -(-len(messages) // length)
        assert sum(p["is_last"] for p in parts if p["conv"] == conv) == 1


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("max_messages", [9, 16, 4096])
def test_pairs(spark, kind, max_messages):
    rows = make_rows(kind)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in collect_pairs(df, "conv", max_messages=max_messages).collect()]
    expected = [
        (conv, a[0], a[2], b[2])
        for conv, turns in conversations(rows).items()
        for a, b in zip(turns, turns[1:])
        if a[1] == "user" and b[1] == "assistant"
    ]
    assert sorted(got, key=order) == sorted(expected, key=order)


def test_columns_may_have_other_names(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "c long, n long, r string, t string")
    assert collect_messages(df, "c", "n", "r", "t", max_messages=9).columns == ["c", "part", "is_last", "messages"]
    pairs = collect_pairs(df, "c", "n", "r", "t", max_messages=9)
    assert pairs.columns == ["c", "n", "question", "answer"]
    assert [tuple(r) for r in pairs.collect()] == [(1, 0, "a", "b")]


def test_many_long_conversations_are_joined_with_salt(spark, monkeypatch):
    monkeypatch.setattr(conversations_module, "_FEW", 0)
    rows = make_rows("long") + [(7, 100 + t, "user", f"more {t}") for t in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    parts = collect_messages(df, "conv", max_messages=9).collect()
    got = {}
    for p in sorted(parts, key=lambda p: p["part"]):
        got.setdefault(p["conv"], []).extend((m["role"], m["content"]) for m in p["messages"])
    assert got == {c: [t[1:] for t in turns] for c, turns in conversations(rows).items()}


def test_texts_with_one_opening_are_spread(spark):
    """A long conversation of one turn number and role, whose texts begin alike."""
    df = spark.range(3000).selectExpr(
        "1L conv", "0L turn", "'user' role", "concat(repeat('same opening ', 5), id) text"
    )
    _, long = conversations_module._split_long(df, "conv", "turn", "role", "text", 100)
    sizes = with_running_start(long, ["turn", "role", "mark"], "copies", ["conv"], buckets=30).groupBy("bucket").count()
    assert max(r["count"] for r in sizes.collect()) < 400


def test_only_the_last_part_is_asked(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(7)]
    parts = collect_messages(spark.createDataFrame(rows, SCHEMA), "conv", max_messages=3)
    asked = to_content(parts, "chatml", key=["part"], generation_prompt=True).collect()
    assert [r["part"] for r in asked if r["content"].endswith("assistant\n")] == [2]
