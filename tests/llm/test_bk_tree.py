import random

import pytest
from conftest import ordered

import brute
from turnloom.llm import bk_tree, components, queries


def test_fingerprints(doc_rows):
    for _, text in doc_rows:
        assert bk_tree.fingerprint_of(text) % (1 << 64) == brute.fingerprint(text)


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(str(i) for i in range(1000))
    monkeypatch.setattr(bk_tree, "_BLOCK_WORDS", 7)
    assert bk_tree.fingerprint_of(text) % (1 << 64) == brute.fingerprint(text)


def test_tree_finds_all_within():
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(20)]
    codes = [c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) for c in centre for _ in range(20)]
    tree = bk_tree.BKTree()
    for c in codes:
        tree.add(c)
    for q in codes[:100]:
        found = sorted(tree.within(q, 3))
        assert found == [i for i, c in enumerate(codes) if (c ^ q).bit_count() <= 3]


@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**12])
def test_masks_meet(n):
    rng = random.Random(n)
    masks = bk_tree._masks(n, 3)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        assert any(a & m & (2**64 - 1) == b & m & (2**64 - 1) for m in masks)


@pytest.mark.parametrize("cell, cells", [(4096, 16), (5, 16), (64, 1)])
def test_links_connect(spark, monkeypatch, cell, cells):
    monkeypatch.setattr(bk_tree, "_CELL", cell)
    monkeypatch.setattr(bk_tree, "_MOST_CELLS", cells)
    rng = random.Random(9)
    codes = set()
    for _ in range(30):
        code = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):  # chains of small steps
            codes.add(code)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                code ^= 1 << bit
    for at in (0, 24, 52):  # close groups, which agree in all but 12 bits
        ball = rng.getrandbits(64)
        codes.update(ball ^ rng.getrandbits(12) << at for _ in range(150))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(c),) for c in codes], "fp long")
    got = dict(components.connected(bk_tree.similar(df)).collect())
    ids = sorted(signed(c) for c in codes)
    parent = {c: c for c in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {c: got.get(c, c) for c in ids} == {c: root(c) for c in ids}


@pytest.mark.parametrize("n", [10, 10**9])
def test_finer_masks(n):
    """Each divides its group into cells at most, and codes within the radius meet."""
    rng = random.Random(n)
    for mask in bk_tree._masks(n, 3):
        finer = [m & (2**64 - 1) for m in bk_tree._finer(mask, 3)]
        assert 0 < len(finer) <= 220
        assert all(2 ** (64 - m.bit_count()) <= bk_tree._CELL and m & mask == mask & (2**64 - 1) for m in finer)
        free = [b for b in range(64) if not mask >> b & 1]
        for _ in range(50):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << bit for bit in rng.sample(free, 3))
            assert any(a & m == b & m for m in finer)
    assert bk_tree._finer(0, 40) == []


def test_long_chain_of_links(spark):
    edges = spark.range(400).selectExpr("id as a", "id + 1 as b").repartition(7)
    assert set(components.connected(edges).collect()) == {(i, 0) for i in range(401)}
    assert components.connected(edges.limit(0)).count() == 0


def test_against_brute_force(documents, doc_rows, no_documents):
    got = bk_tree.near_duplicates(documents)
    rows = got.select("doc_id", bk_tree.hex_digits(got["fp"]), "component_id").collect()
    assert ordered(rows) == ordered(brute.components(doc_rows))
    assert bk_tree.near_duplicates(no_documents).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert ordered(queries.op9_bk_tree(spark, sf).collect()) == ordered(brute.components(rows))
