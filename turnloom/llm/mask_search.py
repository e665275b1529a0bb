"""Ranked lexical search by presence masks.

In a block of documents, bitmaps say which of an item's terms each one holds. Documents with the
same mask form a group, whose best possible score follows from the mask alone. Groups are scored
in descending order of that bound, until the next bound is below the item's last place.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import by_value
from turnloom.plans.scratch import scratch_table

by_value(__name__)

#: Terms of all items that are searched for in one pass; they and their weights go to every task.
BLOCK_TERMS = 100_000
_PIECE = 1 << 20  # bytes of a text that are cut into terms at once

# Letters and digits of ASCII and every other byte of UTF-8 stay, A-Z in lower case.
_KEPT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def term_lists(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, a list per piece; a piece ends where no term does."""
    data = text.encode("utf-8", "surrogatepass").translate(_KEPT) if text else b""
    at = 0
    while at < len(data):
        stop = data.find(b" ", min(at + _PIECE, len(data)))
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


def counted(text: str | None, ids: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """How many terms a text has, and which of the wanted ones how often, by ascending id."""
    n, terms, counts = 0, np.zeros(0, np.int32), np.zeros(0, np.int64)
    for words in term_lists(text):
        n += len(words)
        found = np.fromiter(map(ids.get, words, repeat(-1)), np.int32, len(words))
        new, times = np.unique(found[found >= 0], return_counts=True)
        if not len(terms):
            terms, counts = new, times
        else:
            terms, place = np.unique(np.concatenate([terms, new]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, times]), len(terms)).astype(np.int64)
    return n, terms, counts


class Item(NamedTuple):
    row: int
    terms: np.ndarray  # ids


class Best:
    """The best documents of one item so far: scores and documents, best first."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores, self.docs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def last(self) -> int:
        """What a score must reach to change anything."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.concatenate([self.scores, scores]), np.concatenate([self.docs, docs])
        order = np.lexsort((docs, -scores))[: self.k]
        self.scores, self.docs = scores[order], docs[order]


class Postings:
    """A block of documents, by document and by term."""

    def __init__(self, docs: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        self.docs = docs
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.terms = terms
        owner = np.repeat(np.arange(len(docs)), sizes)
        self.parts = (1_000_000_000 * tf) // (1000 * tf + 20 * m[owner])
        order = np.argsort(terms, kind="stable")
        self.known, first = np.unique(terms[order], return_index=True)
        self.term_starts = np.append(first, len(terms))
        self.owners = owner[order]
        self.highest = np.maximum.reduceat(self.parts[order], first) if len(terms) else np.zeros(0, np.int64)

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of ``terms`` occur, the documents that hold any, and their masks of 64-bit words."""
        at = np.searchsorted(self.known, terms)
        at = at[(at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == terms)]
        words = np.zeros((-(-len(at) // 64), len(self.docs)), np.uint64)
        for bit, t in enumerate(at.tolist()):
            words[bit // 64, self.owners[self.term_starts[t] : self.term_starts[t + 1]]] |= np.uint64(1 << (bit % 64))
        holders = np.flatnonzero(words.any(axis=0))
        return at, holders, words[:, holders]

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of documents; ``weights`` is 0 for terms of other items."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        at = np.repeat(self.starts[rows], sizes) + within
        sums = np.concatenate(([0], np.cumsum(weights[self.terms[at]] * self.parts[at])))
        return sums[ends] - sums[ends - sizes]

    def search(self, item: Item, weights: np.ndarray, best: Best) -> int:
        """Bring the block's documents into an item's best; how many were scored."""
        if not len(self.known):
            return 0
        at, holders, words = self.masks(item.terms)
        if not len(holders):
            return 0
        order = np.lexsort(words)
        new = np.append(True, (np.diff(words[:, order]) != 0).any(axis=0))
        starts = np.append(np.flatnonzero(new), len(order))
        distinct = np.ascontiguousarray(words[:, order[starts[:-1]]].T).astype("<u8")
        bits = np.unpackbits(distinct.view(np.uint8), axis=1, bitorder="little")[:, : len(at)]
        ids = self.known[at]
        most = weights[ids].astype(np.float64) * self.highest[at]
        bounds = (bits @ most) * (1 + 1e-9) + 1  # above all rounding
        ranked = np.argsort(-bounds, kind="stable")
        own = np.zeros_like(weights)
        own[ids] = weights[ids]
        members = np.cumsum(np.diff(starts)[ranked])
        done, step, scored = 0, best.k, 0
        while done < len(ranked) and bounds[ranked[done]] >= best.last():
            stop = int(np.searchsorted(members, scored + step)) + 1  # groups of as many documents, or one group
            taken = ranked[done:stop]
            rows = np.sort(holders[np.concatenate([order[starts[g] : starts[g + 1]] for g in taken.tolist()])])
            scores = self.scores(rows, own)
            good = scores >= best.last()
            best.add(scores[good], self.docs[rows[good]])
            done, step, scored = stop, 2 * step, scored + len(rows)
        return scored


def _postings(docs: DataFrame, ids, key: str, text: str) -> DataFrame:
    """``doc, n, terms, tf`` of every document, whose whole text is read; only wanted terms."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = ids.value
        for batch in batches:
            rows = [counted(t, wanted) for t in batch["text"]]
            n, terms, tf = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({"doc": batch["doc"], "n": np.array(n, np.int64), "terms": terms, "tf": tf})

    columns = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return columns.mapInPandas(count, "doc long, n long, terms array<int>, tf array<long>")


def _item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """``row, item, terms`` of every item, its distinct terms in order."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["terms"] = [sorted({t for words in term_lists(x) for t in words}) for x in batch["terms"]]
            yield batch

    columns = items.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("item"), F.col(text).cast("string").alias("terms")
    )
    kind = items.schema[key].dataType.simpleString()
    return columns.mapInPandas(split, f"row long, item {kind}, terms array<binary>")


_NO_KEY = (1 << 63) - 1  # a document without a key comes after the others


def _block_best(block: list, docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """``row, doc, score``: the best documents of each of these items, some too many."""
    spark = docs.sparkSession
    names = sorted({bytes(t) for r in block for t in r["terms"]})
    ids = {t: i for i, t in enumerate(names)}
    wanted = spark.sparkContext.broadcast(ids)  # BLOCK_TERMS entries, or one item's
    postings = scratch_table(_postings(docs, wanted, key, text), "postings")
    total = postings.filter("n > 0").agg(F.count("*"), F.sum("n")).head()
    n_docs, n_terms = total[0], total[1] or 1
    df = np.zeros(len(names), np.int64)
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per wanted term
        df[r["t"]] = r["count"]
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    # Plain values only: a broadcast holds no classes that executors would have to import.
    searched = [(r["row"], np.array([ids[bytes(t)] for t in r["terms"]], np.int64)) for r in block if r["terms"]]
    shared = spark.sparkContext.broadcast((searched, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, weights = shared.value
        asked = [Item(*x) for x in plain]
        best = [Best(k) for _ in asked]
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {c: batch.column(c) for c in batch.schema.names}
            m = 50 + (50 * column["n"].to_numpy() * n_docs) // n_terms
            found = Postings(
                column["doc"].to_numpy(), m, column["terms"].value_lengths().to_numpy(),
                column["terms"].flatten().to_numpy().astype(np.int64), column["tf"].flatten().to_numpy(),
            )
            for item, own in zip(asked, best):
                found.search(item, weights, own)
        rows = [np.full(len(b.docs), item.row) for item, b in zip(asked, best)]
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64)
                   for c in (rows, [b.docs for b in best], [b.scores for b in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "doc", "score"])

    held = postings.filter(F.size("terms") > 0).withColumn("doc", F.coalesce("doc", F.lit(_NO_KEY)))
    return held.mapInArrow(search, "row long, doc long, score long")


def rank(
    items: DataFrame, docs: DataFrame, k: int = 50, item_key: str = "item_id", item_text: str = "text",
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``item_key, rank, key, score``: each item's ``k`` best documents with a score above 0.

    Terms are the longest runs of ASCII letters and digits (A-Z in lower case) and of all characters beyond
    ASCII, in the whole text. Scores are sums over an item's distinct terms, in integers, as
    the contract of the query has them; equal scores go by ascending key, which must be a
    number; a NULL key comes last and stays NULL. Rows are documents and items of their own, also
    where they or their keys repeat. NULL and empty texts have no terms: such items find nothing,
    such documents are not counted. Empty tables give an empty result. Other columns are ignored.

    Items are taken in blocks of about ``BLOCK_TERMS`` terms (more only if one item has more), which
    a broadcast carries with one weight per term. A block takes one pass over the texts, which
    writes the counts of the wanted terms, and one over these counts. A task keeps the ``k`` best of each
    item over all its documents, so that ``k`` rows per item and task are shuffled.
    """
    terms = scratch_table(_item_terms(items, item_key, item_text), "items")
    size = terms.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).head()[0]
    blocks = max(1, -(-size // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks))
    found = []
    for b in range(blocks):
        rows = terms.filter(block == b).select("row", "terms").collect()  # of one block
        found.append(scratch_table(_block_best(rows, docs, k, key, text), "best"))
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "doc")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    shown = F.when(F.col("doc") != _NO_KEY, F.col("doc"))
    named = ranked.join(terms.select("row", "item"), "row")
    return named.select(F.col("item").alias(item_key), "rank", shown.alias(key), "score")
