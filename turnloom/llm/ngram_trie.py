"""Language-model scores from an Elias-Fano n-gram trie.

The model is an interpolated model of order two or three with absolute discounting. Its trie has a
level of contexts, one of the words seen after each, and at order three one of the words after those. All are
monotone sequences in Elias-Fano form, with monotone pointers from an entry to its successors and
quantised logarithms beside them, laid out in one buffer that is used in place. A successor is looked up relative to its
context: its key is the context's rank followed by the word, and the search is for the next entry.

The trie is sharded by context, because it grows with the corpus. Texts are read once, into
chunks; a chunk asks each shard once about each of its different n-grams, by their first word. Counts and questions
travel together, so a frequent word costs a shard one entry per chunk and successor, not one per
occurrence. Contexts so frequent that one shard would have more than its share are spread over several
by successor; they are at most 262,144, and their totals are summed up apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import by_value
from turnloom.plans.scratch import scratch_table

by_value(__name__)

DISCOUNT = 0.75
_CHUNK_TOKENS = 1_000_000
_SHARD_TOKENS = 1_000_000
_MAX_HOT = 1 << 18
_NOTED = 8  # how often a chunk must hold a word to report it as perhaps hot
_WORD_BITS = 40  # of a word's hash, to tell it from others after the same context
_THIRD_BITS = 32  # and after the same two words, which far fewer follow
_STEP = 1 / 4096  # of quantised log10 values
_LARGEST = 14.0  # log10 of the largest count that is told apart
_ABSENT = 0xFFFF
_RUN = 128  # bits between two counts of a select directory
_BLOCK = 1 << 15  # values that are worked on at a time where that saves memory
_WORD_MASK = np.uint64((1 << _WORD_BITS) - 1)
_EDGE = np.uint64(0x9E3779B97F4A7C15)  # stands for the beginning as a context, the end as a word


# --- compact columns -------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, compressed: small numbers and repeats cost little."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    raw = np.ascontiguousarray(planes).tobytes()
    head = np.array([len(values)], "<i8").tobytes() + values.dtype.str.encode().ljust(8)
    return head + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(data: bytes) -> np.ndarray:
    n, kind = int(np.frombuffer(data, "<i8", 1)[0]), np.dtype(data[8:16].decode().strip())
    if not n:
        return np.empty(0, kind)
    raw = pa.decompress(data[16:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Logarithms of positive numbers as 16-bit steps down from 10 ** 14."""
    out = np.empty(len(counts), np.uint16)
    for at in range(0, len(counts), _BLOCK):
        steps = np.rint((_LARGEST - np.log10(counts[at : at + _BLOCK])) / _STEP)
        out[at : at + _BLOCK] = np.clip(steps, 0, _ABSENT - 1).astype(np.uint16)
    return out


def restore(steps: np.ndarray) -> np.ndarray:
    """The numbers of :func:`quantise`; 0 for :data:`_ABSENT`."""
    return np.where(steps == _ABSENT, 0.0, 10.0 ** (_LARGEST - _STEP * steps.astype(np.float64)))


class EliasFano:
    """A sorted sequence of unsigned 64-bit integers.

    The low bits of each are packed; the high parts are written in unary, so that zero bits
    count up the high part and one bits are entries. A search jumps to the entries with the
    query's high part, which are the ones between two zeros, and bisects their low bits. The unary
    bits stay packed: how many ones and zeros lie before every 128 bits is kept, the rest is counted.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.words = high.view("<u8")
        counts = np.bitwise_count(self.words).reshape(-1, 2).sum(axis=1, dtype=np.int64)
        ones = np.concatenate(([0], np.cumsum(counts)))
        zeros = _RUN * np.arange(len(ones)) - ones
        kind = np.uint32 if _RUN * len(ones) < 1 << 32 else np.int64
        self.ones, self.zeros = ones.astype(kind), zeros.astype(kind)
        self.n_zeros = int(zeros[-1])

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.low, self.words, self.ones, self.zeros))

    def _select(self, numbers: np.ndarray, zero: bool) -> np.ndarray:
        """Where in the unary bits the one, or zero, with each number stands."""
        before = self.zeros if zero else self.ones
        run = np.searchsorted(before, numbers.astype(before.dtype), side="right") - 1
        left = numbers - before[run].astype(np.int64)
        word, other = self.words[2 * run], self.words[2 * run + 1]
        if zero:
            word, other = ~word, ~other
        inside = np.bitwise_count(word).astype(np.int64)
        second = left >= inside
        left -= inside * second
        word = np.where(second, other, word)
        at = np.zeros(len(numbers), np.uint64)
        for step in (32, 16, 8, 4, 2, 1):
            inside = np.bitwise_count(word >> at & np.uint64((1 << step) - 1)).astype(np.int64)
            further = left >= inside
            left -= inside * further
            at += np.uint64(step) * further.astype(np.uint64)
        return _RUN * run + 64 * second + at.astype(np.int64)

    def _ends(self, high: np.ndarray) -> np.ndarray:
        """How many entries have a high part of at most ``high``."""
        return self._select(high, True) - high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64, copy=False)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(low_bits)).view(np.int64)
        ones += np.arange(n)
        bits = np.zeros((int(ones[-1]) + 2) if n else 1, np.uint8)
        bits[ones] = 1
        del ones
        high = padded(np.packbits(bits, bitorder="little"), _RUN // 8)
        del bits
        return cls(n, low_bits, pack_bits(values, low_bits), high)

    def lows(self, at: np.ndarray) -> np.ndarray:
        return read_bits(self.low, self.low_bits, at)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The values at positions: one select in the high bits, and the low bits."""
        at = at.astype(np.int64)
        high = (self._select(at, False) - at).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self.lows(at)

    def _search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the first entries not below the queries, and which of these are equal to them."""
        queries = queries.astype(np.uint64)
        high = (queries >> np.uint64(self.low_bits)).astype(np.int64)
        low = queries & np.uint64((1 << self.low_bits) - 1)
        beyond = (high < 0) | (high >= self.n_zeros)
        high = np.where(beyond, 0, high)
        first = np.where(high > 0, self._ends(np.maximum(high - 1, 0)), 0)
        last = np.where(beyond, first, self._ends(high))
        stop = last.copy()
        open_ = np.flatnonzero(first < last)
        while len(open_):
            middle = (first[open_] + last[open_]) >> 1
            below = self.lows(middle) < low[open_]
            first[open_[below]] = middle[below] + 1
            last[open_[~below]] = middle[~below]
            open_ = open_[first[open_] < last[open_]]
        same = first < stop  # entries with the query's high part
        same[same] = self.lows(first[same]) == low[same]
        return np.where(beyond, self.n, first), same

    def next_at(self, queries: np.ndarray) -> np.ndarray:
        """Positions of the first entries not below the queries (``n`` if there are none)."""
        return self._search(queries)[0]

    def find(self, queries: np.ndarray) -> np.ndarray:
        """Positions of the queries, -1 where they are missing."""
        at, same = self._search(queries)
        return np.where(same, at, -1)


def padded(values: np.ndarray, size: int = 8) -> np.ndarray:
    """The bytes of ``values``, filled up with zeros to a multiple of ``size``."""
    data = np.ascontiguousarray(values).reshape(-1).view(np.uint8)
    return np.concatenate((data, np.zeros(-len(data) % size, np.uint8)))


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits of each value, one after the other, with room for reads of 8 bytes and 1."""
    if not width or not len(values):
        return np.zeros(16, np.uint8)
    out = []
    for at in range(0, len(values), _BLOCK):  # a multiple of 8 values begins at a byte
        block = values[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(block, axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.reshape(-1), bitorder="little"))
    return np.concatenate([*out, np.zeros(16, np.uint8)])


def read_bits(packed: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.int64) * width
    byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
    words = np.ndarray((len(packed) - 7,), "<u8", packed, 0, (1,))  # eight bytes from each byte on
    word = words[byte] >> shift
    if width > 57:  # some lie in nine bytes
        spill = packed[byte + 8].astype(np.uint64)
        word |= np.where(shift > 0, spill << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    return word & np.uint64((1 << width) - 1) if width < 64 else word


# --- one shard -------------------------------------------------------------------


class Trie:
    """Contexts, pointers and successors of one shard, all views of one buffer.

    A successor has its discounted count, quantised. Over its context's total it is the smoothed probability;
    the pointers tell how many successors a context has, which is what backing off weighs.
    """

    _PARTS = ("contexts", "pointers", "successors", "third_pointers", "thirds")

    def __init__(self, buffer: bytes) -> None:
        self.buffer = buffer
        at = 8 * 32
        head = np.frombuffer(buffer, "<i8", 32).tolist()

        def view(size: int, kind) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(buffer, kind, size, at)
            at += -(-part.nbytes // 8) * 8  # all parts stay aligned
            return part

        self.n_contexts, self.n_successors, self.n_thirds = head[:3]
        self.totals = view(self.n_contexts, "<i8")
        self.quantised = view(self.n_successors, "<u2")
        self.third_quantised = view(self.n_thirds, "<u2")
        for i, name in enumerate(self._PARTS):
            n, low_bits, low, high = head[3 + 4 * i : 7 + 4 * i]
            setattr(self, name, EliasFano(n, low_bits, view(low, np.uint8), view(high, np.uint8)))

    @classmethod
    def build(
        cls, contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, discount: float = DISCOUNT,
        thirds: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
    ) -> Trie:
        """From counted bigrams, repeats allowed; those with count 0 leave no trace.

        ``thirds`` are counted words after bigrams: which of the given bigrams, the word, the count.
        """
        seen = counts > 0
        own, rank, totals = _counted(contexts[seen], counts[seen])
        keys = rank.astype(np.uint64)
        del rank
        keys <<= np.uint64(_WORD_BITS)
        keys |= words[seen]
        keys, number, summed = _counted(keys, counts[seen])
        kinds = np.bincount((keys >> np.uint64(_WORD_BITS)).view(np.int64), minlength=len(own))
        third_keys, third_sums = np.empty(0, np.uint64), np.empty(0, np.int64)
        if thirds is not None:
            after, third_words, third_counts = thirds
            entry = np.zeros(len(contexts), number.dtype)  # a counted third word has a counted bigram
            entry[seen] = number
            seen = third_counts > 0
            third_keys = entry[after[seen]].astype(np.uint64)
            del entry, number
            third_keys <<= np.uint64(_THIRD_BITS)
            third_keys |= third_words[seen]
            third_keys, _, third_sums = _counted(third_keys, third_counts[seen])
            del after, third_words, third_counts, _
        third_kinds = np.bincount((third_keys >> np.uint64(_THIRD_BITS)).view(np.int64), minlength=len(keys))
        head = np.zeros(32, "<i8")
        head[:3] = len(own), len(keys), len(third_keys)
        data = [totals.astype("<i8", copy=False)]
        data += [quantise(x - discount).astype("<u2", copy=False) for x in (summed, third_sums)]
        del totals, summed, third_sums, seen
        levels = [own, np.append(0, np.cumsum(kinds)), keys, np.append(0, np.cumsum(third_kinds)), third_keys]
        del own, kinds, keys, third_kinds, third_keys
        for i in range(len(levels)):
            level, levels[i] = EliasFano.of(levels[i]), None
            head[3 + 4 * i : 7 + 4 * i] = level.n, level.low_bits, len(level.low), len(level.high)
            data += [level.low, level.high]
        return cls(b"".join(padded(a).data for a in (head, *data)))

    def context(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranks (-1: unknown), how often each was seen, and with how many successors."""
        rank = self.contexts.find(contexts)
        known = np.flatnonzero(rank >= 0)
        totals, kinds = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        totals[known] = self.totals[rank[known]]
        kinds[known] = (self.pointers[rank[known] + 1] - self.pointers[rank[known]]).astype(np.int64)
        return rank, totals, kinds

    def place(self, rank: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Where words after contexts stand, -1 if they are absent."""
        return _after(self.successors, rank, words, _WORD_BITS)

    def successor(self, rank: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Quantised discounted counts of words after contexts, or absent."""
        return _taken(self.quantised, self.place(rank, words))

    def third(self, place: np.ndarray, runs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words follow each bigram, and the quantised discounted counts of ``runs`` words after each."""
        known = np.flatnonzero(place >= 0)
        kinds = np.zeros(len(place), np.int64)
        kinds[known] = (self.third_pointers[place[known] + 1] - self.third_pointers[place[known]]).astype(np.int64)
        return kinds, _taken(self.third_quantised, _after(self.thirds, np.repeat(place, runs), words, _THIRD_BITS))


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, the number of each given one among them, and their summed counts."""
    order = np.argsort(keys, kind="stable").astype(_index(len(keys)), copy=False)
    keys = keys[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    keys = keys[starts]
    number = np.empty(len(order), order.dtype)
    number[order] = np.cumsum(new, dtype=order.dtype) - 1
    if not len(starts):
        return keys, number, np.empty(0, np.int64)
    return keys, number, np.add.reduceat(counts[order], starts, dtype=np.int64)


def _index(n: int):
    """The type of positions below ``n``, half as wide as usual where that is enough."""
    return np.int32 if n < 1 << 31 else np.int64


def _after(level: EliasFano, place: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    out = np.full(len(place), -1, np.int64)
    known = np.flatnonzero(place >= 0)
    out[known] = level.find(place[known].astype(np.uint64) << np.uint64(bits) | words[known])
    return out


def _taken(quantised: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.full(len(at), _ABSENT, np.uint16)
    out[at >= 0] = quantised[at[at >= 0]]
    return out


# --- chunks ----------------------------------------------------------------------


def _chunks(key_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        names: dict[bytes, int] = {}
        keys, held, ends, tokens = [], [], [], []
        size = 0

        def row() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
            ids = np.concatenate(tokens) if tokens else np.empty(0, np.uint32)
            counts = np.bincount(ids, minlength=len(names))
            often = np.flatnonzero(counts >= _NOTED)
            noted = np.append(hashes[often], _EDGE).view(np.int64)
            columns = {
                "chunk": pa.array([chunk], pa.int64()),
                "keys": pa.array([keys], pa.list_(key_type)),
                "held": pa.array([np.array(held, np.uint8).tobytes()], pa.binary()),
                "ends": pa.array([pack(np.array(ends, np.int64))], pa.binary()),
                "words": pa.array([hashes.tobytes()], pa.binary()),
                "tokens": pa.array([pack(ids)], pa.binary()),
                "noted": pa.array([noted], pa.list_(pa.int64())),
                "times": pa.array([np.append(counts[often], len(keys))], pa.list_(pa.int64())),
                "n_tokens": pa.array([size + len(keys)], pa.int64()),
            }
            return pa.RecordBatch.from_pydict(columns)

        number = names.setdefault
        for batch in batches:
            texts = batch.column("text").cast(pa.string())
            for key, out, text in zip(batch.column("key").to_pylist(), batch.column("held").to_pylist(), texts):
                text = text.as_py()
                words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()  # ASCII
                ids = np.fromiter((number(w, len(names)) for w in words), np.uint32, len(words))
                size += len(ids)
                keys.append(key)
                held.append(out)
                ends.append(size)
                tokens.append(ids)
                if size >= _CHUNK_TOKENS:
                    yield row()
                    chunk += 1
                    names.clear()
                    keys, held, ends, tokens, size = [], [], [], [], 0
        if keys:
            yield row()

    return run


class _Chunk:
    """The n-grams of a chunk, each different one once, ordered by their words."""

    def __init__(self, row, order: int) -> None:
        self.words = np.concatenate((np.frombuffer(row["words"], "<u8"), [_EDGE]))
        self.ends = unpack(row["ends"])
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        tokens = unpack(row["tokens"])
        edge = len(self.words) - 1
        n = len(tokens) + len(self.ends)
        last = self.ends + np.arange(len(self.ends))  # where each text's end token is
        self.starts = np.concatenate(([0], last[:-1] + 1)).astype(np.int64)
        place = np.ones(n, bool)
        place[last] = False
        self.word = np.full(n, edge, _index(len(self.words)))
        self.word[place] = tokens
        del tokens, place
        self.lengths = np.diff(np.concatenate((self.starts, [n])))
        trained = np.repeat(~self.held, self.lengths)
        keys = np.full(n, edge, np.int64)  # before each text stands an edge, too
        keys[1:] = self.word[:-1]
        self.bigram, self.context, self.successor, self.counts = self._distinct(keys, self.word, trained)
        # The third words: of all tokens but the first of each text, after the bigram before.
        self.later = np.zeros(n, bool)
        if order > 2:
            self.later[:] = True
            self.later[self.starts] = False
        keys = self.bigram[:-1][self.later[1:]].astype(np.int64)
        self.third, self.third_after, self.third_word, self.third_counts = self._distinct(
            keys, self.word[self.later], trained[self.later]
        )  # the first of them of each later token
        self.third_bigram = np.zeros(len(self.third_after), self.bigram.dtype)  # of its last two words
        self.third_bigram[self.third] = self.bigram[self.later]
        kinds = np.bincount(self.third_after, minlength=len(self.context))
        self.third_starts = np.concatenate(([0], np.cumsum(kinds))).astype(_index(n))

    def _distinct(self, before: np.ndarray, word: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each pair its number among the different ones; what is before in these, their words and how often they are trained on."""
        before *= len(self.words)
        before += word
        unique, number, counts = _counted(before, trained)
        word = (unique % len(self.words)).astype(word.dtype)
        unique //= len(self.words)
        return number, unique.astype(_index(len(before))), word, counts.astype(_index(len(before)))

    def thirds(self, bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many third words each bigram has, and which."""
        first = self.third_starts[bigrams]
        runs = self.third_starts[bigrams + 1] - first
        within = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        return runs, np.repeat(first, runs) + within

    def messages(self, shards: int, hot: Hot) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Each shard that the chunk asks, with its contexts, their numbers of bigrams and the bigrams.

        A context belongs to one shard, a hot one to as many as it has parts, by successor.
        """
        kind = np.min_scalar_type(shards)  # narrow numbers sort faster
        home = (self.words >> np.uint64(32)) % np.uint64(shards)
        parts = hot.parts_of(self.words)
        shard = home.astype(kind)[self.context]
        spread = np.flatnonzero((parts > 1)[self.context])
        context, low = self.context[spread], self.words[self.successor[spread]] & _WORD_MASK
        shard[spread] = ((home[context] + low % parts[context]) % np.uint64(shards)).astype(kind)
        order = np.argsort(shard, kind="stable").astype(self.bigram.dtype, copy=False)  # in a shard still ordered by context
        ordered = shard[order]
        del home, parts, shard, spread, context, low
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        for a, b in zip(starts, np.append(starts[1:], len(order))):
            bigrams = order[a:b]
            context = self.context[bigrams]
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            yield int(ordered[a]), context[first], np.diff(np.append(first, len(context))), bigrams


class Hot:
    """Contexts that several shards share, sorted by hash."""

    def __init__(self, words: np.ndarray, parts: np.ndarray) -> None:
        order = np.argsort(words)
        self.words, self.parts = words[order], parts[order].astype(np.uint64)

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``words`` are hot, and where they stand."""
        if not len(self.words):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        found = np.flatnonzero(self.words[at] == words)
        return found, at[found]

    def parts_of(self, words: np.ndarray) -> np.ndarray:
        parts = np.ones(len(words), np.uint64)
        found, at = self.places(words)
        parts[found] = self.parts[at]
        return parts


def _hot(chunks: DataFrame, tokens: int, shards: int) -> Hot:
    """Contexts with more than a quarter of a shard's tokens, in parts of half a shard at most.

    What chunks note adds up to no more than all tokens, so there are at most four per shard, and
    never more than 262,144.
    """
    noted = chunks.select(F.explode(F.arrays_zip("noted", "times")).alias("x"))
    counted = noted.groupBy(F.col("x.noted").alias("word")).agg(F.sum("x.times").alias("n"))
    rows = counted.filter(F.col("n") * F.lit(4 * shards) > F.lit(tokens)).orderBy(F.desc("n"), "word")
    found = rows.limit(min(4 * shards, _MAX_HOT)).collect()
    words = np.array([r["word"] for r in found], np.int64).view(np.uint64)
    share = np.array([r["n"] for r in found], np.float64) / max(tokens, 1)
    return Hot(words, np.minimum(np.ceil(2 * shards * share), shards))


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32) if values.max(initial=0) < 1 << 32 else values


def _narrow(words: np.ndarray, bits: int = _WORD_BITS) -> bytes:
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes()


_ASKED = ["chunk", "shard", "contexts", "runs", "words", "counts", "third_runs", "third_words", "third_counts"]


def _questions(shards: int, hot: Hot, order: int):

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                chunk = _Chunk(row, order)
                low = chunk.words & _WORD_MASK
                out = []
                for shard, contexts, runs, asked in chunk.messages(shards, hot):
                    third_runs, thirds = chunk.thirds(asked)
                    out.append((
                        row["chunk"], shard, chunk.words[contexts].astype("<u8").tobytes(), pack(_small(runs)),
                        _narrow(low[chunk.successor[asked]]), pack(_small(chunk.counts[asked])),
                        pack(_small(third_runs)), _narrow(low[chunk.third_word[thirds]], _THIRD_BITS),
                        pack(_small(chunk.third_counts[thirds])),
                    ))
                yield pd.DataFrame(out, columns=_ASKED)

    return run


def _keys(data: bytes, bits: int = _WORD_BITS) -> np.ndarray:
    narrow = np.frombuffer(data, np.uint8).reshape(-1, bits // 8)
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, : bits // 8] = narrow
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def _answers(discount: float, hot: Hot):
    names = ["chunk", "shard", "totals", "kinds", "found", "third_kinds", "third_found",
             "n", "v", "hot", "hot_totals", "hot_kinds"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        contexts = [np.frombuffer(x, "<u8") for x in pdf["contexts"]]
        runs = [unpack(x).astype(np.int64) for x in pdf["runs"]]
        every = np.concatenate([np.repeat(c, r) for c, r in zip(contexts, runs)])
        words = np.concatenate([_keys(x) for x in pdf["words"]])
        third_runs = [unpack(x).astype(np.int64) for x in pdf["third_runs"]]
        after = np.repeat(np.arange(len(every), dtype=_index(len(every))), np.concatenate(third_runs))
        third_words = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["third_words"]])
        counts, third_counts = (np.concatenate([unpack(x) for x in pdf[c]]) for c in ("counts", "third_counts"))
        trie = Trie.build(every, words, counts, discount, (after, third_words, third_counts))
        del every, words, after, third_words, counts, third_counts  # the trie takes their place
        spread = trie.context(hot.words)
        seen = np.flatnonzero(spread[0] >= 0)
        out = []
        for i, (c, r) in enumerate(zip(contexts, runs)):
            rank, totals, kinds = trie.context(c)
            place = trie.place(np.repeat(rank, r), _keys(pdf["words"].iloc[i]))
            after = trie.third(place, third_runs[i], _keys(pdf["third_words"].iloc[i], _THIRD_BITS))
            row = [pdf["chunk"].iloc[i], pdf["shard"].iloc[i], pack(_small(totals)), pack(_small(kinds))]
            row += [pack(_taken(trie.quantised, place)), pack(_small(after[0])), pack(after[1])]
            if i:
                row += [0, 0, [], [], []]
            else:  # the shard's own figures; parts of hot contexts are not counted as contexts
                row += [int(trie.totals.sum()), trie.n_contexts - len(seen), hot.words[seen].view(np.int64)]
                row += [x[seen] for x in spread[1:]]
            out.append(row)
        return pd.DataFrame(out, columns=names)

    return run


def _scores(
    shards: int, n: int, v: int, discount: float, hot: Hot, hot_totals: np.ndarray, hot_kinds: np.ndarray, order: int
):
    names = ["key", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ("totals", "kinds", "found", "third_kinds", "third_found")
        answered = dict(zip(right["shard"], zip(*(right[c] for c in columns))))
        out = []
        for row in left.to_dict("records"):
            chunk = _Chunk(row, order)
            totals, kinds = np.zeros(len(chunk.words), np.int64), np.zeros(len(chunk.words), np.int64)
            # Counts stay quantised until they are used.
            counts, third_kinds = np.full(len(chunk.context), _ABSENT, np.uint16), np.zeros(len(chunk.context), chunk.third.dtype)
            third_counts = np.full(len(chunk.third_after), _ABSENT, np.uint16)
            for shard, contexts, _, bigrams in chunk.messages(shards, hot):
                t, k, f, third_k, third_f = map(unpack, answered[shard])
                totals[contexts], kinds[contexts] = t, k
                counts[bigrams], third_kinds[bigrams] = f, third_k
                third_counts[chunk.thirds(bigrams)[1]] = third_f
            found, at = hot.places(chunk.words)  # of these the shards know parts only
            totals[found], kinds[found] = hot_totals[at], hot_kinds[at]
            single = (totals + 1) / (n + v + 1)
            base = np.log10(single)
            seen = np.maximum(totals, 1)
            backoff = np.where(totals > 0, discount * kinds / seen, 1.0)
            two, pairs = np.empty(len(counts)), np.empty(len(counts))
            for at in range(0, len(two), _BLOCK):
                some = slice(at, at + _BLOCK)
                context, count = chunk.context[some], restore(counts[some])
                two[some] = count / seen[context] + backoff[context] * single[chunk.successor[some]]
                # How often a bigram was seen is its discounted count and the discount, a whole number.
                pairs[some] = np.where(count > 0, np.rint(count + discount), 0)
            three = np.empty(len(third_counts))
            for at in range(0, len(three), _BLOCK):
                some = slice(at, at + _BLOCK)
                after = chunk.third_after[some]
                of = np.maximum(pairs[after], 1)
                weight = np.where(pairs[after] > 0, discount * third_kinds[after] / of, 1.0)
                three[some] = np.log10(restore(third_counts[some]) / of + weight * two[chunk.third_bigram[some]])
            del counts, third_kinds, third_counts, pairs
            whole = np.log10(two, out=two)[chunk.bigram]
            whole[chunk.later] = three[chunk.third]
            del two, three
            whole = np.add.reduceat(whole, chunk.starts)
            first = np.add.reduceat(base[chunk.word], chunk.starts)
            known = np.add.reduceat((totals > 0)[chunk.word], chunk.starts, dtype=np.int64)
            keys = pd.Series(list(row["keys"]), dtype="object")
            out.append(pd.DataFrame(dict(zip(names, (keys, chunk.held, chunk.lengths, known, first, whole)))))
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    return run


def score(
    docs: DataFrame,
    held_out: Column,
    key: str = "doc_id",
    text: str = "text",
    discount: float = DISCOUNT,
    order: int = 2,
) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The model learns from the rows where ``held_out`` is not true and scores all. Tokens are
    runs of anything but ASCII white space with A-Z lower-cased, and one end; a NULL or empty text is
    only its end. With ``c`` a token's count among the ``N`` training tokens, ``V`` of them
    distinct, ``base_score`` sums ``log10((c + 1) / (N + V + 1))``. ``score`` sums
    ``log10(max(c(uw) - discount, 0) / c(u) + discount * d(u) / c(u) * (c(w) + 1) / (N + V + 1))``
    for ``w`` after ``u``, of which ``d(u)`` different words follow; after a word never seen in training only the
    last factor counts. At ``order`` 3 this is what a third word backs off to: after ``t u`` it is
    ``max(c(tuw) - discount, 0) / c(tu) + discount * d(tu) / c(tu)`` times the above, where ``t u`` was seen in training; the first
    token of a text has one word before it. For each context this sums to 1 over the known words and one unknown one.
    The discounted counts are quantised to 1/4096 in the logarithm.

    ``n_known`` counts tokens seen in training. Without training rows nothing is known.
    Keys may be NULL or repeat, repeated rows are scored (and counted) each. Words are told
    apart by 64-bit hashes as contexts, 40 bits after a given context and 32 after two given words.
    Other columns are ignored; an empty table gives an empty one.
    """
    import pyarrow as pa  # noqa: F401

    from pyspark.sql.pandas.types import to_arrow_type

    if order not in (2, 3):
        raise ValueError(f"the order is 2 or 3, not {order}")
    kind = docs.schema[key].dataType
    name = kind.simpleString()
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).cast("string").alias("text")
    )
    chunks = scratch_table(
        rows.mapInArrow(
            _chunks(to_arrow_type(kind)),
            f"chunk long, keys array<{name}>, held binary, ends binary, words binary, tokens binary, noted array<long>, "
            "times array<long>, n_tokens long",
        ),
        "chunks",
    )
    tokens = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).head()[0]
    shards = max(1, -(-tokens // _SHARD_TOKENS))
    spread = _hot(chunks, tokens, shards)  # some megabytes at most, which go with the tasks
    chunks = chunks.drop("noted", "times", "n_tokens")
    asked = chunks.drop("keys").mapInPandas(
        _questions(shards, spread, order),
        "chunk long, shard int, contexts binary, runs binary, words binary, counts binary, "
        "third_runs binary, third_words binary, third_counts binary",
    )
    answers = scratch_table(
        asked.groupBy("shard").applyInPandas(
            _answers(discount, spread),
            "chunk long, shard int, totals binary, kinds binary, found binary, third_kinds binary, third_found binary, n long, v long, "
            "hot array<long>, hot_totals array<long>, hot_kinds array<long>",
        ),
        "answers",
    )
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).head()
    parts = answers.select(F.explode(F.arrays_zip("hot", "hot_totals", "hot_kinds")).alias("x"))
    summed = parts.groupBy("x.hot").agg(F.sum("x.hot_totals"), F.sum("x.hot_kinds")).collect()  # at most _MAX_HOT
    hot_totals, hot_kinds = (np.zeros(len(spread.words), np.int64) for _ in range(2))
    for word, total, kinds in summed:
        at = np.searchsorted(spread.words, np.int64(word).view(np.uint64))
        hot_totals[at], hot_kinds[at] = total, kinds
    v += len(summed)
    scored = (
        chunks.groupBy("chunk")
        .cogroup(answers.drop("n", "v", "hot", "hot_totals", "hot_kinds").groupBy("chunk"))
        .applyInPandas(
            _scores(shards, n, v, discount, spread, hot_totals, hot_kinds, order),
            f"key {name}, held_out boolean, n_tokens long, n_known long, base_score double, score double",
        )
    )
    return scored.select(
        F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
