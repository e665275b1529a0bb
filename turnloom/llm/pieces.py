"""SentencePiece-style encoding and decoding with a given vocabulary.

An Aho-Corasick automaton over the pieces reads a text once. At each character the output
links name the pieces that end there, and each relaxes the best score of that position.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import by_value

by_value(__name__)

MARK = "▁"  # stands for a space inside pieces
_UNKNOWN_PENALTY = 10.0
_MEMO = 250_000
_LONGEST_MEMO = 48
_LEARNED_EDGES = 500_000
_ROWS_PER_BATCH = 512


class Vocabulary(NamedTuple):
    """Ids are positions. ``kinds``: ``n`` a normal piece, ``b`` one byte, ``x`` never matched."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str


def load_vocabulary(path: str) -> Vocabulary:
    """Read a model file on the driver; tasks get the pieces, not the path."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kinds = "".join(
        "b" if model.is_byte(i) else "x" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "n"
        for i in ids
    )
    return Vocabulary(
        tuple(model.id_to_piece(i) for i in ids), tuple(model.get_score(i) for i in ids), kinds
    )


class _Memo(dict):
    """Ids (as bytes) and scores of words. What was not asked for since the last time goes."""

    def __init__(self, solve) -> None:
        super().__init__()
        self.solve, self.old = solve, {}

    def __missing__(self, chunk: str) -> tuple[bytes, float]:
        found = self.old.get(chunk) or self.solve(chunk)
        if len(chunk) <= _LONGEST_MEMO:
            if len(self) >= _MEMO:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found


def _cutter(pieces: list[str]):
    """Cuts a marked text where no piece can lie across, so that its parts can be solved apart.

    That is before each run of space marks and between letters and other characters, if the
    vocabulary has no piece with such a place inside; or else a text stays whole.
    """
    letters = {c for p in pieces for c in p if c.isalpha()}
    kind = lambda c: 0 if c == MARK else 1 if c in letters else 2
    inside = {(kind(a), kind(b)) for p in pieces for a, b in zip(p, p[1:])}
    if not letters or inside & {(1, 0), (2, 0)}:
        return lambda text: [text] if text else []
    if inside & {(1, 2), (2, 1)}:
        return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
    known = "".join(map(re.escape, sorted(letters)))
    return re.compile(f"{MARK}*[{known}]+|{MARK}*[^{known}{MARK}]+|{MARK}+").findall


class Codec:
    """Encodes with the segmentation of the highest total score.

    Of equal scores the one with the longest last piece is taken, position by position. A
    character without a piece of its own costs 10 more than the worst piece and is written
    as its UTF-8 bytes, or as id 0 if the vocabulary has no bytes. So decoding gives
    back every text exactly if there are byte pieces.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        pieces, scores, kinds = vocabulary
        normal = [i for i, k in enumerate(kinds) if k == "n" and pieces[i]]
        byte_ids = {int(pieces[i][3:-1], 16): i for i, k in enumerate(kinds) if k == "b"}
        self.byte_ids = byte_ids if len(byte_ids) == 256 else {}
        self.id_bytes = {i: bytes((b,)) for b, i in byte_ids.items()}
        self.texts = [p.replace(MARK, " ") if k == "n" else "" for p, k in zip(pieces, kinds)]
        for b, i in byte_ids.items():  # beyond ASCII only several bytes together make text
            self.texts[i] = chr(b) if b < 128 else None
        self.unknown = (1, min((scores[i] for i in normal), default=0.0) - _UNKNOWN_PENALTY, -1)
        self.chunks = _cutter([pieces[i] for i in normal])
        self.memo = _Memo(self._viterbi)
        self._build([(pieces[i], scores[i], i) for i in normal])

    def _build(self, entries: list[tuple[str, float, int]]) -> None:
        goto: list[dict[str, int]] = [{}]
        ends: list[tuple[int, float, int] | None] = [None]
        for piece, score, i in entries:
            node = 0
            for c in piece:
                after = goto[node].get(c)
                if after is None:
                    after = goto[node][c] = len(goto)
                    goto.append({})
                    ends.append(None)
                node = after
            if ends[node] is None or score > ends[node][1]:
                ends[node] = (len(piece), score, i)
        fail = [0] * len(goto)
        outputs: list[tuple] = [()] * len(goto)  # the output links of a node, followed
        level = [0]
        while level:
            below = []
            for node in level:
                own = (ends[node],) if ends[node] else ()
                outputs[node] = own + (outputs[fail[node]] if node else ())
                for c, child in goto[node].items():
                    back = fail[node]
                    while back and c not in goto[back]:
                        back = fail[back]
                    fail[child] = goto[back].get(c, 0) if node else 0
                    below.append(child)
            level = below
        self.goto, self.fail, self.outputs, self.learned = goto, fail, outputs, 0

    def _after_failing(self, state: int, c: str) -> int:
        """Where the failure links lead; the way is kept as an edge, up to a number of them."""
        goto, fail, start = self.goto, self.fail, state
        while state and c not in goto[state]:
            state = fail[state]
        state = goto[state].get(c, 0)
        if self.learned < _LEARNED_EDGES:
            self.learned += 1
            goto[start][c] = state
        return state

    def _viterbi(self, text: str) -> tuple[bytes, float]:
        goto, outputs, unknown = self.goto, self.outputs, self.unknown
        best, back, state = [0.0], [unknown], 0
        add, step, never = best.append, back.append, float("-inf")
        for c in text:
            try:
                state = goto[state][c]
            except KeyError:
                state = self._after_failing(state, c)
            top, link = never, unknown
            for out in outputs[state]:  # from the longest piece that ends here to the shortest
                total = best[-out[0]] + out[1]
                if total > top:
                    top, link = total, out
            if link[0] > 1 or link is unknown:  # a piece of this one character beats the unknown
                total = best[-1] + unknown[1]
                if total > top:
                    top, link = total, unknown
            add(top)
            step(link)
        ids, end = [], len(text)
        while end:
            length, _, piece = back[end]
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend(reversed(self._bytes(text[end - 1])))
            end -= length
        ids.reverse()
        return array("i", ids).tobytes(), best[-1]

    def _bytes(self, character: str) -> list[int]:
        encoded = character.encode("utf-8", "surrogatepass")
        return [self.byte_ids[b] for b in encoded] if self.byte_ids else [0]

    def encode(self, text: str | None) -> tuple[array, float]:
        """Ids and their total score; a space is put before the text. NULL and empty: none."""
        ids, score = array("i"), 0.0
        if not text:
            return ids, score
        # The mark itself, should a text hold it, is written as bytes: it must not become a space.
        for i, part in enumerate(text.split(MARK)):
            if i:
                ids.extend(self._bytes(MARK))
                score += self.unknown[1]
            marked = part.replace(" ", MARK) if i else MARK + part.replace(" ", MARK)
            found = list(map(self.memo.__getitem__, self.chunks(marked)))
            ids.frombytes(b"".join([x[0] for x in found]))
            score += sum([x[1] for x in found])
        return ids, score

    def decode(self, ids) -> str:
        """The text of ids; ids outside the vocabulary and control pieces give nothing."""
        texts, id_bytes = self.texts, self.id_bytes
        if min(ids, default=0) < 0:
            ids = [i for i in ids if i >= 0]
        try:
            text = "".join([texts[i] for i in ids])
        except (TypeError, IndexError):
            raw = b"".join([
                id_bytes.get(i) or texts[i].encode("utf-8", "surrogatepass") for i in ids if i < len(texts)
            ])
            text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", verify: bool = True) -> DataFrame:
    """``df`` and ``n_tokens`` (long), ``ids`` (int array), ``score`` (double), ``round_trip``.

    ``round_trip`` tells whether decoding the ids gives the text; with ``verify`` off it is NULL.
    A NULL or empty text has no ids and score 0. Columns of these names are replaced, all others
    pass through. The whole text is encoded; texts that never pause are one long word. One
    pass without a shuffle; the vocabulary (a model file's size) goes with the tasks.
    """
    added = ("n_tokens", "ids", "score", "round_trip")
    source = df.select([F.col(f"`{c}`") for c in df.columns if c not in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS_PER_BATCH):
                batch = whole.slice(at, _ROWS_PER_BATCH)
                flat, offsets, scores, same = array("i"), array("i", [0]), [], []
                for value in batch.column(text).cast(pa.string()):
                    value = value.as_py()
                    ids, score = codec.encode(value)
                    flat.extend(ids)
                    offsets.append(len(flat))
                    scores.append(score)
                    same.append(codec.decode(ids) == (value or "") if verify else None)
                starts = pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)])
                values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
                lists = pa.ListArray.from_arrays(starts, values)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, lists.value_lengths().cast(pa.int64()), lists,
                     pa.array(scores, pa.float64()), pa.array(same, pa.bool_())],
                    [*batch.schema.names, *added],
                )

    kinds = (T.LongType(), T.ArrayType(T.IntegerType()), T.DoubleType(), T.BooleanType())
    fields = [*source.schema.fields, *map(T.StructField, added, kinds)]
    return source.mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "text") -> DataFrame:
    """``df`` with the text of ``ids`` in column ``into``; NULL ids give NULL."""

    @F.pandas_udf("string")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(vocabulary)
        for column in columns:
            yield column.map(lambda x: None if x is None else codec.decode(x.tolist()))

    return df.withColumn(into, run(F.col(ids)))
