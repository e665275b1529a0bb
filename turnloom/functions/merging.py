"""Byte-level merge coding with a vocabulary of the user's model.

A text is cut into pieces by a pattern, a piece into its bytes; then the pair of neighbours with the
best rank is merged, the leftmost of equal ones, until no pair is known. A queue of pairs keeps
that near linear also for very long pieces, and what a task has coded before it looks up.
"""

from __future__ import annotations

import base64
import json
import sys
from collections.abc import Callable, Mapping, Sequence
from heapq import heapify, heappop, heappush
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: how the best known of these vocabularies cuts a text before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_REMEMBERED = 1 << 17  # short pieces whose codes a task keeps
_SHORT = 64
_FEW = 24


class MergeCoder:
    """Texts to ids and back.

    ``ranks`` are the ids of all tokens, among them those of the 256 bytes. Any two neighbours that make a
    token can be merged, the token with the smallest id first; or with ``merges`` only the pairs listed there,
    the first one first. Strings of ``special`` tokens in a text are ordinary text.
    """

    def __init__(
        self, ranks: Mapping[bytes, int], pattern: str = PIECES,
        merges: Sequence[tuple[bytes, bytes]] | None = None, special: Mapping[str, int] | None = None,
    ) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 bytes, {missing[0]:#04x} the first")
        self.ranks = dict(ranks)
        self.merges = None if merges is None else {pair: i for i, pair in enumerate(merges)}
        self.pattern, self.special = pattern, dict(special or {})
        self._ready()

    def __getstate__(self) -> dict[str, Any]:
        return {k: v for k, v in self.__dict__.items() if k in ("ranks", "merges", "pattern", "special")}

    def __setstate__(self, state: dict[str, Any]) -> None:
        self.__dict__.update(state)
        self._ready()

    def _ready(self) -> None:
        import regex

        self._cut = regex.compile(self.pattern).findall
        self._none = 1 + max([*self.ranks.values(), len(self.merges or ())])  # above every rank
        self._known: dict[bytes, tuple[int, ...]] = {}
        self._bytes = {i: token for token, i in self.ranks.items()}
        self._bytes |= {i: name.encode() for name, i in self.special.items()}

    def _rank(self, left: bytes, right: bytes) -> int | None:
        if self.merges is None:
            return self.ranks.get(left + right)
        return self.merges.get((left, right))

    def _merged_short(self, piece: bytes) -> list[int]:
        """The same by looking through all pairs each time, which is faster for a few bytes."""
        rank, none = self._rank, self._none
        best = lambda a, b: none if (r := rank(a, b)) is None else r
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [best(a, b) for a, b in zip(parts, parts[1:])]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = best(parts[i], parts[i + 1])
            if i:
                pairs[i - 1] = best(parts[i - 1], parts[i])
        return [self.ranks[p] for p in parts]

    def _merged(self, piece: bytes) -> list[int]:
        if self.merges is None and piece in self.ranks:
            return [self.ranks[piece]]
        if len(piece) <= _FEW:
            return self._merged_short(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        queue = [(r, i, 2) for i in range(len(parts) - 1) if (r := self._rank(parts[i], parts[i + 1])) is not None]
        heapify(queue)

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts):
                rank = self._rank(parts[i], parts[j])
                if rank is not None:
                    heappush(queue, (rank, i, len(parts[i]) + len(parts[j])))

        while queue:
            _, i, size = heappop(queue)
            j = after[i]
            # A pair is out of date once one of its parts has been merged with another one.
            if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ranks[p] for p in parts if p is not None]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self._known
        for piece in self._cut(text):
            data = piece.encode("utf-8", "surrogatepass")
            ids = known.get(data)
            if ids is None:
                ids = tuple(self._merged(data))
                if len(data) <= _SHORT:
                    if len(known) >= _REMEMBERED:
                        known.clear()
                    known[data] = ids
            out += ids
        return out

    def decode(self, ids: Sequence[int], skip_special: bool = True) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, unknown ids raise."""
        left_out = set(self.special.values()) if skip_special else ()
        return b"".join(self._bytes[i] for i in ids if i not in left_out).decode("utf-8", "replace")

    def tokenizer(self) -> Callable[[list[str]], list[list[int]]]:
        """For ``tokenise``, as a factory; NULL texts have no tokens."""
        return lambda texts: [None if t is None else self.encode(t) for t in texts]

    def decoder(self, skip_special: bool = True) -> Callable[[list[list[int]]], list[str]]:
        """For ``batch_infer`` and ``parse_ids``, as a factory."""
        return lambda batch: [self.decode(ids, skip_special) for ids in batch]


# Fixed rule: vocabularies in JSON write a byte as a printable character, its own where it has one.
def _characters() -> dict[str, int]:
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def load_merge_coder(spark: SparkSession, path: str, pattern: str = PIECES) -> MergeCoder:
    """A coder from a vocabulary file: lines of a base64 token and its rank, or a byte-level ``tokenizer.json``.

    The driver reads it and the coder goes to the tasks, so executors need not see the file.
    """
    if not path.endswith(".json"):
        rows = spark.read.text(path).filter("value <> ''").collect()  # one per token
        pairs = (r["value"].split() for r in rows)
        return MergeCoder({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)
    settings = json.loads(spark.read.text(path, wholetext=True).head()[0])
    model = settings["model"]
    if model.get("type", "BPE") != "BPE" or model.get("end_of_word_suffix") or model.get("byte_fallback"):
        raise ValueError(f"{path} is not a byte-level merge vocabulary")
    special = {t["content"]: t["id"] for t in settings.get("added_tokens", ())}
    characters = _characters()

    def token(text: str) -> bytes:
        return bytes(characters[c] for c in text)

    ranks = {token(text): i for text, i in model["vocab"].items() if text not in special}
    merges = [tuple(map(token, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    return MergeCoder(ranks, pattern, merges, special)
