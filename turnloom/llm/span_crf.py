"""Personal data: exact patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole candidate spans, not characters. In each window of numbers and
addresses dynamic programming picks the segmentation, boundaries and kinds together, whose
total score is highest. Candidates go beyond the patterns: numbers in the shape of a phone
without ``+``, cards with other separators or of 13 to 15 digits, addresses that spell out their
signs. Whether a pattern holds, and a telling word stands before, are features like others.

It is trained here: on a bounded number of texts in which the exact patterns leave no doubt, and
on examples that are planted, because of the looser forms no pattern tells which are meant.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import bounded_sample, by_value

by_value(__name__)

KINDS = ("email", "ip", "card", "phone")
MAX_TEXTS = 3000
_MAX_WINDOWS = 20  # of one training text
_MAX_DIGITS = 19  # of a segment; the kinds have no more, but for leading zeros of an address
_MAX_ATOMS = 64  # of a segment: 19 digits one by one with up to two separators between them, and more

Span = tuple[str, int, int]

# --- exact patterns ----------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A number starts where no digit stands before: a later start would fail like the first.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _is_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_card(text: str) -> bool:
    digits = _only_digits(text)
    return 16 <= len(digits) <= 19 and _luhn(digits)


def _is_phone(text: str) -> bool:
    return 8 <= len(_only_digits(text)) <= 15


def _emails(text: str) -> Iterator[Span]:
    """At each ``@`` the longest name before and domain after it, as a scan from the left finds."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            free = domain.end()
        else:
            free = at + 1  # no name reaches over a sign that failed
        at = text.find("@", max(free, at + 1))


# --- looser forms, of which the field decides ------------------------------------------

_AT = re.compile(r"\x20?[\[({]\x20?at\x20?[\])}]\x20?", re.IGNORECASE)
_SPELLED = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?)[A-Za-z0-9-]+)+", re.IGNORECASE)
_LOOSE_PHONE = re.compile(r"(?:[0-9][ .-])?(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ .-])(?:[0-9]{2,7}[ .-]){0,4}[0-9]{2,7}")
_LOOSE_CARD = re.compile(r"[0-9](?:[ .-]{0,2}[0-9])+")
#: Words that tell what the number after them is.
CUES = {
    "email": frozenset({"mail", "email", "contact", "write"}),
    "ip": frozenset({"ip", "address", "host", "server"}),
    "card": frozenset({"amex", "card", "carte", "credit", "karte", "kreditkarte", "mastercard", "tarjeta", "visa"}),
    "phone": frozenset({"call", "cell", "contact", "fax", "handy", "llame", "mobile", "mobil", "móvil", "phone", "ring",
                        "tel", "telefon", "telephone", "teléfono", "téléphone", "text", "whatsapp"}),
}
_LEFT = 32  # characters before a window that its features see


def _spelled(text: str) -> Iterator[Span]:
    """Addresses that spell out their signs in brackets, ``name [at] host [dot] org``."""
    free = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _SPELLED.match(text, m.end())
        free = m.end()
        if domain and start < m.start():
            yield "email", start, domain.end()
            free = domain.end()


def pattern_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Valid matches in order of kind and place, and the places of matches that failed."""
    spans = list(_emails(text))
    failed: list[tuple[int, int]] = []
    if _DIGIT.search(text):
        for kind, pattern, valid in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
            for m in pattern.finditer(text):
                if valid(m.group()):
                    spans.append((kind, m.start(), m.end()))
                else:
                    failed.append(m.span())
    return spans, failed


# --- the field ---------------------------------------------------------------------

_WINDOW = re.compile(r"(?<![+(])[+(]*+[0-9][0-9 ().+\-]*")
_ATOM = re.compile(r"[0-9]+|[^0-9]")


class Window(NamedTuple):
    """A stretch of text cut into atoms: digit runs, single other characters, whole addresses."""

    text: str
    start: int
    cuts: tuple[int, ...]  # where atoms begin, and the end
    left: str  # the characters before
    right: str  # the one after


def windows(text: str, emails: Sequence[Span]) -> list[Window]:
    """Numbers with their separators and e-mail addresses; what overlaps is one window."""
    pieces = sorted([(m.start(), m.start() + len(m.group().rstrip(" (.+-")), False) for m in _WINDOW.finditer(text)]
                    + [(s, e, True) for _, s, e in (*emails, *_spelled(text))])
    groups: list[list[tuple[int, int, bool]]] = []
    stop = -1
    for piece in pieces:
        if piece[0] >= stop:
            groups.append([])
        groups[-1].append(piece)
        stop = max(stop, piece[1])
    out = []
    for group in groups:
        start, end = group[0][0], max(p[1] for p in group)
        solid = [(s, e) for s, e, whole in group if whole]
        cuts, at = [], start
        while at < end:
            cuts.append(at)
            inside = next((e for s, e in solid if s <= at < e), None)
            if inside:
                at = inside
            else:
                at = min([_ATOM.match(text, at, end).end(), *(s for s, _ in solid if s > at)])
        out.append(Window(text[start:end], start, (*cuts, end), text[max(0, start - _LEFT) : start], text[end : end + 1]))
    return out


def _valid(kind: str, span: str) -> bool:
    if kind == "email":
        return "@" in span and (found := next(_emails(span), None)) is not None and found[1:] == (0, len(span))
    if kind == "ip":
        return bool(_IP.fullmatch(span)) and _is_ip(span)
    if kind == "card":
        return bool(_CARD.fullmatch(span)) and _is_card(span)
    return bool(_PHONE.fullmatch(span)) and _is_phone(span)


def _possible(kind: str, span: str, before: str) -> bool:
    """Whether the shape is one that the kind can have, strictly or not; a ``+`` belongs to its phone."""
    if _valid(kind, span):
        return True
    if kind == "email":
        return span[-1].isalpha() and next(_spelled(span), None) == ("email", 0, len(span))
    if kind == "card":
        digits = _only_digits(span)
        return 13 <= len(digits) <= 19 and bool(_LOOSE_CARD.fullmatch(span)) and _luhn(digits)
    return kind == "phone" and before != "+" and bool(_LOOSE_PHONE.fullmatch(span)) and 7 <= len(_only_digits(span)) <= 12


def _has_cue(kind: str, before: str) -> bool:
    words = re.findall(r"[^\W\d_]+", before.rpartition("\n")[2].lower())
    return not CUES[kind].isdisjoint(words[-3:])


def _features(kind: str, window: Window, a: int, b: int) -> list[str]:
    """Of a whole span: whether it is valid, its shape, its size and what stands beside it."""
    span = window.text[a:b]
    runs = re.findall("[0-9]+", span)
    separators = "".join(sorted(set(re.sub("[0-9A-Za-z@]", "", span))))[:6]
    ahead = (window.left + window.text[max(0, a - _LEFT) : a])[-_LEFT:]
    before = ahead[-1:]
    after = window.text[b : b + 1] if b < len(window.text) else window.right
    side = lambda c: "9" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c
    shape = "-".join(str(min(len(r), 9)) for r in runs[:6])
    strict, cue = _valid(kind, span), _has_cue(kind, ahead)
    form = f"{kind} {'valid' if strict else 'loose'}"
    return [
        form, f"{form} cue {cue}", f"{form} shape {shape} cue {cue}", f"{form} separators {separators} cue {cue}",
        kind, f"{kind} digits {min(sum(map(len, runs)), 20)}", f"{kind} runs {min(len(runs), 8)}",
        f"{kind} separators {separators}", f"{kind} shape {shape}", f"{kind} before {side(before)}",
        f"{kind} after {side(after)}", f"{kind} balanced {span.count('(') == span.count(')')}",
    ]


def _arcs(window: Window) -> list[list[tuple[int, str | None, tuple[str, ...]]]]:
    """From each atom: where a segment may end, its kind (None: one atom of nothing), its features."""
    cuts = [c - window.start for c in window.cuts]
    arcs = []
    for i in range(len(cuts) - 1):
        own: list[tuple[int, str | None, tuple[str, ...]]] = [(i + 1, None, ())]
        first, before = window.text[cuts[i]], window.text[max(0, cuts[i] - 1) : cuts[i]]
        if first.isdigit() or first in "+(" or cuts[i + 1] - cuts[i] > 1:
            digits = 0
            for j in range(i + 1, min(len(cuts), i + 1 + _MAX_ATOMS)):
                span = window.text[cuts[i] : cuts[j]]
                last = window.text[cuts[j - 1] : cuts[j]]
                digits += len(last) if last.isdigit() else 0
                if digits > _MAX_DIGITS and j - i > 7:  # an address has seven atoms
                    break
                if not last[-1].isdigit() and len(last) == 1:
                    continue  # no kind ends with a separator
                for kind in KINDS:
                    if _possible(kind, span, before):
                        own.append((j, kind, tuple(_features(kind, window, cuts[i], cuts[j]))))
        arcs.append(own)
    return arcs


Weights = dict[str, float]


def _score(weights: Weights, features: Sequence[str]) -> float:
    return sum(weights.get(f, 0.0) for f in features)


def best_segments(window: Window, weights: Weights) -> list[Span]:
    """Viterbi over segments of at most 19 digits; of equal scores the one with fewer spans."""
    arcs = _arcs(window)
    best: list[tuple[float, int, int, str | None]] = [(0.0, 0, -1, None)]
    best += [(-math.inf, 0, -1, None)] * len(arcs)
    for i, own in enumerate(arcs):
        score, spans, _, _ = best[i]
        for j, kind, features in own:
            total = score + _score(weights, features)
            count = spans + (kind is not None)
            if (total, -count) > (best[j][0], -best[j][1]):
                best[j] = (total, count, i, kind)
    out, j = [], len(arcs)
    while j > 0:
        _, _, i, kind = best[j]
        if kind:
            out.append((kind, window.cuts[i], window.cuts[j]))
        j = i
    return out[::-1]


def _add(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x if y == -math.inf else x + math.log1p(math.exp(y - x))


def train(examples: Sequence[tuple[Window, set[Span]]], rounds: int = 12, rate: float = 0.2, decay: float = 1e-3) -> Weights:
    """Gradient ascent on the likelihood of the true segmentations, by forward and backward sums."""
    prepared = []
    for window, true in examples:
        arcs = _arcs(window)
        if any(len(own) > 1 for own in arcs):  # else there is nothing to choose
            gold = {(window.cuts.index(s), window.cuts.index(e), k) for k, s, e in true}
            prepared.append((arcs, gold))
    weights: Weights = {}
    for _ in range(rounds):
        for arcs, gold in prepared:
            n = len(arcs)
            scored = [[(j, k, f, _score(weights, f)) for j, k, f in own] for own in arcs]
            forward, backward = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
            for i in range(n):
                for j, _, _, s in scored[i]:
                    forward[j] = _add(forward[j], forward[i] + s)
            for i in reversed(range(n)):
                for j, _, _, s in scored[i]:
                    backward[i] = _add(backward[i], s + backward[j])
            change: dict[str, float] = {}
            for i in range(n):
                for j, k, f, s in scored[i]:
                    if k:
                        expected = math.exp(forward[i] + s + backward[j] - forward[n])
                        step = ((i, j, k) in gold) - expected
                        for name in f:
                            change[name] = change.get(name, 0.0) + step
            for name, step in change.items():
                old = weights.get(name, 0.0)
                weights[name] = old + rate * (step - decay * old)
    return weights


# --- over a table ------------------------------------------------------------------


def _undecided(window: Window) -> bool:
    """Whether a looser form stands behind a telling word, so that no pattern says what it is."""
    return any(
        f"{kind} loose cue True" in features or (kind == "email" and "email loose" in features)
        for own in _arcs(window) for _, kind, features in own if kind
    )


def planted(seed: int = 7, repeats: int = 20) -> list[tuple[Window, set[Span]]]:
    """Made examples of the looser forms: meant ones behind telling words, and numbers that are none.

    A phone in the form ``(ddd) ddd-dddd`` is meant anywhere, others and cards behind a word only; a
    series of like numbers holds none.
    """
    rng = random.Random(seed)

    def digits(shape: str) -> str:
        return "".join(rng.choice("123456789") if c == "9" else rng.choice("0123456789") if c == "8" else c for c in shape)

    def card(shape: str) -> str:
        return next(n for n in iter(lambda: digits(shape), None) if _luhn(_only_digits(n)))

    phones = ["(988) 988-8888", "988-988-8888", "988.988.8888", "988 988 8888", "1-988-988-8888", "1 (988) 988-8888",
              "089 8888888", "0988 888888", "08 88 88 88 88", "988-8888"]
    cards = ["9888 888888 88888", "988888888888888", "9888.8888.8888.8888", "9888888888888", "9888  8888  8888  8888"]
    dates = ["2988-08-28", "18.08.2988", "18-08-2988", "2088-08-18 18.88", "1988-1988", "98.18.8"]
    others = ["9 888 888", "988 888 888", "978-9-88-888888-8", "98 98 98 98", "9888-8888-88", "98.98", "988-888",
              "9888888888", "98888 98888", "9.8.88 98"]
    out = []

    def add(text: str, *spans: tuple[str, str]) -> None:
        true = {(kind, text.index(span), text.index(span) + len(span)) for kind, span in spans}
        for window in windows(text, []):
            out.append((window, {s for s in true if window.cuts[0] <= s[1] < window.cuts[-1]}))

    for _ in range(repeats):
        for kind, shapes in (("phone", phones), ("card", cards)):
            for shape in shapes:
                number = card(shape) if kind == "card" else digits(shape)
                cue, gap = rng.choice(sorted(CUES[kind])), rng.choice([" ", ": ", " is ", " at ", ". "])
                add(f"and {cue}{gap}{number} now", (kind, number))
                add(f"so the {digits(rng.choice(others))} and {number}, then",
                    *[(kind, number)] * (shape.endswith("(988) 988-8888")))
        for shape in dates + others:
            cue = rng.choice(sorted(CUES["phone"]))
            add(f"the part {digits(shape)} was")
            if shape in dates:
                add(f"{cue} on {digits(shape)} again")
        number = digits("988 988 8888")
        strict, whole = card("9888 8888 8888 8888"), digits(rng.choice(["+9 (988) 988-8888", "+98 988 888888", "+9-988-988-8888"]))
        add(f"phone {number} {strict} and", ("phone", number), ("card", strict))
        add(f"call {whole} {strict} and", ("phone", whole), ("card", strict))
        add(f"{rng.choice(['tel', 'fax:', 'by', 'in'])} {whole} and", ("phone", whole))
        size, sign = rng.choice(["9", "98", "988", "9888"]), rng.choice([" ", " ", " - ", "  "])
        add(f"so {sign.join(digits(size) for _ in range(rng.randint(12, 30)))} are")
        name = rng.choice(["jo", "a.lee", "max_9"]) + rng.choice([" [at] ", "(at)", " {at} "])
        name += "host" + rng.choice([".org", " [dot] com", "(dot)net"])
        add(f"to {name} by", ("email", name))
    return out


def _examples(text: str) -> list[tuple[Window, set[Span]]]:
    """Windows in which every pattern match lies, and none failed but as a single number."""
    spans, failed = pattern_spans(text)
    out = []
    for window in windows(text, [s for s in spans if s[0] == "email"])[:_MAX_WINDOWS]:
        start, end = window.cuts[0], window.cuts[-1]
        inside = {s for s in spans if s[1] < end and s[2] > start}
        clear = all(s[1] in window.cuts and s[2] in window.cuts for s in inside)
        doubt = any(s < end and e > start and " " in text[s:e].strip() for s, e in failed)
        doubt = doubt or _undecided(window)
        overlap = sorted((s, e) for _, s, e in inside)
        if clear and not doubt and all(x[1] <= y[0] for x, y in zip(overlap, overlap[1:])):
            out.append((window, inside))
    return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", max_texts: int = MAX_TEXTS) -> Weights:
    """Train on the windows of at most ``max_texts`` texts with the smallest hashes of their keys.

    At most 20 windows of a text come to the driver; the planted examples join them. Without any window, the
    field is empty and adds nothing.
    """
    chosen = bounded_sample(docs.select(F.col(key).alias("_key")), "_key", max_texts)
    sample = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    sample = sample.join(F.broadcast(chosen), "_key").filter(F.col("_text").rlike("[0-9@]"))

    def find(batches):
        for batch in batches:
            rows = [
                (k, w.text, w.start, list(w.cuts), w.left, w.right, [list(map(str, s)) for s in sorted(true)])
                for k, t in zip(batch["_key"], batch["_text"])
                for w, true in _examples(t)
            ]
            yield pd.DataFrame(rows, columns=["k", "text", "start", "cuts", "left", "right", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    found = sample.mapInPandas(
        find, f"k {kind}, text string, start int, cuts array<int>, left string, right string, spans array<array<string>>"
    )
    rows = found.orderBy("k", "start", "text").limit(_MAX_WINDOWS * max_texts).collect()
    examples = [
        (Window(r["text"], r["start"], tuple(r["cuts"]), r["left"], r["right"]),
         {(k, int(s), int(e)) for k, s, e in r["spans"]})
        for r in rows
    ]
    return train(examples + planted()) if examples else {}


def find_spans(text: str | None, weights: Weights) -> tuple[list[Span], list[Span]]:
    """Pattern matches, and spans that the field adds where no pattern match lies."""
    if not text:
        return [], []
    spans, _ = pattern_spans(text)
    added: list[Span] = []
    if weights:
        for window in windows(text, [s for s in spans if s[0] == "email"]):
            added += best_segments(window, weights)
    taken = sorted((s, e) for _, s, e in spans)
    clear = lambda x: all(e <= x[1] or s >= x[2] for s, e in taken)
    return spans, [x for x in added if clear(x)]


def _listed(spans: Sequence[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in ordered)


def personal_data(docs: DataFrame, weights: Weights, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every row.

    The counts and the checksum are of the pattern matches, ``spans`` also has what the field
    adds, as ``kind:start:end`` by kind and start, in code points, the end exclusive. NULL and empty
    texts have none. One pass over the whole texts without a shuffle; rows are independent, so
    repeated rows and any keys will do. Other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["key"], batch["text"]):
                spans, added = find_spans(t, weights)
                counts = [sum(s[0] == name for s in spans) for name in KINDS]
                digest = hashlib.sha256(_listed(spans).encode()).hexdigest()
                rows.append((k, *counts, digest, _listed(spans + added), len(added)))
            names = ["key", *(f"n_{x}" for x in KINDS), "base_sha256", "spans", "n_added"]
            frame = pd.DataFrame(rows, columns=names)
            frame["key"] = batch["key"]
            yield frame

    columns = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    counts = ", ".join(f"n_{x} long" for x in KINDS)
    out = columns.mapInPandas(scan, f"key {kind}, {counts}, base_sha256 string, spans string, n_added long")
    return out.withColumnRenamed("key", key)
