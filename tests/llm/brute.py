"""The contracts of the corpus operators, word for word and without Spark."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def statistics(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {x for x in windows if windows.count(x) > 1} if len(windows) < 400 else _repeated(windows)
    covered = {i + k for i, x in enumerate(windows) if x in again for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
    }


def _repeated(windows):
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    return {x for x, n in count.items() if n > 1}


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, radius=3):
    """``rows``: (doc_id, text); the component of each row by pairwise comparison."""
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [(key, f"{prints[i]:016x}", least.get(root(i))) for i, (key, _) in enumerate(rows)]


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        luhn = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and luhn % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(text):
    return zlib.crc32((text or "").encode())


def dedup(rows, min_docs=3, min_chars=20):
    """``rows``: (doc_id, text); per row (doc_id, n_lines, n_dropped, kept)."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            known = holders[key(line)] - {None}
            shared = len(key(line)) >= min_chars and len(known) >= min_docs
            if not shared or doc == max(known):
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def viterbi(text, pieces, unknown):
    """The best score of a marked text; ``pieces``: text to score."""
    best = [0.0] + [float("-inf")] * len(text)
    longest = max(map(len, pieces), default=1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            score = pieces.get(text[start:end])
            if score is not None:
                best[end] = max(best[end], best[start] + score)
        if text[end - 1] not in pieces:
            best[end] = max(best[end], best[end - 1] + unknown)
    return best[-1]


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


#: Texts that the operators must stand: NULL, empty, spaces only, ties, copies, long ones.
ODD_TEXTS = [
    None, "", " ", "\n", "\n\n", "a", "a b", "A b C", "the same line of some length\nshort",
    "THE same line of some length  \nother", "\tthe same line of some length", "the same line of some length",
    "x " * 5000, "word " * 40 + "\n" + "word " * 40, "é" * 30 + "\n" + "É" * 30, "no-break space and ▁ mark",
    "emoji 😀 here 😀 here 😀", "1" * 3000, "a" * 20000, "line\n" * 3000, "\x00 zero", "tab\tand\x0bvertical\x0cfeed\rend",
    "one two three one two three", "one two three one two three", "mail a@b.c and +1 234 567 89 01",
]
