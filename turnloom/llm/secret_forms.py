"""Secrets: exact patterns, and encoded keys and tokens that are reported once their structure is confirmed.

Runs of base64 or hex characters are candidates. Their first bytes say what they claim to be; the
claim is then checked to its last byte: the nested lengths of a DER or OpenSSH key must fill it
exactly and its fields be those of a private key, a token's header must name a known algorithm and
its signature have that algorithm's length. What decodes to text is searched in the same way.
"""

from __future__ import annotations

import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import by_value

by_value(__name__)

PATTERNS = ("assign", "access", "hex")
CONFIRMED = (
    "rsa_key", "dsa_key", "ec_key", "pkcs8_key", "encrypted_key", "pkcs12_store", "openssh_key", "jwt", "jwe",
)
KINDS = PATTERNS + CONFIRMED

Span = tuple[str, int, int]

# --- exact patterns ----------------------------------------------------------------

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")


def pattern_spans(text: str) -> list[Span]:
    """The valid matches. A shorter run of one class cannot hold a longer one, so the least
    length of the last two is part of their pattern."""
    spans = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return spans + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


# --- nested lengths ----------------------------------------------------------------

# Object identifiers in their DER form.
_RSA = bytes.fromhex("2a864886f70d010101")
_EC = bytes.fromhex("2a8648ce3d0201")
_EDWARDS = tuple(bytes.fromhex(x) for x in ("2b656e", "2b656f", "2b6570", "2b6571"))
_PASSWORD_BASED = tuple(bytes.fromhex(x) for x in ("2a864886f70d0105", "2a864886f70d010c01"))
_PKCS7 = bytes.fromhex("2a864886f70d0107")

_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30

Item = tuple[int, bytes]


def der_size(data: bytes) -> tuple[int, int] | None:
    """The bytes of the header and of the whole item that starts ``data``; minimal definite lengths only."""
    if len(data) < 2:
        return None
    first = data[1]
    if first < 0x80:
        return 2, 2 + first
    n = first & 0x7F
    if not 1 <= n <= 4 or len(data) < 2 + n:
        return None
    length = int.from_bytes(data[2 : 2 + n], "big")
    if length < 0x80 or data[2] == 0:
        return None
    return 2 + n, 2 + n + length


def der_items(data: bytes) -> list[Item] | None:
    """The items that fill ``data`` without a rest, or None."""
    items, at = [], 0
    while at < len(data):
        size = der_size(data[at : at + 6])
        if size is None or at + size[1] > len(data):
            return None
        items.append((data[at], data[at + size[0] : at + size[1]]))
        at += size[1]
    return items


def _inside(data: bytes, tag: int = _SEQUENCE) -> list[Item] | None:
    """The items of the one item that ``data`` is."""
    items = der_items(data)
    return der_items(items[0][1]) if items is not None and len(items) == 1 and items[0][0] == tag else None


def _algorithm(item: Item) -> bytes | None:
    parts = der_items(item[1]) if item[0] == _SEQUENCE else None
    return parts[0][1] if parts and parts[0][0] == _OID and parts[0][1] else None


def _is_pkcs1(items: list[Item]) -> bool:
    return [t for t, _ in items] == [_INTEGER] * 9 and items[0][1] in (b"\0", b"\1") and len(items[1][1]) >= 64


def _is_sec1(items: list[Item]) -> bool:
    tags = [t for t, _ in items]
    if tags[:2] != [_INTEGER, _OCTETS] or items[0][1] != b"\1" or not 16 <= len(items[1][1]) <= 72:
        return False
    if tags[2:] not in ([], [0xA0], [0xA1], [0xA0, 0xA1]):
        return False
    want = {0xA0: (_OID, _SEQUENCE), 0xA1: (_BITS,)}
    inner = [(t, der_items(x)) for t, x in items[2:]]
    return all(x is not None and len(x) == 1 and x[0][0] in want[t] for t, x in inner)


def _is_pkcs8(items: list[Item]) -> bool:
    if [t for t, _ in items[:3]] != [_INTEGER, _SEQUENCE, _OCTETS] or items[0][1] not in (b"\0", b"\1"):
        return False
    name, key = _algorithm(items[1]), items[2][1]
    if name is None or any(t not in (0xA0, 0x81, 0xA1) for t, _ in items[3:]):
        return False
    if name in _EDWARDS:
        inner = der_items(key)
        return inner is not None and len(inner) == 1 and inner[0][0] == _OCTETS and len(inner[0][1]) >= 32
    if name in (_RSA, _EC):
        inner = _inside(key)
        return inner is not None and (_is_pkcs1 if name == _RSA else _is_sec1)(inner)
    inner = der_items(key)  # the key of another algorithm is DER, too
    return inner is not None and sum(len(x) for _, x in inner) >= 16


def key_kind(data: bytes) -> str | None:
    """What private key a whole DER item is, or None; certificates and public keys are None."""
    items = _inside(data)
    if not items:
        return None
    tags = [t for t, _ in items]
    if _is_pkcs1(items):
        return "rsa_key"
    if tags == [_INTEGER] * 6 and items[0][1] == b"\0" and len(items[1][1]) >= 64:
        return "dsa_key"
    if _is_sec1(items):
        return "ec_key"
    if _is_pkcs8(items):
        return "pkcs8_key"
    if tags == [_SEQUENCE, _OCTETS] and (_algorithm(items[0]) or b"").startswith(_PASSWORD_BASED):
        return "encrypted_key" if len(items[1][1]) >= 16 else None
    if tags[:2] == [_INTEGER, _SEQUENCE] and tags[2:] in ([], [_SEQUENCE]) and items[0][1] == b"\3":
        return "pkcs12_store" if (_algorithm(items[1]) or b"").startswith(_PKCS7) else None
    return None


_OPENSSH = b"openssh-key-v1\0"


def openssh_size(data: bytes) -> int | None:
    """The bytes of the OpenSSH private key that starts ``data``, by its nested lengths."""
    at = len(_OPENSSH)
    if not data.startswith(_OPENSSH):
        return None

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    cipher, kdf, options = field(), field(), field()
    if not cipher or not kdf or options is None:
        return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= len(data):
        return None
    for _ in range(keys):
        if not field():
            return None
    secret = field()
    if not secret or len(secret) % 8 or (cipher == b"none" and secret[:4] != secret[4:8]):
        return None
    return at


# --- signed tokens -----------------------------------------------------------------

# Signature lengths by algorithm, and the lengths of vector and tag by encryption.
_SIGNATURES = {
    "HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,),
    "ES512": (132,), "EdDSA": (64, 114),
}
_MODULUS = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")  # as long as the key: 1024 bits and more
_ENCRYPTIONS = {
    "A128GCM": (12, 16), "A192GCM": (12, 16), "A256GCM": (12, 16),
    "A128CBC-HS256": (16, 16), "A192CBC-HS384": (16, 24), "A256CBC-HS512": (16, 32),
}

_TOKEN = re.compile(r"(?<![A-Za-z0-9])e[wy][A-Za-z0-9_-]{14}")
_SEGMENT = re.compile(r"[A-Za-z0-9_-]*+")
_OBJECT = re.compile(rb'\{[ \t\r\n]*"')


def _unbase64(text: str) -> bytes | None:
    """The bytes of base64 characters of either alphabet, without padding."""
    if len(text) % 4 == 1:
        return None
    return binascii.a2b_base64(text.replace("-", "+").replace("_", "/") + "=" * (-len(text) % 4))


def _json_object(segment: str) -> dict | None:
    data = _unbase64(segment)
    if not data or not _OBJECT.match(data):
        return None
    try:
        value = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def token_at(text: str, start: int) -> Span | None:
    """The signed or encrypted token whose header starts here, if its parts bear it out."""
    if not _OBJECT.match(_unbase64(text[start : start + 16]) or b""):
        return None
    segments, ends, at = [], [], start
    while len(segments) < 5:
        stop = _SEGMENT.match(text, at).end()
        segments.append(text[at:stop])
        ends.append(stop)
        if text[stop : stop + 1] != ".":
            break
        at = stop + 1
    if len(segments) < 3:
        return None
    header = _json_object(segments[0])
    name = header.get("alg") if header else None
    if not isinstance(name, str):
        return None
    if "enc" in header:
        sizes = _ENCRYPTIONS.get(header["enc"]) if isinstance(header["enc"], str) else None
        parts = [_unbase64(s) for s in segments[1:]]
        fits = sizes and len(parts) == 4 and None not in parts and (len(parts[1]), len(parts[3])) == sizes
        return ("jwe", start, ends[4]) if fits else None
    signature = _unbase64(segments[2])
    if signature is None or _json_object(segments[1]) is None:
        return None
    known = len(signature) in _SIGNATURES.get(name, ()) or (name in _MODULUS and len(signature) >= 128)
    return ("jwt", start, ends[2]) if known else None


# --- candidates in a text ----------------------------------------------------------

_START = re.compile(r"(?<![A-Za-z0-9+/])(?:(?<=\\)n)?(?=([A-Za-z0-9+/]{16}|[A-Za-z0-9_-]{16}))")
_ALPHABETS = (re.compile(r"[A-Za-z0-9+/]*+"), re.compile(r"[A-Za-z0-9_-]*+"))
_DIGITS = re.compile(r"[0-9A-Fa-f]*+")
_BREAK = re.compile(r"(?:\r?\n|\\r\\n|\\n)[\x20\t]*")  # also as written inside quotes
_PADDING = re.compile("={0,2}")
_PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]+")
_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]{1,40}-----(?:\s|\\r|\\n)*")
_END = re.compile(r"(?:\s|\\r|\\n)*-----END [A-Z0-9 ]{1,40}-----")
_HEAD = 16  # characters that tell what a run claims to be
_ARMOR = 80  # what stands before a key on its first line


def _exactly(text: str, start: int, need: int, alphabet: re.Pattern) -> tuple[str, int] | None:
    """``need`` characters from ``start``, over line breaks, if a run ends with them; and their end."""
    parts, at = [], start
    while len(text) - at >= need:
        stop = alphabet.match(text, at).end()
        if stop - at >= need:
            end = at + need
            if stop > end and not text.startswith("-----", end):
                return None
            return "".join([*parts, text[at:end]]), _PADDING.match(text, end).end()
        parts.append(text[at:stop])
        need -= stop - at
        gap = _BREAK.match(text, stop)
        if stop == at or gap is None:
            return None
        at = gap.end()
    return None


def _wrapped(text: str, start: int, alphabet: re.Pattern) -> Iterator[tuple[str, int]]:
    """The run at ``start``, and it with the lines below that continue it, all but the last as wide."""
    at, stop = start, alphabet.match(text, start).end()
    width, lines, ends = stop - start, [text[start:stop]], [stop]
    while stop - at == width and (gap := _BREAK.match(text, stop)):
        at, stop = gap.end(), alphabet.match(text, gap.end()).end()
        if not 0 < stop - at <= width:
            break
        lines.append(text[at:stop])
        ends.append(stop)
    for n in sorted({1, max(1, len(lines) - 1), len(lines)}):
        yield "".join(lines[:n]), ends[n - 1]


def _unhex(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 else None


class Encoding(NamedTuple):
    alphabet: re.Pattern
    decode: Callable[[str], bytes | None]
    length: Callable[[int], int]  # characters of so many bytes


_HEXADECIMAL = Encoding(_DIGITS, _unhex, lambda size: 2 * size)
_BASE64 = tuple(Encoding(a, _unbase64, lambda size: (4 * size + 2) // 3) for a in _ALPHABETS)


def _key_at(text: str, start: int, head: bytes, how: Encoding) -> Span | None:
    """The key that a run claims to be by its first bytes, if all of it bears that out."""
    if head[:1] == b"\x30":
        size = der_size(head)
        found = size and size[1] >= 32 and _exactly(text, start, how.length(size[1]), how.alphabet)
        kind = key_kind(how.decode(found[0])) if found else None
        return (kind, start, found[1]) if kind else None
    if head and _OPENSSH.startswith(head):
        for run, _ in _wrapped(text, start, how.alphabet):
            size = openssh_size(how.decode(run) or b"")
            found = size and _exactly(text, start, how.length(size), how.alphabet)
            if found:
                return "openssh_key", start, found[1]
    return None


def _text_at(text: str, start: int, how: Encoding) -> tuple[Span | None, int]:
    """What a run that decodes to text holds, and the end of what was looked at."""
    end = start
    for run, end in _wrapped(text, start, how.alphabet):
        data = how.decode(run)
        inner = next(confirmed(data.decode("latin-1")), None) if data else None
        if inner:
            return (inner[0], start, _PADDING.match(text, end).end()), end
    return None, end


def _armored(text: str, span: Span) -> Span:
    """With the lines that announce and end a key."""
    kind, start, end = span
    before = text.rfind("-----BEGIN ", max(0, start - _ARMOR), start)
    if before >= 0 and _BEGIN.fullmatch(text, before, start):
        after = _END.match(text, end)
        return kind, before, after.end() if after else end
    return span


def confirmed(text: str) -> Iterator[Span]:
    """Encoded keys and tokens from left to right, none inside another.

    What is nested in an encoding is reported as the whole run that encodes it; every decoding
    is shorter than its run, so this ends. The lines of a wrapped text are decoded once, from the
    first one.
    """
    starts = [(m.start(), 0) for m in _TOKEN.finditer(text)] + [(m.end(), 1) for m in _START.finditer(text)]
    free = read = 0
    for start, encoded in sorted(starts):
        if start < free:
            continue
        found = None if encoded else token_at(text, start)
        for how in (_HEXADECIMAL, *_BASE64) if encoded else ():
            if how.alphabet.match(text, start, start + _HEAD).end() < start + _HEAD:
                continue
            head = how.decode(text[start : start + _HEAD])
            if _PRINTABLE.fullmatch(head) and not _OPENSSH.startswith(head):
                if start >= read:
                    found, read = _text_at(text, start, how)
            elif key := _key_at(text, start, head, how):
                found = _armored(text, key)
            if found:
                break
        if found:
            yield found
            free = found[2]


def find_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Pattern matches, and confirmed keys and tokens; these may lie across each other."""
    return (pattern_spans(text), list(confirmed(text))) if text else ([], [])


# --- over a table ------------------------------------------------------------------


def _listed(spans: Sequence[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in ordered)


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed`` of every row.

    The counts and the checksum are of the pattern matches, ``spans`` also has what the structure
    confirms, as ``kind:start:end`` by start and kind, in code points, the end exclusive. NULL and
    empty texts have none. One pass over the whole texts without a shuffle; rows are
    independent, so repeated rows and any keys, NULL too, will do. An empty table gives
    an empty one. Other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                spans, added = find_spans(t)
                counts = [sum(s[0] == name for s in spans) for name in PATTERNS]
                digest = hashlib.sha256(_listed(spans).encode()).hexdigest()
                rows.append((*counts, digest, _listed(spans + added), len(added)))
            names = [*(f"n_{x}" for x in PATTERNS), "base_sha256", "spans", "n_confirmed"]
            frame = pd.DataFrame(rows, columns=names)
            frame.insert(0, "key", batch["key"])
            yield frame

    columns = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    counts = ", ".join(f"n_{x} long" for x in PATTERNS)
    out = columns.mapInPandas(scan, f"key {kind}, {counts}, base_sha256 string, spans string, n_confirmed long")
    return out.withColumnRenamed("key", key)
