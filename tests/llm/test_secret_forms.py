import base64
import hashlib
import hmac
import json
import random
import re

import pytest
from conftest import ordered

from turnloom.llm import secret_forms as sf


def brute_base(text):
    """The contract's patterns, plainly."""
    text, out = text or "", []
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, pattern, least, group in (("assign", assign, 12, 2), ("access", "AKIA[A-Z0-9]+", 18, 0), ("hex", "[0-9a-f]+", 16, 0)):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


# --- encoders, written from the formats and sharing nothing with the operator -------------


def tlv(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([128 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + content


def integer(value):
    return tlv(2, value.to_bytes(value.bit_length() // 8 + 1, "big"))


def sequence(*items):
    return tlv(0x30, b"".join(items))


RNG = random.Random(11)
RSA_OID, EC_OID, CURVE = tlv(6, bytes.fromhex("2a864886f70d010101")), tlv(6, bytes.fromhex("2a8648ce3d0201")), tlv(6, bytes.fromhex("2a8648ce3d030107"))


def rsa(bits=1024):
    return sequence(integer(0), *[integer(RNG.getrandbits(b) | 1) for b in (bits, 17, bits, *[bits // 2] * 5)])


def sec1():
    return sequence(integer(1), tlv(4, RNG.randbytes(32)), tlv(0xA0, CURVE), tlv(0xA1, tlv(3, b"\0\4" + RNG.randbytes(64))))


def pkcs8(name, key):
    return sequence(integer(0), sequence(name, tlv(5, b"")), tlv(4, key))


def string(data):
    return len(data).to_bytes(4, "big") + data


def openssh():
    public = string(b"ssh-ed25519") + string(RNG.randbytes(32))
    check = RNG.randbytes(4)
    secret = check * 2 + public + string(RNG.randbytes(64)) + string(b"me@host")
    secret += bytes(range(1, 1 + -len(secret) % 8))
    return b"openssh-key-v1\0" + string(b"none") + string(b"none") + string(b"") + (1).to_bytes(4, "big") + string(public) + string(secret)


def url64(data):
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def jwt(name="HS256", size=32, payload={"sub": "1"}):
    head = url64(json.dumps({"alg": name, "typ": "JWT"}).encode()) + "." + url64(json.dumps(payload).encode())
    return head + "." + url64(hmac.digest(b"k", head.encode(), "sha512")[:size].ljust(size, b"\1"))


def jwe(iv=12, tag=16):
    head = url64(json.dumps({"alg": "dir", "enc": "A256GCM"}).encode())
    return ".".join([head, "", url64(RNG.randbytes(iv)), url64(RNG.randbytes(40)), url64(RNG.randbytes(tag))])


def armored(name, data, width=64, gap="\n"):
    body = base64.b64encode(data).decode()
    lines = [body[i : i + width] for i in range(0, len(body), width)]
    return gap.join([f"-----BEGIN {name}-----", *lines, f"-----END {name}-----"])


def plain(data):
    return base64.b64encode(data).decode()


ED = sequence(integer(0), sequence(tlv(6, bytes.fromhex("2b6570"))), tlv(4, tlv(4, RNG.randbytes(32))))
ENCRYPTED = sequence(sequence(tlv(6, bytes.fromhex("2a864886f70d01050d")), sequence(integer(5))), tlv(4, RNG.randbytes(64)))
STORE = sequence(integer(3), sequence(tlv(6, bytes.fromhex("2a864886f70d010701")), tlv(0xA0, tlv(4, RNG.randbytes(90)))))
DSA = sequence(integer(0), *[integer(RNG.getrandbits(b) | 1 << (b - 1)) for b in (1024, 160, 1024, 1024, 160)])

PLANTED = [
    ("rsa_key", armored("RSA PRIVATE KEY", rsa())), ("rsa_key", armored("RSA PRIVATE KEY", rsa(2048), 76, "\r\n")),
    ("rsa_key", armored("RSA PRIVATE KEY", rsa(), gap="\\n")), ("rsa_key", armored("RSA PRIVATE KEY", rsa(), 10**6, "")),
    ("rsa_key", plain(rsa())), ("rsa_key", rsa().hex()), ("rsa_key", rsa().hex().upper()), ("rsa_key", url64(rsa())),
    ("dsa_key", plain(DSA)), ("ec_key", armored("EC PRIVATE KEY", sec1())), ("ec_key", sec1().hex()),
    ("pkcs8_key", armored("PRIVATE KEY", pkcs8(RSA_OID, rsa()))), ("pkcs8_key", plain(pkcs8(EC_OID, sec1()))),
    ("pkcs8_key", armored("PRIVATE KEY", ED)), ("pkcs8_key", ED.hex()),
    ("encrypted_key", armored("ENCRYPTED PRIVATE KEY", ENCRYPTED)), ("pkcs12_store", plain(STORE)),
    ("openssh_key", armored("OPENSSH PRIVATE KEY", openssh(), 70)), ("openssh_key", plain(openssh())),
    ("openssh_key", openssh().hex()),
    *[("jwt", jwt(n, s)) for n, s in (("HS256", 32), ("HS384", 48), ("HS512", 64), ("ES256", 64), ("ES512", 132), ("EdDSA", 64), ("RS256", 256))],
    ("jwe", jwe()),
    ("rsa_key", plain(armored("RSA PRIVATE KEY", rsa()).encode())), ("jwt", plain(jwt().encode())),  # wrapped once more
    ("jwt", plain(plain(json.dumps({"t": jwt()}).encode()).encode())), ("jwt", jwt().encode().hex()),
]

CLEAN = [
    jwt("HS256", 31), jwt("none", 32), jwt("RS256", 64), jwt("ES256", 65), jwe(iv=13), jwe(tag=12),
    ".".join(jwt().split(".")[:2]), "eyJhbGciOiJIUzI1NiJ9.notjson.sig", "www.example.com.and.eyes.everywhere.too",
    plain(rsa()[:-1]), plain(rsa() + b"\0"), plain(sequence(*[integer(RNG.getrandbits(1024)) for _ in range(2)])),  # cut, longer, public
    plain(sequence(sequence(RSA_OID, tlv(5, b"")), tlv(3, b"\0" + sequence(integer(3), integer(65537))))),
    plain(sequence(sequence(integer(2), tlv(4, RNG.randbytes(90))), sequence(RSA_OID), tlv(3, RNG.randbytes(65)))),
    plain(pkcs8(RSA_OID, RNG.randbytes(90))), plain(openssh()[:-8]), plain(b"openssh-key-v1\0" + RNG.randbytes(90)),
    plain(RNG.randbytes(300)), RNG.randbytes(300).hex(), plain(b"only some text that says nothing of note " * 9),
    "M" * 5000, "30" * 5000, "MII" + "A" * 400, "eyJ" * 2000, "-eyJ" * 2000, "a/b/c" * 900, "=" * 400, "A" * 100_000,
]


@pytest.mark.parametrize("n", range(len(PLANTED)))
def test_planted(n):
    kind, secret = PLANTED[n]
    for before, after in (("", ""), ("Here: ", " and on"), ('key = "', '", next'), ("é😀 text\n", "\nThen prose follows here."), ("(", ").")):
        text = before + secret + after
        assert list(sf.confirmed(text)) == [(kind, len(before), len(before) + len(secret))]


@pytest.mark.parametrize("n", range(len(CLEAN)))
def test_clean(n):
    assert list(sf.confirmed(f"some words {CLEAN[n]} and more\nlines of prose")) == []


def test_all_in_one_text():
    text, at, expected = "", 0, []
    for kind, secret in PLANTED:
        text += "\nwords of a text\n"
        expected.append((kind, len(text), len(text) + len(secret)))
        text += secret
    assert list(sf.confirmed(text)) == expected


def test_wrapped_text_is_decoded_once(monkeypatch):
    """A long encoded attachment is read from its first line, not again from every line."""
    calls = []
    real = sf.confirmed
    monkeypatch.setattr(sf, "confirmed", lambda t: calls.append(1) or real(t))
    body = plain(b"line of a plain attachment\n" * 2000)
    list(real("\n".join(body[i : i + 76] for i in range(0, len(body), 76))))
    assert len(calls) <= 3


def test_patterns_against_brute_force():
    rng = random.Random(4)
    parts = ["password", "PassWd", "api_key", "APIKEY", "ſecret", "toKen", "\"", "'", " ", "  ", "=", ":", "AKIA", "AKIAAKIA", "0123456789ab",
             "abcdef", "DEADBEEF0123", "é", "\n", ".", "-", "ghij", "0" * 16, "x" * 12]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert sorted(sf.pattern_spans(text), key=lambda s: (s[1], sf.KINDS.index(s[0]))) == brute_base(text)


def expected(rows):
    out = []
    for key, text in rows:
        base = brute_base(text)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        added = list(sf.confirmed(text or ""))
        both = sorted(base + added, key=lambda s: (s[1], sf.KINDS.index(s[0])))
        out.append((key, *[sum(s[0] == k for s in base) for k in ("assign", "access", "hex")],
                    hashlib.sha256(listed.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in both), len(added)))
    return out


def test_query(spark, documents, doc_rows, no_documents):
    got = sf.secrets(documents)
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"]
    assert ordered(got.collect()) == ordered(expected(doc_rows))
    assert sf.secrets(no_documents).count() == 0


def test_planted_in_a_table(spark):
    rows = [(i, f"note {i}\n{secret}\nend") for i, (_, secret) in enumerate(PLANTED)] + [(None, None), (5, "")]
    rows += [(100 + i, f"note\n{text}\nend") for i, text in enumerate(CLEAN)]
    got = {(r["doc_id"], r["spans"]): r["n_confirmed"] for r in sf.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (key, spans), n in got.items():
        assert n == (key is not None and key < 100 and spans != ""), (key, spans)
    named = {key: spans for key, spans in got if key is not None and key < 100 and spans}
    assert all(PLANTED[k][0] in s for k, s in named.items()) and len(named) == len(PLANTED)
