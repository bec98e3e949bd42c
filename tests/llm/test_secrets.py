"""Private keys by their structure, and the base spans against a plain version."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pytest

from scorewright.llm import secret_scan


def tlv(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda x: bytes([0x80 | len(x)]) + x)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def num(n, size=1):
    return tlv(2, n.to_bytes(size, "big"))


RNG = np.random.default_rng(3)
BIG = [num(int.from_bytes(RNG.bytes(60), "big") >> 3, 60) for _ in range(9)]
OID = tlv(6, bytes([0x2A, 0x86, 0x48, 0x86, 0xF7, 13, 1, 1, 1]))
ALGORITHM = tlv(0x30, OID, tlv(5))
RSA = tlv(0x30, num(0), *BIG[:8])
SSH_PUBLIC = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(range(32))))


def text_field(x):
    return len(x).to_bytes(4, "big") + x


def ssh(cipher=b"none", kdf=b"none", options=b"", check=(b"abcd", b"abcd"), kind=b"ssh-ed25519", tail=b""):
    secret = check[0] + check[1] + text_field(kind) + bytes(range(65))
    secret += bytes(range(1, 1 + -len(secret) % 8))
    fields = [text_field(cipher), text_field(kdf), text_field(options), (1).to_bytes(4, "big"), text_field(SSH_PUBLIC), text_field(secret)]
    return b"openssh-key-v1\0" + b"".join(fields) + tail


PRIVATE = {
    "rsa": RSA,
    "rsa of three primes": tlv(0x30, num(1), *BIG[:8], tlv(0x30, tlv(0x30, *BIG[:3]))),
    "dsa": tlv(0x30, num(0), *BIG[:5]),
    "curve": tlv(0x30, num(1), tlv(4, bytes(32)), tlv(0xA0, OID), tlv(0xA1, tlv(3, bytes(66)))),
    "pkcs8": tlv(0x30, num(0), ALGORITHM, tlv(4, RSA)),
    "pkcs8 with attributes": tlv(0x30, num(1), ALGORITHM, tlv(4, RSA), tlv(0xA0, tlv(0x30, OID)), tlv(0x81, bytes(33))),
    "encrypted": tlv(0x30, tlv(0x30, OID, tlv(0x30, tlv(4, bytes(8)), num(2048, 2))), tlv(4, bytes(640))),
    "openssh": ssh(),
    "openssh encrypted": ssh(b"aes256-ctr", b"bcrypt", bytes(24), (b"abcd", b"wxyz")),
}
NO_SECRET = {
    "public": tlv(0x30, ALGORITHM, tlv(3, b"\0" + tlv(0x30, *BIG[:2]))),
    "rsa public": tlv(0x30, *BIG[:2]),
    "certificate": tlv(0x30, tlv(0x30, tlv(0xA0, num(2)), num(7), ALGORITHM, tlv(0x30), tlv(0x30), tlv(0x30)), ALGORITHM, tlv(3, bytes(65))),
    "signature": tlv(0x30, BIG[0], BIG[1]),
    "version 9": tlv(0x30, num(9), *BIG[:8]),
    "seven numbers": tlv(0x30, num(0), *BIG[:7]),
    "public ssh": SSH_PUBLIC,
    "magic and junk": b"openssh-key-v1\0" + bytes(range(200)),
    "unequal checks": ssh(check=(b"abcd", b"abce")),
    "cipher without derivation": ssh(b"aes256-ctr"),
    "another kind inside": ssh(kind=b"ssh-rsa-----"),
}


def found(text):
    return [(kind, text[a:b]) for kind, a, b in secret_scan.scan_text(text) if kind not in secret_scan.BASE]


@pytest.mark.parametrize("name", PRIVATE)
def test_private_keys_in_all_spellings(name):
    data = PRIVATE[name]
    kind = "openssh" if name.startswith("openssh") else "der"
    coded = base64.b64encode(data).decode()
    assert found(f"key: {coded} end") == [(kind, coded)] and found(f"{coded}\nNext") [0][0] == kind
    for width in (64, 76):
        cut = [coded[k : k + width] for k in range(0, len(coded), width)]
        for gap in ("\n", "\r\n", "\n  "):
            assert found("Here\n" + gap.join(cut) + "\n\nand on") == [(kind, gap.join(cut))]
        assert found("{\"k\": \"" + "\\n".join(cut) + "\"}") == [(kind, "\\n".join(cut))]
    url = base64.urlsafe_b64encode(data).decode().rstrip("=")
    assert found(f"k {url} x") == [(kind, url)]
    pem = f"-----BEGIN PRIVATE KEY-----\n{coded}\n-----END PRIVATE KEY-----"
    assert ("pem", pem) in found(pem)
    if kind == "der":
        assert ("der", data.hex().upper()) in found(f"0 {data.hex().upper()} 1")
    assert found(f"key {coded[:-8]} end") == []


@pytest.mark.parametrize("name", NO_SECRET)
def test_what_is_no_private_key(name):
    coded = base64.b64encode(NO_SECRET[name]).decode()
    lines = "\n".join(coded[k : k + 64] for k in range(0, len(coded), 64))
    assert found(f"key {coded} end") == [] and found(lines) == []
    assert found(f"-----BEGIN PUBLIC KEY-----\n{lines}\n-----END PUBLIC KEY-----") == []
    assert found(base64.urlsafe_b64encode(NO_SECRET[name]).decode()) == []


def plain_base(text):
    """The base spans position by position, without the conditions that skip a kind."""
    text, spans = text or "", []

    def runs(pattern, least, group=0):
        at = 0
        while at <= len(text):
            m = re.compile(pattern).match(text, at)
            if m and m.end() > at:
                if len(m[group]) >= least:
                    yield m.span()
                at = m.end()
            else:
                at += 1

    fold = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    names = "|".join(map(fold, ("password", "passwd", "secret", "token"))) + "|" + fold("api") + "_?" + fold("key")
    spans += [("assign", *s) for s in runs(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2)]
    spans += [("access", *s) for s in runs(r"AKIA[A-Z0-9]+", 16)] + [("hex", *s) for s in runs(r"[0-9a-f]+", 32)]
    order = ("assign", "access", "hex")
    return sorted(spans, key=lambda s: (s[1], order.index(s[0])))


def test_base_spans_against_a_plain_version(spark):
    bits = ["password", "PassWd", "ſecret", "secret", "TOKEN", "api_key", "APIKEY", "=", ": ", " = '", '":"', "abcdefgh", "short", "AKIA", "AKIAABCDEFGHIJKL",
            "0123456789abcdef", "deadBEEF" * 4, "deadbeef" * 5, " ", "\n", "é", "日", "İ", ".", "-", "AKIAAKIAAKIA12345"]
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 14)))) for _ in range(1500)] + [None, "", "x" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in secret_scan.scan(docs.repartition(4)).collect()}
    seen = 0
    for i, text in enumerate(texts):
        spans = plain_base(text)
        seen += len(spans)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert rows[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [rows[i][f"n_{kind}"] for kind in ("assign", "access", "hex")] == [sum(k == kind for k, _, _ in spans) for kind in ("assign", "access", "hex")]
    assert seen > 500


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, spans int, n_hex string")
    assert secret_scan.scan(docs).collect() == []
