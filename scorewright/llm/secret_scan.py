"""Secrets in texts, the decodable ones confirmed by their structure.

Base spans come from patterns alone: ``assign`` (a value given to a password-like name), ``access``
(access key ids) and ``hex`` (long hexadecimal runs). Further spans are reported only when what they
decode to has the structure they claim:

* ``jwt``: three base64url parts, the first a JSON object with an ``alg`` text, the second a JSON object,
* ``pem``: a key block between BEGIN and END lines whose base64 body is a private key as below; line ends and signs
  may be escaped as in JSON texts,
* ``der``: base64 or base64url (40 characters or more, also cut into lines) or hexadecimal (80 or more, in any case) that
  decodes to a private key: one of the sequences of ``private_der``, all nested lengths filling their frames exactly,
* ``openssh``: base64, also cut into lines, of an OpenSSH private key, whose fields are read to the end.

Certificates and public keys have other structures and are no secrets; they are not reported.

Rows: one output row per input row; a null text has no spans. Patterns are tried on the whole text;
spans of one kind do not overlap, those of different kinds may. Positions are code points, end
exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import map_arrow

Span = tuple[str, int, int]

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "openssh")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of the class are found whole, so the length can stand in the pattern.
HEX = re.compile(r"[0-9a-f]{32,}")
#: What is tried as hexadecimal data, apart from the base kind.
HEX_DATA = re.compile(r"[0-9A-Fa-f]{80,}")
JWT = re.compile(r"(?<![\w.-])([A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*)", re.A)
ESCAPED = re.compile(r"\\+(?:u00([0-9A-Fa-f]{2})|([nrt/]))")
PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]*KEY)-----(?=[\s\\])((?:[A-Za-z0-9+/=\s]++|\\++(?:u00[0-9A-Fa-f]{2}|[nrt/]))++)-----END \1-----"
)
CODED = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
NAMED = ("password", "passwd", "secret", "token", "api")


MAGIC = b"openssh-key-v1\0"
#: The same in base64, less the last character, which depends on what follows.
MAGIC_CODED = "b3BlbnNzaC1rZXktdjEA"
#: Where base64 goes on: the rest of a line, or a line end between two lines.
LINE = re.compile(r"[A-Za-z0-9+/]+")
LINE_END = re.compile(r"[ \t]*(?:\r?\n|\\+r\\+n|\\+n)[ \t]*(?=[A-Za-z0-9+/=])")
CODED_URL = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9_-]{40,}(?![A-Za-z0-9+/_-])={0,2}")


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """Start and end of the value whose length field is at ``at``, in shortest form."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return at + 1, at + 1 + first
    n = first & 0x7F
    field = data[at + 1 : at + 1 + n]
    if not 1 <= n <= 4 or len(field) < n or field[0] == 0 or (n == 1 and field[0] < 0x80):
        return None
    start = at + 1 + n
    return start, start + int.from_bytes(field, "big")


def nested(data: bytes, at: int, end: int, depth: int = 0) -> bool:
    """Do tagged values fill ``data[at:end]`` exactly, constructed ones likewise inside?"""
    while at < end:
        found = der_length(data, at + 1)
        if found is None or found[1] > end or depth > 16:
            return False
        if data[at] & 0x20 and not nested(data, *found, depth + 1):
            return False
        at = found[1]
    return at == end


def children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    """Tag, start and end of each value in ``data[at:end]``, which is known to be nested well."""
    found = []
    while at < end:
        start, stop = der_length(data, at + 1)
        found.append((data[at], start, stop))
        at = stop
    return found


def private_der(data: bytes) -> bool:
    """A DER sequence over all of ``data`` with the fields of a private key, encrypted or not.

    In tags: 2 is an integer, 4 an octet string, 6 an object identifier, 0x30 a sequence. A key begins with
    version 0 or 1 (3 at most, later ones do not exist), then come

    * integers alone: five numbers (DSA), or eight and possibly a sequence of more primes (RSA),
    * a sequence that begins with an identifier, an octet string, attributes (PKCS 8),
    * an octet string, curve and public key (elliptic curves).

    An encrypted key is a sequence that begins with an identifier, and an octet string.
    """
    if len(data) < 24 or data[0] != 0x30:
        return False
    found = der_length(data, 1)
    if found is None or found[1] != len(data) or not nested(data, *found):
        return False
    fields = children(data, *found)
    tags = [tag for tag, _, _ in fields]

    def named(place: int) -> bool:
        return tags[place] == 0x30 and [tag for tag, _, _ in children(data, *fields[place][1:])][:1] == [0x06]

    if tags == [0x30, 0x04]:
        return named(0) and fields[1][2] > fields[1][1]
    if len(tags) < 3 or tags[0] != 0x02 or data[fields[0][1] : fields[0][2]] not in (b"\0", b"\1", b"\2", b"\3"):
        return False
    rest = tags[1:]
    if rest[0] == 0x30:
        return named(1) and rest[1] == 0x04 and set(rest[2:]) <= {0xA0, 0xA1, 0x81}
    if rest[0] == 0x04:
        return set(rest[1:]) <= {0xA0, 0xA1}
    return rest == [0x02] * 5 or rest[:8] == [0x02] * 8 and rest[8:] in ([], [0x30])


def private_ssh(data: bytes) -> int | None:
    """Length of the OpenSSH private key at the start of ``data``, read field by field; None if there is none."""
    if not data.startswith(MAGIC):
        return None
    at = len(MAGIC)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    cipher, derivation, options = field(), field(), field()
    if not cipher or not derivation or options is None or not (cipher + derivation).isascii():
        return None
    plain = cipher == b"none"
    if plain != (derivation == b"none") or plain == bool(options):
        return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16:
        return None
    public = [field() for _ in range(keys)]
    secret = field()
    if secret is None or len(secret) % 8 or not all(public):
        return None
    if plain and (len(secret) < 16 or secret[:4] != secret[4:8] or not public[0].startswith(secret[8 : 12 + int.from_bytes(secret[8:12], "big")])):
        return None  # two equal check numbers, then the key's kind, as in its public part
    return at


def private_key(data: bytes) -> str | None:
    """What kind of private key fills ``data``."""
    if private_der(data):
        return "der"
    return "openssh" if private_ssh(data) == len(data) else None


def decoded(text: str, alphabet: bytes | None = None) -> bytes | None:
    """Base64 with or without its padding."""
    try:
        return base64.b64decode(text.rstrip("=") + "=" * (-len(text.rstrip("=")) % 4), altchars=alphabet, validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    raw = decoded(part, b"-_")
    try:
        found = json.loads(raw.decode()) if raw is not None else None
    except (UnicodeDecodeError, ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _signed(match: re.Match) -> bool:
    header = _object(match[1])
    return header is not None and isinstance(header.get("alg"), str) and _object(match[2]) is not None


def base_spans(text: str, lowered: str) -> list[Span]:
    """Spans of the three pattern kinds."""
    spans: list[Span] = []
    if any(name in lowered for name in NAMED):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return spans


def _unescaped(match: re.Match) -> str:
    return chr(int(match[1], 16)) if match[1] else "/" if match[2] == "/" else " "


def _starts(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of runs of base64, less the letter of an escaped line end before them."""
    for m in CODED.finditer(text):
        start, end = m.span()
        yield start, end
        if start and text[start - 1] == "\\" and text[start] in "nrt":
            yield start + 1, end


def _lines(text: str, start: int) -> Iterator[tuple[str, int]]:
    """Base64 from ``start`` on, line by line, each with the place behind it."""
    while found := LINE.match(text, start):
        yield found[0], found.end()
        end = LINE_END.match(text, found.end())
        if end is None:
            return
        start = end.end()


def _wrapped(text: str, start: int) -> tuple[str, int] | None:
    """Kind and end of the private key whose base64 begins at ``start`` and may go on over line ends.

    How long it is follows from the key itself: from the first length of a DER sequence, or from all
    fields of an OpenSSH key. It has to end where a run of base64 ends.
    """
    lines = _lines(text, start)
    coded, places = "", []
    size = None
    is_ssh = text.startswith(MAGIC_CODED, start)
    for line, end in lines:
        places.append((len(coded), end - len(line), end))
        coded += line
        if not is_ssh and size is None:
            head = decoded(coded[:12])
            found = der_length(head, 1) if head and head[0] == 0x30 else None
            if found is None:
                return None
            size = found[1]
        if size is not None and 4 * size <= 3 * len(coded):
            break
    if is_ssh:
        whole = decoded(coded[: len(coded) // 4 * 4]) or b""
        whole += decoded(coded[len(coded) // 4 * 4 :]) or b""
        size = private_ssh(whole)
    if size is None:
        return None
    needed = -(-4 * size // 3)
    if needed > len(coded):
        return None
    body = decoded(coded[:needed])
    kind = private_key(body) if body is not None and len(body) == size else None
    if kind is None:
        return None
    at, first, last = next(place for place in reversed(places) if place[0] < needed)
    end = first + needed - at
    if end != last:
        return None
    padding = -needed % 4
    return kind, end + (padding if text[end : end + padding] == "=" * padding else 0)


def confirmed_spans(text: str, hex_spans: list[Span]) -> list[Span]:
    """Spans whose decoded content is a private key or a signed token."""
    spans: list[Span] = []
    if "." in text:
        spans += [("jwt", *m.span()) for m in JWT.finditer(text) if _signed(m)]
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            body = decoded("".join(ESCAPED.sub(_unescaped, m[2]).split()))
            if body is not None and private_key(body):
                spans.append(("pem", *m.span()))
    upto = 0
    for start, end in _starts(text):
        if start < upto:
            continue
        found = _wrapped(text, start)
        if found is not None:
            spans.append((found[0], start, found[1]))
            upto = found[1]
    if "-" in text or "_" in text:
        for m in CODED_URL.finditer(text):
            if "-" in m[0] or "_" in m[0]:
                body = decoded(m[0], b"-_")
                kind = private_key(body) if body is not None else None
                if kind:
                    spans.append((kind, *m.span()))
    whole = [m.span() for m in HEX_DATA.finditer(text)]
    lower = [(start, end) for _, start, end in hex_spans if end - start >= 80]  # inside longer runs, too
    for start, end in dict.fromkeys(whole + lower):
        if (end - start) % 2 == 0 and private_der(bytes.fromhex(text[start:end])):
            spans.append(("der", start, end))
    return spans


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda span: (span[1], KINDS.index(span[0]), span[2]))


def scan_text(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind."""
    text = text or ""
    base = base_spans(text, text.lower())
    return in_order(base + confirmed_spans(text, [span for span in base if span[0] == "hex"]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [scan_text(text) for text in batch.column(1).to_pylist()]
        base = [[span for span in spans if span[0] in BASE] for spans in found]
        counts = [pa.array([sum(span[0] == kind for span in spans) for spans in base], pa.int64()) for kind in BASE]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *counts,
                pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]),
                pa.array([joined(spans) for spans in found]),
            ],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """Spans per document (doc_id, text), and a digest of the base spans."""
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), _run, schema)
