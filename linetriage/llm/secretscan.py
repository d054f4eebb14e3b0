"""Secrets in texts: pattern rules, and encoded keys and signed tokens confirmed by their inner structure."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from linetriage.llm.common import texts_of

#: Kinds in the order in which spans with one start are listed; the last three are confirmed by structure.
KINDS = ("assign", "access", "hex", "signed_token", "der_key", "ssh_key")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*){2,4}")
_START64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24}")
_START16 = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee]|2[Dd]2[Dd]2[Dd]2[Dd])[0-9A-Fa-f]{40}")
_RUN64 = re.compile(r"[A-Za-z0-9+/_-]+")
_RUN16 = re.compile(r"[0-9A-Fa-f]+")
#: A line break, or one written as an escape inside a quoted string.
_BREAK = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[\x20\t]*")
#: First base64 digits of a DER sequence, of the OpenSSH magic, of a PEM line and of a JSON object.
_LEADS64 = ("M", "b3BlbnNzaC1rZXkt", "LS0tLS1CRUdJTi", "ZXlK")
_MAGIC = b"openssh-key-v1\0"
#: An RSA key of 16,384 bits takes 9,400 bytes; a longer candidate is no key, which bounds the work for each candidate.
LONGEST_KEY = 1 << 14
DEEPEST = 3
_URL_SAFE = str.maketrans("-_", "+/")


def read_der(data: bytes, at: int, end: int, depth: int = 0) -> tuple[int, list, int]:
    """One DER element at ``at``: tag, children (or [content] of a primitive), and where it ends; ValueError if malformed."""
    if depth > 16 or end - at < 2:
        raise ValueError("no DER element")
    tag, length, start = data[at], data[at + 1], at + 2
    if tag & 31 == 31:
        raise ValueError("long tags do not occur in keys")
    if length & 128:
        size = length & 127
        length = int.from_bytes(data[start : start + size], "big")
        if not 1 <= size <= 4 or start + size > end or length < 128 or data[start] == 0:
            raise ValueError("length is not in its shortest form")
        start += size
    if start + length > end:
        raise ValueError("length beyond the enclosing element")
    stop = start + length
    if not tag & 32:
        return tag, [data[start:stop]], stop
    children, inner = [], start
    while inner < stop:
        child_tag, content, inner = read_der(data, inner, stop, depth + 1)
        children.append((child_tag, content))
    return tag, children, stop


def _number(element: tuple[int, list]) -> int:
    return int.from_bytes(element[1][0], "big", signed=True)


def _key_algorithm(element: tuple[int, list]) -> bool:
    return element[0] == 0x30 and bool(element[1]) and element[1][0][0] == 6


def _whole(data: bytes) -> bool:
    try:
        return read_der(data, 0, len(data))[2] == len(data)
    except ValueError:
        return False


def der_form(data: bytes) -> str | None:
    """Which private key encoding ``data`` holds, if its nested lengths and its members agree with one."""
    try:
        tag, parts, end = read_der(data, 0, len(data))
    except ValueError:
        return None
    if tag != 0x30 or end != len(data) or not parts:
        return None
    tags = [t for t, _ in parts]
    if tags[:1] == [2] and not parts[0][1][0]:
        return None
    if len(tags) >= 9 and tags[:9] == [2] * 9 and _number(parts[0]) in (0, 1):
        n, _, _, p, q = (_number(x) for x in parts[1:6])
        return "rsa" if p > 1 and q > 1 and p * q == n else None
    if tags == [2] * 6 and _number(parts[0]) == 0:
        p, q, g, y, x = (_number(v) for v in parts[1:])
        return "dsa" if q > 1 and (p - 1) % q == 0 and 1 < g < p and 0 < y < p and 0 < x < q else None
    if tags[:3] == [2, 0x30, 4] and _number(parts[0]) in (0, 1) and _key_algorithm(parts[1]):
        return "pkcs8" if _whole(parts[2][1][0]) else None
    if tags[:2] == [2, 4] and _number(parts[0]) == 1 and set(tags[2:]) <= {0xA0, 0xA1}:
        return "ec" if 20 <= len(parts[1][1][0]) <= 66 else None
    if tags == [0x30, 4] and _key_algorithm(parts[0]) and len(parts[1][1][0]) % 8 == 0 and parts[1][1][0]:
        return "pkcs8-encrypted"
    return None


def der_length(head: bytes) -> int | None:
    """Whole length of the DER sequence that starts with ``head``."""
    if len(head) < 6 or head[0] != 0x30:
        return None
    if head[1] < 128:
        return 2 + head[1]
    size = head[1] & 127
    return 2 + size + int.from_bytes(head[2 : 2 + size], "big") if 1 <= size <= 4 else None


def ssh_length(data: bytes) -> int | None:
    """Where the OpenSSH private key at the start of ``data`` ends, if its nested lengths fit."""
    if not data.startswith(_MAGIC):
        return None

    def item(at: int) -> tuple[bytes, int]:
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            raise ValueError("length beyond the end")
        return data[at + 4 : at + 4 + size], at + 4 + size

    try:
        cipher, at = item(len(_MAGIC))
        kdf, at = item(at)
        _, at = item(at)
        count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if not 1 <= count <= 16 or not cipher or not kdf:
            return None
        for _ in range(count):
            public, at = item(at)
            if not 0 < int.from_bytes(public[:4], "big") <= len(public) - 4:
                return None
        private, at = item(at)
    except ValueError:
        return None
    checked = cipher != b"none" or (len(private) >= 16 and private[:4] == private[4:8])
    return at if checked and private else None


def token_form(parts: list[str]) -> str | None:
    """Algorithm of a signed (three parts) or encrypted (five) token whose header and claims decode to JSON objects."""

    def decoded(part: str) -> bytes:
        if len(part) % 4 == 1:
            raise ValueError("no base64")
        return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))

    try:
        header = json.loads(decoded(parts[0]))
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            return None
        if len(parts) == 5:
            return header["alg"] if isinstance(header.get("enc"), str) and all(map(decoded, parts[2:])) else None
        if not isinstance(json.loads(decoded(parts[1])), dict):
            return None
        signature = decoded(parts[2])
    except (ValueError, RecursionError):
        return None
    exact = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "none": 0}
    wanted = exact.get(header["alg"])
    fits = len(signature) == wanted if wanted is not None else len(signature) >= 16
    return header["alg"] if fits else None


class _Digits:
    """Digits of an encoded stretch that may be wrapped over lines, gathered only as far as they are asked for."""

    def __init__(self, text: str, start: int, run: re.Pattern):
        self.text, self.run = text, run
        self.pieces: list[tuple[int, str]] = []
        self.count, self.next, self.open = 0, start, True

    def upto(self, wanted: int | None) -> str:
        """The first ``wanted`` digits (all up to the longest key if None), or fewer if the stretch ends."""
        limit = wanted if wanted is not None else 2 * LONGEST_KEY
        while self.open and self.count < limit:
            piece = self.run.match(self.text, self.next, min(len(self.text), self.next + limit - self.count))
            if not piece:
                self.open = False
                break
            self.pieces.append((self.next, piece[0]))
            self.count += len(piece[0])
            wrapped = _BREAK.match(self.text, piece.end())
            self.next = wrapped.end() if wrapped else piece.end()
            if not wrapped and self.count < limit:
                self.open = False
        return "".join(p for _, p in self.pieces)[:limit]

    def end(self, digits: int) -> int:
        """Position in the text just after the first ``digits`` digits."""
        for at, piece in self.pieces:
            if digits <= len(piece):
                return at + digits
            digits -= len(piece)
        raise ValueError("not gathered")


def _bytes64(digits: str) -> bytes:
    whole = digits.translate(_URL_SAFE)
    spare = len(whole) % 4
    if spare == 1:
        whole, spare = whole[:-1], 0
    return base64.b64decode(whole + "=" * (-spare % 4))


def _bytes16(digits: str) -> bytes:
    return binascii.unhexlify(digits[: len(digits) // 2 * 2])


def _confirm(text: str, start: int, run: re.Pattern, depth: int) -> tuple[str, int, str] | None:
    """Kind, end and form of the encoded secret at ``start``, if decoding it shows one."""
    in64 = run is _RUN64
    decode = _bytes64 if in64 else _bytes16
    digits = _Digits(text, start, run)

    def end_of(size: int) -> int | None:
        """End of the encoding of ``size`` bytes with its padding; None if other digits run on."""
        end = digits.end(-(-size * 4 // 3) if in64 else 2 * size)
        while in64 and text[end : end + 1] == "=":
            end += 1
        return None if run.match(text, end) else end

    kind, form, size = "", None, 0
    head = decode(digits.upto(24))
    if head[:1] == b"\x30":
        size = der_length(head) or 0
        if not 0 < size <= LONGEST_KEY:
            return None
        body = decode(digits.upto(-(-size * 4 // 3) if in64 else 2 * size))
        kind, form = "der_key", der_form(body) if len(body) == size else None
    elif head.startswith(_MAGIC[:8]):
        size = ssh_length(decode(digits.upto(None))) or 0
        kind, form = "ssh_key", "openssh" if size else None
    elif depth < DEEPEST and head.startswith((b"-----BEGIN", b"eyJ")):
        body = decode(digits.upto(None))
        inner = confirmed(body.decode("latin-1"), depth + 1)
        if inner:
            kind, form, size = inner[0][0], f"encoded {inner[0][3]}", len(body)
    end = end_of(size) if form else None
    return (kind, end, form) if end else None


def confirmed(text: str, depth: int = 0) -> list[tuple[str, int, int, str]]:
    """Spans (kind, start, end, form) of encoded keys and tokens that decode to what they claim to be."""
    found = []
    for m in _TOKEN.finditer(text):
        parts = m[0].split(".")
        for used in (parts, parts[:3]):  # what follows three parts may be the end of a sentence
            if len(used) in (3, 5) and (form := token_form(used)):
                found.append(("signed_token", m.start(), m.start() + len(".".join(used)), form))
                break
    for starts, run, leads in ((_START64, _RUN64, _LEADS64), (_START16, _RUN16, None)):
        reached = 0
        for m in starts.finditer(text):
            if m.start() < reached or (leads and not m[0].startswith(leads)):
                continue
            if hit := _confirm(text, m.start(), run, depth):
                found.append((hit[0], m.start(), hit[1], hit[2]))
                reached = hit[1]
    return found


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """All spans (kind, start, end, form) of a text in code points, by start, then kind."""
    found = [("assign", m.start(), m.end(), m[1].lower()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end(), "") for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), "") for m in _HEX.finditer(text)]
    found += confirmed(text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("form", pa.string())])
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,form:string>>"


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``spans`` of secrets, by start, then kind; one pass, no shuffle.

    ``form`` says what was decoded (key encoding, token algorithm) or which name was assigned. A null or empty
    text has no spans; a null doc_id is carried along; repeated rows are scanned each; other columns are
    ignored; an empty table gives no rows. Time is linear in the length of a text: each encoded candidate is
    decoded up to the length that its own head states, ``LONGEST_KEY`` bytes at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [dict(zip(("kind", "start", "end", "form"), s)) for s in scan(t)] for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
