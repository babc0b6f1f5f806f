"""Secret scan: pattern rules, and candidates confirmed by their structure.

Rules (assignments, access keys, long hexadecimal runs) report by pattern alone. Long
base64 or hexadecimal runs, PEM blocks and three-part tokens are only candidates: they
are decoded and reported if the bytes parse as a private or public key (nested DER
lengths that fill each other exactly, or an OpenSSH key's length-prefixed fields), or if
a token's header and payload are JSON objects and the header names an algorithm.

A text is first turned into runs by byte translation, so texts without a candidate cost
a few passes of C code. Spans are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

KINDS = ("assign", "access", "hex", "jwt", "pem", "key_base64", "key_hex")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*(?:KEY|CERTIFICATE))-----((?:[^-]|-(?!----))+)-----END \1-----")
# A line break is one, or its escape in a string of JSON or an env file.
_ESCAPED = re.compile(r"\\+r\\+n|\\+[rn]")
# Runs parted by single line breaks; a run doesn't begin with the letter of an escape.
_BASE64 = re.compile(r"(?:(?<![A-Za-z0-9+/_-])(?!(?<=\\)[rn])|(?<=\\[rn]))[A-Za-z0-9+/_-]{40,}={0,2}(?:(?:\r?\n[ \t]*|\\+r\\+n|\\+[rn])[A-Za-z0-9+/_-]+={0,2})*")
_HEADER = re.compile(r"[A-Za-z0-9-]+:")
_CIPHER = re.compile(r"DEK-Info:\s*[A-Z0-9-]+,((?:[0-9A-Fa-f]{2}){8,16})\s*\Z")
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")

_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_RUNS = bytes(0x78 if chr(c) in "0123456789abcdefABCDEF" else 0x20 for c in range(256))
_BASE64_RUNS = bytes(0x78 if chr(c).isalnum() and c < 128 or chr(c) in "+/_-" else 0x20 for c in range(256))

#: Object identifiers of key algorithms (DER content): RSA, EC, DSA, X25519, Ed25519, Ed448.
_KEY_OIDS = (bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2a8648ce380401"), bytes.fromhex("2b656e"), bytes.fromhex("2b6570"), bytes.fromhex("2b6571"))


#: Beginnings of the schemes that encrypt a PKCS #8 key: PKCS #5's, PKCS #12's.
_CIPHER_OIDS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def der_items(data: bytes, depth: int = 0) -> list | None:
    """The (tag, content) items that fill ``data`` exactly, content of constructed tags
    as items again; None if a length doesn't fit or nesting is deeper than 12."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > 12:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            n = int.from_bytes(data[at : at + width], "big")
            at += width
            if n < 0x80:
                return None  # DER has the shortest form only
        if at + n > len(data):
            return None
        content: bytes | list | None = data[at : at + n]
        if tag & 0x20 and (content := der_items(data[at : at + n], depth + 1)) is None:
            return None
        items.append((tag, content))
        at += n
    return items


def _has_key_oid(items: list) -> bool:
    return any(content in _KEY_OIDS if tag == 0x06 else isinstance(content, list) and _has_key_oid(content) for tag, content in items)


def key_encoding(data: bytes) -> str | None:
    """What key encoding the bytes are: pkcs1, pkcs8, pkcs8-encrypted, spki, sec1, dsa,
    openssh, ssh, or None."""
    if data.startswith(b"openssh-key-v1\0"):
        at, fields = 15, 0
        while fields < 3:  # cipher, key derivation, its options
            if at + 4 > len(data) or (at := at + 4 + int.from_bytes(data[at : at + 4], "big")) > len(data):
                return None
            fields += 1
        return "openssh"
    if data[:4] == b"\0\0\0\7" and data[4:11] == b"ssh-rsa" or data[:4] == b"\0\0\0\x0b" and data[4:15] == b"ssh-ed25519":
        at = 0
        while at < len(data):
            if at + 4 > len(data) or (at := at + 4 + int.from_bytes(data[at : at + 4], "big")) > len(data):
                return None
        return "ssh"
    if data[:1] != b"\x30" or not (outer := der_items(data)) or len(outer) != 1 or not isinstance(outer[0][1], list):
        return None
    items = outer[0][1]
    tags = [t for t, _ in items]
    if len(items) >= 9 and set(tags[:9]) == {0x02}:
        return "pkcs1"
    if tags[:3] == [0x02, 0x30, 0x04] and _has_key_oid(items[1][1]):
        return "pkcs8"
    if tags == [0x02] * 6 and items[0][1] == b"\0" and len(items[1][1]) >= 64:
        return "dsa"
    if tags == [0x30, 0x04] and [t for t, _ in items[0][1]][:1] == [0x06] and items[0][1][0][1].startswith(_CIPHER_OIDS) and items[1][1]:
        return "pkcs8-encrypted"
    if tags == [0x30, 0x03] and _has_key_oid(items[0][1]):
        return "spki"
    if tags[:2] == [0x02, 0x04] and items[0][1] == b"\1" and len(items[1][1]) in (28, 32, 48, 66):
        return "sec1"
    if tags == [0x02, 0x02] and len(items[0][1]) >= 64:
        return "pkcs1"
    return None


def decode_base64(text: str) -> bytes | None:
    """Standard or URL-safe alphabet, padding optional; None if it can't be base64."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def key_size(data: bytes) -> int | None:
    """How many bytes a key encoding has by its first bytes and length fields; None if
    the bytes don't begin as one or end too early to tell."""
    if data[:1] == b"\x30":
        width = data[1] & 0x7F if len(data) > 1 and data[1] & 0x80 else 0
        if len(data) < 2 + width or width > 4:
            return None
        return 2 + width + (int.from_bytes(data[2 : 2 + width], "big") if width else data[1])
    at, fields = 0, 0
    if data.startswith(b"openssh-key-v1\0"):
        at = 15
        for _ in range(3):  # cipher, key derivation, its options
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        fields = 1 + int.from_bytes(data[at : at + 4], "big")  # public keys, the private part
        at += 4
    elif data.startswith(b"\0\0\0\7ssh-rsa"):
        fields = 3
    elif data.startswith(b"\0\0\0\x0bssh-ed25519"):
        fields = 2
    else:
        return None
    for _ in range(fields):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at


def pem_is_key(label: str, body: str) -> bool:
    """Whether what stands between a PEM block's markers is a key: header lines and
    escaped line breaks are taken out first. Under a cipher that the headers name, whole
    blocks of its ciphertext are all the structure there is."""
    lines = [x.strip() for x in _ESCAPED.sub("\n", body).replace("\\/", "/").strip().splitlines()]
    cipher = None
    if lines and _HEADER.match(lines[0]):
        end = next((i for i, x in enumerate(lines) if not x), 0)  # an empty line ends the headers
        end = end or next((i for i, x in enumerate(lines) if not _HEADER.match(x)), len(lines))
        cipher = next((c for x in lines[:end] if (c := _CIPHER.match(x))), None)
        lines = lines[end:]
    data = decode_base64("".join("".join(lines).split()))
    if not data:
        return False
    if cipher and label.endswith("PRIVATE KEY") and len(data) >= 32 and len(data) % 8 == 0:
        return True
    return bool(key_encoding(data)) or label.startswith("OPENSSH") and data.startswith(b"openssh-key-v1")


def base64_keys(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Keys within a stretch of base64 runs parted by line breaks: a run that is a key,
    or so many of them as the length fields of the first bytes ask for."""
    breaks = list(re.finditer(r"\r?\n[ \t]*|\\+r\\+n|\\+[rn]", text[start:end]))
    starts = [start, *[start + m.end() for m in breaks]]
    ends = [*[start + m.start() for m in breaks], end]
    runs = [text[a:b].rstrip("=") for a, b in zip(starts, ends, strict=True)]
    before = [0, *accumulate(len(r) for r in runs)]  # characters
    whole = "".join(runs)
    i = 0
    while i < len(runs):
        last = _last_run(runs, before, whole, i) if len(runs[i]) >= 40 else None
        if last is not None and any(text[ends[k] - 1] == "=" for k in range(i, last)):
            last = None  # padding stands at a key's end only
        if last is None and len(runs[i]) >= 40 and (data := decode_base64(text[starts[i] : ends[i]])) and key_encoding(data):
            last = i
        if last is not None:
            yield starts[i], ends[last]
            i = last
        i += 1


def _last_run(runs: list[str], before: list[int], whole: str, i: int) -> int | None:
    """The run that a key beginning with run i ends with, by the key's own size."""
    if not runs[i].startswith(("M", "b3BlbnNzaC1rZXkt", "AAAAB3NzaC1yc2", "AAAAC3NzaC1lZDI1NTE5")):
        return None
    head = whole[before[i] : before[i] + 8] if runs[i][0] == "M" else whole[before[i] :]
    size = key_size(decode_base64(head[: len(head) // 4 * 4]) or b"")
    if size is None and len(head) % 4:
        size = key_size(decode_base64(head) or b"")
    if size is None:
        return None
    stop = before[i] - (-4 * size // 3)
    j = bisect_left(before, stop, i + 1)
    if j == len(before) or before[j] != stop or not key_encoding(decode_base64(whole[before[i] : stop]) or b""):
        return None
    return j - 1


def is_token(header: str, payload: str) -> bool:
    """A signed token's first two parts: JSON objects, the first with an algorithm."""
    parts = []
    for part in (header, payload):
        try:
            parts.append(json.loads(decode_base64(part) or b""))
        except (ValueError, RecursionError):
            return False
    return all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str)


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    """Of the pattern rules. raw: the text in UTF-8."""
    spans = []
    low = raw.lower()
    if any(w in low for w in _WORDS):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if b"x" * 32 in raw.translate(_HEX_RUNS):
        spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


def confirmed_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    """Of the candidates whose structure holds."""
    spans = []
    if b"eyJ" in raw:
        spans += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if is_token(m[1], m[2])]
    if b"-----BEGIN " in raw:
        for m in _PEM.finditer(text):
            if pem_is_key(m[1], m[2]):
                spans.append((m.start(), m.end(), "pem"))
    if b"x" * 40 in raw.translate(_BASE64_RUNS):
        covered = [(a, b) for a, b, k in spans]
        for m in _BASE64.finditer(text):
            spans += [(a, b, "key_base64") for a, b in base64_keys(text, m.start(), m.end()) if not any(c <= a < d for c, d in covered)]
        for m in _LONG_HEX.finditer(text):
            if key_encoding(bytes.fromhex(m[0])):
                spans.append((m.start(), m.end(), "key_hex"))
    return spans


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], _ORDER[s[2]], s[1])))


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and confirmed spans of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    return base_spans(text, raw), confirmed_spans(text, raw)


def scan_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed)``, a row for
    each input row, repeated ones too; a null or empty text has no spans; texts are scanned
    whole, however long; null ids stay null; other columns are ignored, whatever their names;
    an empty table gives no rows."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [scan(t) for t in pdf["text"]]
            out = pd.DataFrame({"doc_id": pdf["doc_id"]})
            for kind in KINDS[:3]:
                out[f"n_{kind}"] = [sum(k == kind for _, _, k in base) for base, _ in found]
            out["base_sha256"] = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            out["spans"] = [joined(base + more) for base, more in found]
            out["n_confirmed"] = [len(more) for _, more in found]
            yield out

    return docs.select("doc_id", "text").mapInPandas(rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def redact(text: str | None) -> str | None:
    """The text with every span replaced by ``[kind]``; overlapping spans become one,
    named after the first."""
    if text is None:
        return None
    base, more = scan(text)
    out, at = [], 0
    for a, b, k in sorted(base + more, key=lambda s: (s[0], -s[1], _ORDER[s[2]])):
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; secrets in ``text`` give way to ``[kind]`` and
    ``n_chars``, where there is one, follows. Null texts stay null. Only texts go to the
    Python workers: other columns stay as they are, whatever their names."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redact(t) for t in texts], dtype=object)
        give_back()

    out = small_batches(docs, 2 << 20).withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
