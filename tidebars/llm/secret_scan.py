"""Secret scans with structural confirmation.

Three base patterns (assignments, access ids, long hex) are reported as they match. Beside them, base64 and hex candidates are decoded and
parsed, also over lines and escaped line ends: private keys must be DER whose nested lengths fill each other exactly and whose members have a key's types, or the length-prefixed
form that begins with openssh-key-v1; signed tokens must have a header that is JSON with an algorithm and a payload that is JSON. Only what
parses is reported. A vector pass over the bytes first finds the texts that hold a long enough run or a base pattern's literal.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm.common import documents, filled, kept_in_worker, map_arrow, raw, slices

BASE = ("assign", "access", "hex")
#: Base kinds, then those that structure confirms.
KINDS = (*BASE, "pem_key", "der_key", "ssh_key", "jwt")
#: What long_runs looks for if nothing else is said.
LEAST_RUN = 20
#: Every confirmed kind has a run of so many base64 or hex characters: a token's header, or the first line of a wrapped key.
LEAST_CONFIRMED = 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
#: Line ends as JSON, env files and source code write them.
_ESCAPED = re.compile(r"\\+[rn]")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----).)+)-----END \1-----", re.DOTALL)
_FIRST_LINE = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M|b3BlbnNzaC1r)[A-Za-z0-9+/_-]{4,}")
_NEXT_LINE = re.compile(r"""(?=[\s"',]*[\r\n])[\s"',]+([A-Za-z0-9+/_-]+={0,2})(?![A-Za-z0-9+/_=-])""")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{44,}={0,2}")
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{80,}(?![0-9A-Fa-f])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{16,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")


def unbase64(text: str) -> bytes | None:
    """Decoded standard or URL-safe base64, padded or not; None if it is neither."""
    text = text.rstrip("=").translate({45: "+", 95: "/"})
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def members(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, first, past last) of the DER elements that fill data[at:end] exactly; None if their lengths do not add up."""
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 128:
            more = size - 128
            if not 1 <= more <= 4 or at + more > end or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + more], "big"), at + more
            if size < 128:
                return None
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """PKCS #1, PKCS #8 (also encrypted), SEC 1 or DSA private key. Every nested SEQUENCE must be filled exactly."""
    top = members(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = members(data, *top[0][1:])
    if not inner:
        return False
    for tag, a, b in inner:
        if tag == 0x30 and members(data, a, b) is None:
            return False
    tags = [t for t, _, _ in inner]
    version = data[inner[0][1] : inner[0][2]] if tags[0] == 2 else None
    if version in (b"\x00", b"\x01") and len(tags) >= 6 and set(tags[:6]) == {2}:
        return len(tags) in (6, 9, 10) and all(b > a for _, a, b in inner)
    if version in (b"\x00", b"\x01") and tags[1:3] == [0x30, 4]:
        kind = members(data, *inner[1][1:])
        return bool(kind) and kind[0][0] == 6 and inner[2][2] > inner[2][1]
    if version == b"\x01" and tags[1:2] == [4]:
        return inner[1][2] - inner[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags == [0x30, 4]:
        kind = members(data, *inner[0][1:])
        return bool(kind) and kind[0][0] == 6 and inner[1][2] - inner[1][1] >= 16
    return False


def is_ssh_key(data: bytes) -> bool:
    """The openssh-key-v1 form: cipher, key derivation, its options, a count, public keys and private part, each with its length."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, names = len(magic), []

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out, at = data[at + 4 : at + 4 + size], at + 4 + size
        return out

    for _ in range(3):
        names.append(string())
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if None in names or not 1 <= count <= 64:
        return False
    return all(string() for _ in range(count)) and bool(string()) and at == len(data)


def is_jwt(header: str, payload: str) -> bool:
    for part, need in ((header, "alg"), (payload, None)):
        data = unbase64(part)
        try:
            value = json.loads(data) if data else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or need and not isinstance(value.get(need), str):
            return False
    return True


def is_pem_key(body: str) -> bool:
    """Whether what stands between BEGIN and END is a key, under header fields or none. A body that DEK-Info says is encrypted must fill its cipher's blocks."""
    fields, lines, name = {}, [x.strip("\"',") for x in re.split(r"[\r\n]+", body)], None
    rest = []
    for x in lines:
        if not rest and ":" in x:
            name, value = x.split(":", 1)
            name = name.strip().lower()
            fields[name] = value.strip()
        elif not rest and name and x[:1] in (" ", "\t") and x.strip():
            fields[name] += x.strip()
        elif x.strip():
            name = None
            rest.append(x)
    data = unbase64("".join("".join(rest).replace("\\/", "/").split()))
    if not data:
        return False
    if is_der_key(data) or is_ssh_key(data):
        return True
    iv = re.fullmatch(r"[A-Za-z0-9-]+,((?:[0-9A-Fa-f]{16}){1,2})", fields.get("dek-info", "").replace(" ", ""))
    return bool(iv) and fields.get("proc-type", "").replace(" ", "") == "4,ENCRYPTED" and len(data) % (len(iv[1]) // 2) == 0


def wrapped_key(text: str, first: re.Match) -> tuple[int, int] | None:
    """(number of the kind, end) of a key whose base64 starts at ``first`` and goes on in lines of the same width, the last one perhaps shorter."""
    width, parts, end = first.end() - first.start(), [first[0]], first.end()
    head = unbase64(first[0][: len(first[0]) // 4 * 4])
    if not head:
        return None
    need = None
    if head[0] == 0x30:
        more = head[1] - 128 if head[1] >= 128 else 0
        if more > 4 or len(head) < 2 + more:
            return None
        size = 2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1])
        need = -(-4 * size // 3)
        if need <= width or need > len(text) - first.start():
            return None
    have = width
    while (need is None or have < need) and (m := _NEXT_LINE.match(text, end)):
        n = len(m[1].rstrip("="))
        if n > width:
            break
        parts.append(m[1])
        have, end = have + n, m.end()
        if need is None and n <= width and (data := unbase64("".join(parts))) and is_ssh_key(data):
            return 5, end
        if n < width or m[1].endswith("="):
            break
    if need is not None and have == need and (data := unbase64("".join(parts))) and is_der_key(data):
        return 4, end
    return None


def base_spans(text: str, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base patterns' matches that are long enough."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)] if hexes else out


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what decodes and parses. A key inside a PEM block is reported as that block only."""
    # of the same length, so that places stay
    text = _ESCAPED.sub(lambda m: "\n" * len(m[0]), text) if "\\" in text else text
    out, blocks = [], []
    for m in _PEM.finditer(text) if "-----BEGIN " in text else ():
        if is_pem_key(m[2]):
            out.append((m.start(), 3, m.end()))
            blocks.append(m.span())
    free = lambda m: not any(a <= m.start() < b for a, b in blocks)
    for m in _FIRST_LINE.finditer(text):
        if m.end() - m.start() >= LEAST_CONFIRMED and free(m) and (found := wrapped_key(text, m)):
            out.append((m.start(), *found))
            blocks.append((m.start(), found[1]))
    for m in _RUN.finditer(text):
        if free(m) and (data := unbase64(m[0])):
            if data[0] == 0x30 and is_der_key(data):
                out.append((m.start(), 4, m.end()))
            elif is_ssh_key(data):
                out.append((m.start(), 5, m.end()))
    for m in _HEX_RUN.finditer(text):
        if len(m[0]) % 2 == 0 and free(m):
            data = bytes.fromhex(m[0])
            if is_der_key(data) or is_ssh_key(data):
                out.append((m.start(), 4 if data[0] == 0x30 else 5, m.end()))
    return out + [(m.start(), 6, m.end()) for m in _JWT.finditer(text) if is_jwt(m[1], m[2])]


def long_runs(texts: list[bytes], least: int = LEAST_RUN) -> np.ndarray:
    """For each text whether it has ``least`` base64 characters in a row."""

    def table() -> np.ndarray:
        out = np.zeros(256, bool)
        out[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
        return out

    joined = kept_in_worker("base64_characters", table)[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    edge = np.flatnonzero(np.diff(joined, prepend=False))
    start = edge[0::2][edge[1::2] - edge[0::2] >= least]
    found = np.zeros(len(texts), bool)
    found[np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in texts)]), start, side="right") - 1] = True
    return found


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) by start and then kind, of every row. Places are code points, end exclusive.

    Null is the empty text, with no spans. Spans of different kinds may overlap. Rows with missing or repeated ids are scanned like
    others. An empty table gives no rows. Nothing is shuffled.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for part in slices(batches, "text"):
            texts, out = raw(part.column("text")), []
            for data, long in zip(texts, long_runs(texts, LEAST_CONFIRMED), strict=True):
                spans = []
                low = data.lower()
                if any(w in low for w in _WORDS) or b"AKIA" in data or long:
                    whole = data.decode("utf-8", "replace")
                    spans = base_spans(whole, bool(long)) + (confirmed_spans(whole) if long else [])
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), filled(text).alias("text")), run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return scan(documents(spark, sf_dir)).select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op4_secret_scan": (op4_secret_scan, None)}
