"""Secret scanning with structural confirmation.

Three base kinds are found by pattern alone: assignments of a value to a telling name, access key ids and long hex
runs. On top, candidates that look like encoded keys or signed tokens are decoded from base64 or hex and reported
only if what they hold parses: a token's header and claims must be JSON objects of which the header names an
algorithm; a private key must be an ASN.1 structure whose nested lengths add up and that has the fields of PKCS#1,
PKCS#8 or SEC 1, or the length-prefixed fields of an OpenSSH key file.
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

from chronoweave.llm._common import batch_of, prepare, trimmed

#: Base kinds, then those confirmed by structure; spans at the same start are listed in this order.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key")
# The base patterns. A match counts if the group named after it is long enough.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16

TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]{8,})\.(ey[A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)")
# headers of an encrypted key hold hyphens, five in a row only the next line of the armour
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----).)+)-----END \1-----", re.DOTALL)
ESCAPED = re.compile(r"\\+(?:[rnt]|\r?\n)")
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{64,}={0,2}")
LONG_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
OPENSSH = b"openssh-key-v1\0"
INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def unbase64(s: str) -> bytes | None:
    """Standard or URL-safe base64, white space and padding optional; None if it isn't any."""
    s = "".join(s.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) elements that fill data exactly, by definite minimal lengths; None if they don't."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            if size < 0x80:
                return None
            at += n
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_private_key(data: bytes) -> bool:
    """Whether data is a whole private key, by its nested structure."""
    if data.startswith(OPENSSH):
        return is_openssh_key(data[len(OPENSSH) :])
    if data[:1] != bytes([SEQUENCE]):
        return False
    top = elements(data)
    if not top or len(top) != 1 or (inner := elements(top[0][1])) is None or len(inner) < 2:
        return False
    tags = [t for t, _ in inner]
    if tags[:9] == [INTEGER] * 9:  # PKCS#1: version and eight numbers
        return inner[0][1] in (b"\0", b"\1") and len(inner[1][1]) >= 32
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:  # PKCS#8: version, algorithm, key
        algorithm = elements(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == OID and len(inner[2][1]) >= 16
    if tags[:2] == [INTEGER, OCTETS]:  # SEC 1: version one and the scalar
        return inner[0][1] == b"\1" and 16 <= len(inner[1][1]) <= 72
    if tags == [SEQUENCE, OCTETS]:  # PKCS#8, encrypted: algorithm, key
        algorithm = elements(inner[0][1])
        return bool(algorithm) and algorithm[0][0] == OID and len(inner[1][1]) >= 16
    return False


def is_openssh_key(data: bytes) -> bool:
    """Cipher, key derivation and its options, a count of keys, that many public keys, the private part."""
    at, fields = 0, []

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    for _ in range(3):
        fields.append(field())
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if None in fields or not 1 <= count <= 16:
        return False
    fields += [field() for _ in range(count + 1)]
    return None not in fields and len(fields[-1]) >= 16 and at == len(data)


def is_signed_token(header: str, claims: str) -> bool:
    parts = []
    for s in (header, claims):
        try:
            parts.append(json.loads(unbase64(s) or b""))
        except (ValueError, RecursionError):
            return False
    return all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str)


def holds_key(data: bytes | None) -> bool:
    """Whether decoded bytes are a private key, or an armoured one in turn."""
    if not data:
        return False
    if data.startswith(b"-----BEGIN "):
        m = ARMOUR.match(data.decode("latin-1"))
        return m is not None and armoured(m)
    return is_private_key(data)


def armoured(m: re.Match) -> bool:
    lines = re.sub(r"\\+/", "/", ESCAPED.sub("\n", m[2]))  # line ends and slashes written out, as in JSON or source
    body = re.sub(r"(?m)^[A-Za-z0-9-]+: .*$", "", lines)  # headers of an encrypted key
    data = unbase64(body)
    return bool(data) and (is_private_key(data) or body != lines and len(data) >= 16)


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of text as (kind, start, end), in code points, by start and then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    found += [("jwt", *m.span()) for m in TOKEN.finditer(text) if is_signed_token(m[1], m[2])]
    if "-----BEGIN " in text:
        found += [("pem", *m.span()) for m in ARMOUR.finditer(text) if armoured(m)]
    keys = {m.span() for m in ENCODED.finditer(text) if holds_key(unbase64(m[0]))}
    keys |= {m.span() for m in LONG_HEX.finditer(text) if (m.end() - m.start()) % 2 == 0 and holds_key(bytes.fromhex(m[0]))}
    armour = [(a, b) for k, a, b in found if k == "pem"]
    found += [("key", a, b) for a, b in keys if not any(x <= a and b <= y for x, y in armour)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each run of overlapping spans replaced by the kind of its first in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("found", pa.list_(SPAN))])


def scan(docs: DataFrame) -> DataFrame:
    """The secrets in every text of docs (doc_id, text, any other columns).

    Returns one row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, joined by
    commas) and found (the same as an array of structs). A null or empty text has none. An empty table gives an empty
    result.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                spans = find(text or "")
                base = [s for s in spans if s[0] in KINDS[:3]]
                counts = [sum(s[0] == k for s in base) for k in KINDS[:3]]
                rows.append((doc, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), [{"kind": k, "start": x, "end": y} for k, x, y in spans]))
            if rows:
                yield batch_of(FOUND, *zip(*rows, strict=True))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text replaced by their kind in brackets; all other columns as they are, a null text stays null."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact(t, find(t)))

    prepare(docs.sparkSession)
    return docs.withColumn("text", clean("text"))
