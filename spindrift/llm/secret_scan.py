"""Secret scan: patterns, and candidates confirmed by the structure of what they decode to."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, texts_and_ids

#: Kinds in the order in which spans of equal start are listed; the first three are patterns alone.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "token")
_ORDER = {kind: i for i, kind in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:(?!-----).)+)-----END \1-----", re.ASCII | re.DOTALL)
_HEADER = re.compile(r"[A-Za-z0-9-]+:", re.ASCII)
#: Runs that may be a key: 24 bytes are fewer than any key with its encoding takes.
_LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
#: Line ends as such or escaped, and characters of base64, of which JSON can escape some.
_EOL = r"[ \t]*(?:\\*(?:\r\n?|\n)|(?:\\+r)?\\+n)[ \t]*"
_PIECE = re.compile(r"(?:[A-Za-z0-9+/_-]|\\+(?:/|u002[bBfF]))+", re.ASCII)
_NEXT = re.compile(_EOL + "(" + _PIECE.pattern + ")", re.ASCII)
_PADDING = re.compile(r"(?:" + _EOL + r")?(?:=|\\+u003[dD]){1,2}", re.ASCII)
#: The first line of a wrapped key: DER in base64 or hexadecimal, the OpenSSH magic, or an ssh- or ecdsa- type.
_WRAPPED = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nr]))(?=M[A-P]|30|b3BlbnNzaC1rZXktdjE|AAAA..NzaC|AAAA..VjZHNh)[A-Za-z0-9+/_-]{8}" + f"(?:{_PIECE.pattern})(?={_NEXT.pattern})", re.ASCII)
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, content start and content end of the definite-length element at ``at``; None if it doesn't fit."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length & 0x80:
        n = length & 0x7F
        if n == 0 or n > 4 or at + n > end:
            return None
        length, at = int.from_bytes(data[at : at + n], "big"), at + n
    return (tag, at, at + length) if at + length <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    found = []
    while at < end:
        one = _tlv(data, at, end)
        if one is None:
            return None
        found.append(one)
        at = one[2]
    return found


def is_der_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (encrypted or not), SEC1 or SubjectPublicKeyInfo: nested lengths that fill the data exactly, and a key's fields."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _elements(data, top[1], top[2])
    if not parts or len(parts) < 2:
        return False
    tags = [tag for tag, _, _ in parts]

    def algorithm(one: tuple[int, int, int]) -> bool:
        inner = _elements(data, one[1], one[2]) if one[0] == 0x30 else None
        return bool(inner) and inner[0][0] == 0x06

    if algorithm(parts[0]):
        return tags[1] == 0x03 or tags[1] == 0x04 and len(tags) == 2
    if tags[0] != 0x02:
        return False
    if len(parts) >= 3 and algorithm(parts[1]):
        return tags[2] == 0x04
    if tags[1] == 0x04:
        return data[parts[0][1] : parts[0][2]] == b"\x01"
    return len(tags) >= 8 and all(tag == 0x02 for tag in tags[:8])


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH key: a magic word or a key type, then 4-byte lengths that fill the data exactly."""
    if data.startswith(b"openssh-key-v1\0"):
        at, n = 15, 0
        while n < 3 and at + 4 <= len(data):
            at, n = at + 4 + int.from_bytes(data[at : at + 4], "big"), n + 1
        return n == 3 and at <= len(data)
    at, n, kind = 0, 0, b""
    while at + 4 <= len(data):
        length = int.from_bytes(data[at : at + 4], "big")
        kind = kind or data[at + 4 : at + 4 + length]
        at, n = at + 4 + length, n + 1
    return n >= 2 and at == len(data) and (kind.startswith(b"ssh-") or kind.startswith(b"ecdsa-"))


def is_token_header(part: str) -> bool:
    """The first part of a signed token: base64url of a JSON object that names its algorithm."""
    try:
        header = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def _decoded(run: str) -> list[bytes]:
    """What a run of characters can stand for: hexadecimal or either base64 alphabet."""
    found = []
    bare = run.rstrip("=")
    if len(bare) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", bare):
        found.append(bytes.fromhex(bare))
    if len(bare) % 4 != 1:
        try:
            found.append(base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4)))
        except binascii.Error:
            pass
    return found


def _unescaped(text: str) -> str:
    """JSON's escapes of line ends and of base64's characters."""
    if "\\" not in text:
        return text
    text = re.sub(r"\\+u00(2[bBfF]|3[dD])", lambda m: chr(int(m[1], 16)), text)
    return re.sub(r"\\+(?=[\r\n])", "", re.sub(r"(?:\\+r)?\\+n|\\+r", "\n", text)).replace("\\/", "/").replace("\\t", "\t")


def is_pem_body(body: str) -> bool:
    """Header lines, if any, then base64 of a key; of an encrypted key, whose headers say so, the length is all there is to see."""
    lines = _unescaped(body).strip().splitlines()
    headers, at = {}, 0
    while at < len(lines) and _HEADER.match(lines[at]):
        name, value = lines[at].split(":", 1)
        at += 1
        while at < len(lines) and lines[at][:1] in (" ", "\t") and lines[at].strip():
            value, at = value + lines[at], at + 1
        headers[name.lower()] = value
    text = "".join("".join(lines[at:]).split())
    if not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", text, re.ASCII):
        return False
    found = _decoded(text)
    if "ENCRYPTED" in headers.get("proc-type", "") and "dek-info" in headers:
        return any(len(x) >= 32 and len(x) % (8 if "CBC" in headers["dek-info"].upper() else 1) == 0 for x in found)
    return any(is_der_key(x) or is_ssh_key(x) for x in found)


def _ssh_length(data: bytes) -> int | None:
    """The bytes of the OpenSSH key at the start of ``data``."""
    at, n = (15, 3) if data.startswith(b"openssh-key-v1\0") else (0, 0)
    if n == 0:
        kind = data[4 : 4 + int.from_bytes(data[:4], "big")]
        n = {b"ssh-rsa": 3, b"ssh-dss": 5}.get(kind, 3 if kind.startswith(b"ecdsa-") else 2)
        more = False
    else:
        more = True
    while n and at + 4 <= len(data):
        at, n = at + 4 + int.from_bytes(data[at : at + 4], "big"), n - 1
        if n == 0 and more:
            at, n, more = at + 4, int.from_bytes(data[at : at + 4], "big") + 1, False
    return at if n == 0 and at <= len(data) else None


def wrapped_spans(text: str, taken: list[tuple[str, int, int]] = ()) -> list[tuple[str, int, int]]:
    """Keys wrapped over lines without borders: the key's own length says how many characters it has, and these must end
    with a line. What lies in ``taken`` was found before."""
    spans, done = [], 0
    for m in _WRAPPED.finditer(text):
        start = m.start()
        if start < done or any(a <= start < b for _, a, b in taken):
            continue
        joined, at = _unescaped(m[0]), m.end()
        kind, wanted, each = "der", None, 0
        if joined.startswith(("b3Blb", "AAAA")):
            kind = "ssh"
        else:
            head = bytes.fromhex(joined[:16]) if re.fullmatch("30[0-9a-fA-F]{14}", joined[:16]) else base64.b64decode(joined[:8].replace("-", "+").replace("_", "/"))
            each = 2 if joined[0] == "3" else 0
            if head[0] != 0x30:
                continue
            extra = head[1] & 0x7F if head[1] & 0x80 else 0
            if extra > 4 or head[1] == 0x80:
                continue
            size = 2 + extra + (int.from_bytes(head[2 : 2 + extra], "big") if extra else head[1])
            wanted = 2 * size if each else -(-4 * size // 3)
            if wanted > len(text) - start:  # longer than what is left: no walk
                continue
        pieces = [joined]
        have, ends = len(joined), {len(joined): at}
        while (wanted is None or have < wanted) and (n := _NEXT.match(text, at)):
            pieces.append(_unescaped(n[1]))
            have, at = have + len(pieces[-1]), n.end()
            ends[have] = at
        joined = "".join(pieces).replace("-", "+").replace("_", "/")
        if wanted is None:
            size = _ssh_length(base64.b64decode(joined[: len(joined) // 4 * 4] + (joined[len(joined) // 4 * 4 :] + "==")[:4] * (len(joined) % 4 > 1)))
            wanted = -(-4 * size // 3) if size else None
        if wanted not in ends or ends[wanted] <= m.end():
            continue
        if any(is_der_key(x) if kind == "der" else is_ssh_key(x) for x in _decoded(joined[:wanted])):
            end = p.end() if (p := _PADDING.match(text, ends[wanted])) else ends[wanted]
            spans.append((kind, start, end))
            done = end
    return spans


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, leftmost and non-overlapping per kind; a match that is too short still uses its text up."""
    spans = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return spans


def structural_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded content parses as a key or as a signed token's header."""
    spans = []
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            if is_pem_body(m[2]):
                spans.append(("pem", m.start(), m.end()))
    if "eyJ" in text:
        spans += [("token", m.start(), m.end()) for m in _SIGNED.finditer(text) if is_token_header(m[1])]
    if max(map(len, text.split()), default=0) >= 32:
        for m in _LONG.finditer(text):
            for data in _decoded(m[0]):
                if is_der_key(data):
                    spans.append(("der", m.start(), m.end()))
                    break
                if is_ssh_key(data):
                    spans.append(("ssh", m.start(), m.end()))
                    break
    if "\n" in text or "\r" in text or "\\n" in text:
        spans += wrapped_spans(text, [s for s in spans if s[0] == "pem"])
    return spans


def _sorted(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per span: ``key``, kind, start, end (code points, end exclusive), secret.

    Null and empty texts have no spans, repeated rows and rows without a key each give theirs, an empty table gives no
    rows, very long texts are scanned whole, other columns aren't read.
    """

    def run(batches):
        for batch in batches:
            keys, texts = texts_and_ids(batch)
            rows = [(k, *s, t[s[1] : s[2]]) for k, t in zip(keys, texts) for s in _sorted(pattern_spans(t) + structural_spans(t))]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (batch.schema.types[0], pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [key, "kind", "start", "end", "secret"])

    frame = docs.select(F.col(key), text_of(text).alias("text"))
    kind = frame.schema[key].dataType.simpleString()
    return frame.mapInArrow(run, f"`{key}` {kind}, kind string, start bigint, end bigint, secret string")


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span (overlapping ones merged) replaced by ``mask``; null stays null."""
    names = docs.columns
    at = names.index(text)

    def masked(value: str | None) -> str | None:
        if not value:
            return value
        spans = _sorted(pattern_spans(value) + structural_spans(value))
        if not spans:
            return value
        out, done = [], 0
        for _, start, end in spans:
            if start >= done:
                out += [value[done:start], mask]
            done = max(done, end)
        return "".join([*out, value[done:]])

    def run(batches):
        for batch in batches:
            columns = batch.columns
            columns[at] = pa.array(map(masked, columns[at].to_pylist()), columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def secret_digests(docs: DataFrame) -> DataFrame:
    """One row per document with counts per pattern kind, a digest of their spans, and all spans as text.

    Null and empty texts have no spans; every row gives its own, equal rows and null doc_ids too; an empty table gives none;
    very long texts are scanned whole; columns other than doc_id and text aren't read.
    """

    def run(batches):
        for batch in batches:
            _, texts = texts_and_ids(batch)
            counts, digests, listed = [[], [], []], [], []
            for text in texts:
                base = _sorted(pattern_spans(text))
                for kind, column in zip(KINDS, counts):
                    column.append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                listed.append(_joined(_sorted(base + structural_spans(text))))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(listed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)
