"""Secret scans with structural confirmation.

Three base kinds are found by pattern alone: ``assign`` (a named value), ``access`` (an access-key id)
and ``hex`` (a long run of hex digits).  The method adds spans that only a parse can confirm: candidates
in base64 or hex are decoded, and reported when the bytes have the structure of a secret:

* ``pem``: a block between BEGIN/END lines of a private key whose body decodes to a key encoding, or
  which carries the header lines of an encrypted key;
* ``der``: base64 or hex text that decodes to a DER private key: nested lengths all fit, and the
  sequence has the integer and octet-string layout of PKCS#1, PKCS#8, SEC 1 or DSA;
* ``openssh``: a decoded OpenSSH private-key body, whose length-prefixed fields nest exactly;
* ``token``: a signed token: a JSON header that names an algorithm, a JSON payload and a signature.

DER and OpenSSH keys are looked for at every place where their first bytes can stand, within a longer run of
letters too, and over line ends (real ones or ``\\n``); the lengths in their first bytes say where they end.

Offsets are code points, end exclusive.  Defined cases: null text is empty and has no span; the order of
spans is by start, then by kind as listed in ``KINDS``, then by end; repeated rows are scanned alike;
other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_of

KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "token")

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this drops the short ones of [0-9a-f]+

PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:(?!-----BEGIN ).)*?)-----END \1-----", re.DOTALL)
#: Line ends within a wrapped key, with the indent of the next line.
_JOINT = r"(?:\r?\n|(?:\\r)?\\n)[ \t]*"
#: Places where DER can begin (0x30 and a length), and the first bytes of an OpenSSH key.
BASE64_START = re.compile(r"M[A-T](?=[A-Za-z0-9+/_-])|b3BlbnNz")
HEX_START = re.compile(r"30(?=[0-9A-Fa-f])|6[Ff]70656[Ee]")
_BASE64_PIECE = re.compile(rf"({_JOINT})?((?:[A-Za-z0-9+/_]++|-(?!----))+)")  # an END line is no part of a key
_HEX_PIECE = re.compile(rf"({_JOINT})?([0-9A-Fa-f]+)")
#: Least length of a key that is text in base64 and of one in hex.
LEAST_BASE64, LEAST_HEX = 40, 64
#: Words joined by dots; a signed token is three neighbours of them.
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_.-]*+")
TOKEN_START = re.compile(r"e[yw]")
_TOKEN_HEAD = re.compile(r'\{\s*"(?:[^"\\]|\\.)*"\s*:')
OPENSSH_MAGIC = b"openssh-key-v1\0"


def b64(text: str) -> bytes | None:
    """Base64 in either alphabet, padding optional; None when it is not base64."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER value at ``at``; None unless its length fits and is minimal."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n = int.from_bytes(data[at:at + k], "big")
        if n < 0x80:
            return None
        at += k
    return (tag, at, at + n) if at + n <= end else None


def _der_children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill a constructed value exactly."""
    out = []
    while at < end:
        item = _der_item(data, at, end)
        if item is None:
            return None
        out.append(item)
        at = item[2]
    return out


def _nested(data: bytes, items: list[tuple[int, int, int]], depth: int = 0) -> bool:
    """Whether every constructed value below is filled exactly by its parts."""
    for tag, at, end in items:
        if tag & 0x20:
            inner = _der_children(data, at, end) if depth < 16 else None
            if inner is None or not _nested(data, inner, depth + 1):
                return False
    return True


def is_private_der(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (plain or encrypted), SEC 1 or DSA private key, with all nested lengths exact."""
    top = _der_item(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _der_children(data, top[1], top[2])
    if not parts or not _nested(data, parts):
        return False
    tags = [t for t, _, _ in parts]
    version = data[parts[0][1]:parts[0][2]] if tags[0] == 0x02 else None
    if version in (b"\0", b"\1"):
        if len(tags) >= 9 and all(t == 0x02 for t in tags[:9]):
            return True  # PKCS#1: version and eight integers
        if tags[1:3] == [0x30, 0x04]:
            return True  # PKCS#8: version, algorithm, key octets
        if version == b"\0" and tags == [0x02] * 6 and parts[1][2] - parts[1][1] >= 64 and parts[2][2] - parts[2][1] >= 20:
            return True  # DSA: version, p, q, g and both keys
        if version == b"\1" and len(tags) >= 2 and tags[1] == 0x04 and parts[1][2] - parts[1][1] >= 16:
            return True  # SEC 1: version, key octets
    if tags == [0x30, 0x04]:  # encrypted PKCS#8: algorithm with an object identifier, then octets
        inner = _der_children(data, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == 0x06 and parts[1][2] - parts[1][1] >= 32
    return False


def is_openssh(data: bytes) -> bool:
    """OpenSSH private-key body: cipher, kdf, options, key count, public keys, private part."""
    return _openssh_size(lambda a, b: data[a:b]) == len(data)


def _openssh_size(read: Callable[[int, int], bytes | None]) -> int | None:
    """Bytes of the OpenSSH private-key body that ``read(from, to)`` gives; None when it is none."""
    at = len(OPENSSH_MAGIC)
    if read(0, at) != OPENSSH_MAGIC:
        return None

    def number() -> int | None:
        nonlocal at
        four = read(at, at + 4)
        at += 4
        return int.from_bytes(four, "big") if four is not None and len(four) == 4 else None

    def skip() -> bool:
        nonlocal at
        n = number()
        if n is None or n and not read(at + n - 1, at + n):
            return False
        at += n
        return True

    if not all(skip() for _ in range(3)):
        return None
    keys = number()
    return at if keys is not None and 1 <= keys <= 16 and all(skip() for _ in range(keys + 1)) else None


def _der_size(read: Callable[[int, int], bytes | None]) -> int | None:
    """Bytes of the DER sequence that ``read`` gives, when a number or a sequence comes first in it."""
    for first in (7, 6, 5, 4, 3):  # tag, length of up to five bytes, tag
        head = read(0, first)
        if head is not None and len(head) == first:
            break
    else:
        return None
    if head[0] != 0x30:
        return None
    n, at = head[1], 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or 2 + k >= len(head) or head[2] == 0:
            return None
        n, at = int.from_bytes(head[2:2 + k], "big"), 2 + k
    return at + n if at < len(head) and head[at] in (0x02, 0x30) else None


def _may_be_key(read: Callable[[int, int], bytes | None], n: int) -> bool:
    """Whether the heads of the first parts fit a private key of ``n`` bytes; no part is read for it.

    Every key that :func:`is_private_der` confirms passes.
    """
    def item(at: int) -> tuple[int, int, int] | None:
        head = read(at, min(at + 6, n))
        if head is None or len(head) < 2:
            return None
        k = head[1] & 0x7F if head[1] >= 0x80 else 0
        if head[1] >= 0x80 and (not 1 <= k <= 4 or len(head) < 2 + k):
            return None
        size = int.from_bytes(head[2:2 + k], "big") if k else head[1]
        return (head[0], at + 2 + k, at + 2 + k + size) if at + 2 + k + size <= n else None

    top = item(0)
    first = None if top is None else item(top[1])
    second = None if first is None or first[2] >= n else item(first[2])
    if second is None:
        return False
    if first[0] == 0x30:  # encrypted PKCS#8
        return second[0] == 0x04 and second[2] == n
    if first[0] != 0x02 or first[2] - first[1] != 1 or read(first[1], first[2]) not in (b"\0", b"\1"):
        return False
    if second[0] == 0x04:
        return True
    wanted, at = {0x30: [0x04], 0x02: [0x02] * 4}.get(second[0], [0]), second[2]
    for tag in wanted:
        part = item(at) if at < n else None
        if part is None or part[0] != tag:
            return False
        at = part[2]
    return True


class Letters:
    """The letters of a wrapped text from a place on, read no further than they are asked for."""

    def __init__(self, text: str, at: int, piece: re.Pattern[str]):
        self.text, self.at, self.piece = text, at, piece
        self.parts: list[tuple[int, int, int]] = []  # first letter, its place, letters
        self.size, self.next = 0, at

    def upto(self, n: int) -> bool:
        """Whether there are ``n`` letters."""
        if n > len(self.text) - self.at:
            return False
        while self.size < n:
            m = self.piece.match(self.text, self.next, min(len(self.text), self.next + n - self.size + 64))
            if m is None or m[1] and not self.parts:
                return False
            self.parts.append((self.size, m.start(2), len(m[2])))
            self.size, self.next = self.size + len(m[2]), m.end()
        return True

    def span(self, a: int, b: int) -> str:
        i = bisect_right(self.parts, a, key=lambda p: p[0]) - 1
        out = []
        for first, at, n in self.parts[i:]:
            if first >= b:
                break
            out.append(self.text[at + max(a - first, 0):at + min(b - first, n)])
        return "".join(out)

    def place(self, n: int) -> int:
        """The place after the first ``n`` letters."""
        first, at, _ = self.parts[bisect_right(self.parts, n - 1, key=lambda p: p[0]) - 1]
        return at + n - first


def _key_at(text: str, at: int, piece: re.Pattern[str]) -> tuple[int, str] | None:
    """(end, kind) of the DER or OpenSSH key that begins at a place of the text."""
    letters, in_hex = Letters(text, at, piece), piece is _HEX_PIECE

    def read(a: int, b: int) -> bytes | None:
        if in_hex:
            return bytes.fromhex(letters.span(2 * a, 2 * b)) if letters.upto(2 * b) else None
        first, last = a // 3 * 4, -(-8 * b // 6)
        data = b64(letters.span(first, last)) if letters.upto(last) else None
        return None if data is None else data[a - a // 3 * 3:][:b - a]

    kind = "openssh" if text[at] in "b6" else "der"
    n = (_der_size if kind == "der" else _openssh_size)(read)
    if n is None:
        return None
    size = 2 * n if in_hex else -(-8 * n // 6)
    if size < (LEAST_HEX if in_hex else LEAST_BASE64):
        return None
    if kind == "der" and not (_may_be_key(read, n) and is_private_der(read(0, n) or b"")):
        return None
    end = letters.place(size)
    if not in_hex:
        end += len(text[end:end + 2]) - len(text[end:end + 2].lstrip("="))
    return end, kind


def _keys(text: str, start: re.Pattern[str], piece: re.Pattern[str], covered: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Keys that begin where ``start`` matches, outside the covered ranges and outside each other."""
    out: list[tuple[int, int, str]] = []
    apart: list[tuple[int, int]] = []
    for a, b in sorted(covered):
        if apart and a < apart[-1][1]:
            apart[-1] = (apart[-1][0], max(b, apart[-1][1]))
        else:
            apart.append((a, b))
    begins = [a for a, _ in apart]
    m = start.search(text)
    while m is not None:
        at = m.start()
        i = bisect_right(begins, at) - 1
        found = None if i >= 0 and at < apart[i][1] else _key_at(text, at, piece)
        if found is not None:
            out.append((at, *found))
        m = start.search(text, at + 1 if found is None else found[0])
    return out


def _json(part: str) -> object:
    try:
        return json.loads(b64(part) or b"")
    except (ValueError, RecursionError):
        return None


def _token_heads(word: str) -> list[int]:
    """Places from which a word can decode to a JSON object; it is decoded once for each place modulo four."""
    decoded = [b64(word[r:]) for r in range(4)]
    plain = [None if d is None else d.decode("latin-1") for d in decoded]
    return [x for x in (m.start() for m in TOKEN_START.finditer(word)) if len(word) - x >= 8
            and plain[x % 4] is not None and _TOKEN_HEAD.match(plain[x % 4], x // 4 * 3)]


def _tokens(text: str) -> list[tuple[int, int, str]]:
    """Signed tokens among words joined by dots; a header may begin within a word."""
    out: list[tuple[int, int, str]] = []
    for m in DOTTED.finditer(text):
        words, at, i = m[0].split("."), m.start(), 0
        while i + 2 < len(words):
            head, body, sign = words[i:i + 3]
            end = at + len(head) + 1 + len(body) + 1 + len(sign)
            if len(body) >= 2 and TOKEN_START.search(head) and isinstance(_json(body), dict):
                begin = next((x for x in _token_heads(head) if is_signed_token(f"{head[x:]}.{body}.{sign}")), None)
                if begin is not None:
                    out.append((at + begin, end, "token"))
                    at, i = end + 1, i + 3
                    continue
            at, i = at + len(head) + 1, i + 1
    return out


def is_signed_token(text: str) -> bool:
    """Three parts: a JSON header naming an algorithm, a JSON payload, a signature (empty for ``none``)."""
    head, body, sign = text.split(".")[:3]
    try:
        header, payload = (json.loads(b64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str) or not isinstance(payload, dict):
        return False
    return header["alg"].lower() == "none" or bool(sign and b64(sign))


def _pem_confirmed(body: str) -> bool:
    if re.search(r"Proc-Type: *4, *ENCRYPTED", body):
        return True
    data = b64(re.sub(r"\\n|\\r|\s", "", body))
    return data is not None and (is_private_der(data) or is_openssh(data))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def added_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans confirmed by decoding and parsing.

    A decode is tried at every place where a key's first bytes can stand; it reads the first bytes, and as many
    more as their lengths say.
    """
    out: list[tuple[int, int, str]] = []
    if "PRIVATE KEY-----" in text:
        out += [(m.start(), m.end(), "pem") for m in PEM.finditer(text) if _pem_confirmed(m[2])]
    if "." in text and ("ey" in text or "ew" in text):
        out += _tokens(text)
    covered = [(a, b) for a, b, _ in out]
    return out + _keys(text, BASE64_START, _BASE64_PIECE, covered) + _keys(text, HEX_START, _HEX_PIECE, [])


_RANK = {k: i for i, k in enumerate(KINDS)}


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each as (start, end, kind) by start, then kind, then end."""
    def order(spans):
        return sorted(set(spans), key=lambda s: (s[0], _RANK[s[2]], s[1]))
    base = base_spans(text)
    return order(base), order(base + added_spans(text))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by ``[SECRET]``."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``spans`` (array of start, end, kind, base), in one narrow pass."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()),
                                   ("base", pa.bool_())]))
        for b in slices(batches):
            rows = []
            for t in b.column(1).to_pylist():
                base, spans = find(t)
                own = set(base)
                rows.append([{"start": a, "end": e, "kind": k, "base": (a, e, k) in own} for a, e, k in spans])
            yield pa.record_batch([b.column(0), pa.array(rows, kind)], ["key", "spans"])

    key_type = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), text_of(text).alias("t"))
            .mapInArrow(scan, f"key {key_type}, spans array<struct<start:bigint,end:bigint,kind:string,base:boolean>>")
            .withColumnRenamed("key", key))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, digest of base spans, all spans."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    n = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *n, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """The same rows and columns, the characters of each secret replaced by ``[SECRET]``.

    ``length`` names a code-point count that follows the text.  Rows without a secret stay as they are,
    null texts among them.
    """
    at = docs.columns.index(text)
    size_at = docs.columns.index(length) if length else None

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            old = b.column(at).to_pylist()
            new = [t if t is None else masked(t, find(t)[1]) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, cols[at].type)
            if size_at is not None:
                sizes = [n if t == u else len(u) for n, t, u in zip(cols[size_at].to_pylist(), old, new)]
                cols[size_at] = pa.array(sizes, cols[size_at].type)
            yield pa.record_batch(cols, b.schema.names)

    return docs.mapInArrow(rewrite, docs.schema)
