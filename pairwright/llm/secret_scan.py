"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Candidates are runs of token characters. Each has the narrowest class its characters fit (hex, letters, which is all without a digit,
or base64) and is read through a window of fixed length whose character counts change by one in and one out per step. Windows whose
entropy reaches the threshold of the class join to spans. Windows that overlap a part on the allow-list and spans inside a found
pattern are not added.
"""

from __future__ import annotations

import re
from itertools import accumulate
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwright.llm.texts import list_array, map_texts, spans_of

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Every match of ASSIGN holds one of these in lower case.
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")
VALUE_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16

WINDOW = 20
#: Bits per character that a window must reach, by class.
THRESHOLDS = {"hex": 3.0, "base64": 3.8, "letters": 3.8}
#: Parts of candidates that are no secrets: UUIDs, placeholders, runs up the alphabet, integrity digests of their length, media prefixes.
ALLOWED = tuple(
    re.compile(p)
    for p in (
        rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
        rb"(?i:example|placeholder|changeme|dummy|xxxx)",
        rb"(?i:0123456789|abcdefghij)",
        rb"(?i:sha256-[a-z0-9+/]{43}=?|sha384-[a-z0-9+/]{64}|sha512-[a-z0-9+/]{86}={0,2}|sha(?:256|384|512)-|base64)",
    )
)
_TERM = [0.0] + [n * log2(n) for n in range(1, WINDOW + 1)]


def _members(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_HEX = _members(b"0123456789abcdef")
_DIGIT = _members(b"0123456789")
_CANDIDATE = _members(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
_HEX_ANY = frozenset(b"0123456789abcdefABCDEF")


def high_entropy(candidate: bytes, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS, kind: str = "base64") -> list[tuple[int, int]]:
    """The parts of a candidate whose windows reach the threshold of its class, which is ``kind`` unless it is hex.

    No window overlaps a part on the allow-list; the rest of the candidate is read as usual.
    """
    n = len(candidate)
    kind = "hex" if _HEX_ANY.issuperset(candidate) else kind
    if n < window or (kind == "hex" and candidate.isdigit()):
        return []
    after = [0] * n  # end of the last allowed part that begins at a place or before it
    for a, b in [m.span() for p in ALLOWED for m in p.finditer(candidate)]:
        after[a] = max(after[a], b)
    after = list(accumulate(after, max))
    counts, total = [0] * 256, 0.0
    limit = window * (log2(window) - thresholds[kind])
    spans: list[tuple[int, int]] = []
    for k in range(n):
        c = candidate[k]
        total += _TERM[counts[c] + 1] - _TERM[counts[c]]
        counts[c] += 1
        if k + 1 >= window:
            start = k + 1 - window
            if total <= limit + 1e-9 and after[k] <= start:
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], k + 1)
                else:
                    spans.append((start, k + 1))
            c = candidate[start]
            total += _TERM[counts[c] - 1] - _TERM[counts[c]]
            counts[c] -= 1
    return spans


def find_spans(buf: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(text number, start, kind, end)`` of all spans in bytes of the whole buffer, in order."""
    found: list[tuple[int, int, int, int]] = []
    raw = buf.tobytes()
    lower = raw.lower()
    doc_of = lambda at: int(np.searchsorted(offs, at, "right")) - 1
    for pattern, kind, hints, where, group, least in ((ASSIGN, 0, ASSIGN_HINTS, lower, 1, VALUE_CHARS), (ACCESS, 1, (b"AKIA",), raw, 0, ACCESS_CHARS)):
        docs = set()
        for hint in hints:
            at = where.find(hint)
            while at >= 0:
                d = doc_of(at)
                docs.add(d)
                at = where.find(hint, int(offs[d + 1]))
        for d in docs:
            a, b = int(offs[d]), int(offs[d + 1])
            for m in pattern.finditer(raw[a:b]):
                if m.end(group) - m.start(group) >= least:
                    found.append((d, a + m.start(), kind, a + m.end()))
    starts, ends, _ = spans_of(_HEX[buf], offs)
    long = ends - starts >= HEX_CHARS
    found += [(doc_of(a), a, 2, b) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    # the furthest end of all base spans up to each beginning; a span of an earlier text ends before the next text begins
    base = np.array(sorted((a, b) for _, a, _, b in found), np.int64).reshape(-1, 2)
    reach = np.concatenate([[-1], np.maximum.accumulate(base[:, 1])])
    starts, ends, _ = spans_of(_CANDIDATE[buf], offs)
    long = ends - starts >= WINDOW
    starts, ends = starts[long], ends[long]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
    some = digits[ends] > digits[starts]
    extra = [
        (a + x, a + y)
        for a, b, digit in zip(starts.tolist(), ends.tolist(), some.tolist())
        for x, y in high_entropy(raw[a:b], kind="base64" if digit else "letters")
    ]
    if extra:
        begin, end = np.array(extra, np.int64).T
        new = reach[np.searchsorted(base[:, 0], begin, "right")] < end
        begin, end = begin[new], end[new]
        docs_of = np.searchsorted(offs, begin, "right") - 1
        found += [(d, a, 3, b) for d, a, b in zip(docs_of.tolist(), begin.tolist(), end.tolist())]
    return sorted(found)


SPAN = "kind string, start int, end int"


def _scan(buf, offs):
    found = find_spans(buf, offs)
    counts = np.bincount([f[0] for f in found], minlength=len(offs) - 1) if found else np.zeros(len(offs) - 1, np.int64)
    if found:
        chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        doc, start, kind, end = (np.array(x, np.int64) for x in zip(*found))
        at = chars[offs[doc]]
        parts = [pa.array(np.array(KINDS, object)[kind], pa.string()), pa.array((chars[start] - at).astype(np.int32)), pa.array((chars[end] - at).astype(np.int32))]
    else:
        parts = [pa.array([], pa.string()), pa.array([], pa.int32()), pa.array([], pa.int32())]
    return [list_array(pa.StructArray.from_arrays(parts, names=["kind", "start", "end"]), counts)]


def secret_spans(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``spans``, an array of ``(kind, start, end)`` in code points with an exclusive end, by start and kind.

    A null or empty text has no spans. Repeated rows give a row each.
    """
    return map_texts(docs, text, lambda: _scan, StructType.fromDDL(f"spans array<struct<{SPAN}>>"), keep)


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, *, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The same documents with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    A null text stays null. The column ``length``, where there is one, becomes the new number of characters of changed texts.
    """
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = names.index(text)

    def compute(buf, offs):
        found, raw = find_spans(buf, offs), buf.tobytes()
        pieces: dict[int, list[bytes]] = {}
        upto: dict[int, int] = {}
        for d, a, kind, b in found:
            if a >= upto.get(d, int(offs[d])):
                pieces.setdefault(d, []).append(raw[upto.get(d, int(offs[d])) : a] + b"[" + KINDS[kind].encode() + b"]")
            upto[d] = max(upto.get(d, 0), b)
        out: list[str | None] = [None] * (len(offs) - 1)
        for d, parts in pieces.items():
            out[d] = (b"".join(parts) + raw[upto[d] : int(offs[d + 1])]).decode()
        return [pa.array(out, pa.string())]

    changed = map_texts(inner, f"c{at}", lambda: compute, StructType.fromDDL("__new__ string"), tuple(inner.columns))
    kinds = dict(docs.dtypes)
    return changed.select(
        *[
            F.coalesce("__new__", f"c{i}").alias(c)
            if i == at
            else F.when(F.col("__new__").isNotNull(), F.length("__new__").cast(kinds[c])).otherwise(F.col(f"c{i}")).alias(c)
            if c == length
            else F.col(f"c{i}").alias(c)
            for i, c in enumerate(names)
        ]
    )


