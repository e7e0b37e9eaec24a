"""Secret scan: three literal patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of token characters that mixes character classes.  A window slides over it; the
counts of its characters, and from them its entropy, change by one character in and one out.  The
candidate becomes a span if a window's entropy reaches the threshold of its class (hex or base64),
unless an allow-list pattern takes it.  Where spans of the literal patterns cut a run, what lies between
them are candidates of their own.

Every text is scanned whole.  Defined results: a null or empty text has no spans; rows are judged one
by one, so ties, repeated rows and null doc_ids change nothing; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs that are long enough
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a character; a window of 20 characters has 4.32 at most.
THRESHOLDS = {"hex": 3.2, "base64": 3.9}
#: Never secrets: words joined by signs, numbers and dates, UUIDs, and what documentation shows.
_ALLOWED_EXACT = re.compile(r"[A-Z]?[a-z]+([-_/=+][A-Z]?[a-z]+)*$|[A-Z]+([-_/=+][A-Z]+)*$|[0-9-]+$|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_ALLOWED_WORDS = re.compile(r"example|sample|placeholder|changeme|xxxx", re.I)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


@cache
def _c_log_c(width: int) -> list[float]:
    """c log2 c for the counts of a window, which has one character more while one goes in and one out."""
    return [0.0] + [c * log2(c) for c in range(1, width + 2)]


def max_entropy(s: str, width: int = WINDOW) -> float:
    """The largest entropy of a window of ``s``: log2(width) - sum(c log2 c) / width, updated by differences."""
    weight = _c_log_c(width)
    counts: dict[str, int] = {}
    total, least = 0.0, float("inf")
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += weight[n + 1] - weight[n]
        if i >= width:
            out = s[i - width]
            n = counts[out]
            counts[out] = n - 1
            total += weight[n - 1] - weight[n]
        if i >= width - 1:
            least = min(least, total)
    return log2(width) - least / width if least < float("inf") else 0.0


def allowed(s: str) -> bool:
    return bool(_ALLOWED_EXACT.match(s) or _ALLOWED_WORDS.search(s))


def _outside(a: int, b: int, begins: list[int], ends: list[int]) -> Iterator[tuple[int, int]]:
    """The parts of [a, b) outside merged, ascending spans."""
    for i in range(bisect_right(ends, a), len(begins)):
        if begins[i] >= b:
            break
        yield a, begins[i]
        a = ends[i]
    yield a, b


def entropy_spans(text: str, taken: list[Span]) -> list[Span]:
    begins: list[int] = []
    ends: list[int] = []
    for _, x, y in sorted(taken, key=lambda s: s[1]):
        if ends and x <= ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            begins.append(x)
            ends.append(y)
    found = []
    for m in CANDIDATE.finditer(text):
        for a, b in _outside(m.start(), m.end(), begins, ends):
            s = text[a:b]
            if b - a < WINDOW or allowed(s):
                continue
            kind = "hex" if re.fullmatch(r"[0-9a-fA-F]+", s) else "base64"
            if max_entropy(s) >= THRESHOLDS[kind]:
                found.append(("entropy", a, b))
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base_spans and method_spans: arrays of (kind, start, end) in code points."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                base, more = [], []
                for text in part.column("text").to_pylist():
                    b = sorted(base_spans(text or ""), key=lambda s: (s[1], KINDS.index(s[0])))
                    base.append(b)
                    more.append(entropy_spans(text or "", b))
                arrays = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], pa.list_(span)) for spans in (base, more)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", "base_spans", "method_spans"])

    spans = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, base_spans {spans}, method_spans {spans}")


def digest(scanned: DataFrame) -> DataFrame:
    order = f"(a, b) -> CASE WHEN a.start <> b.start THEN int(sign(a.start - b.start)) ELSE int(sign(array_position(array({', '.join(map(repr, KINDS))}), a.kind) - array_position(array({', '.join(map(repr, KINDS))}), b.kind))) END"
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    n = "size(filter(base_spans, s -> s.kind = '{0}')) + 0L AS n_{0}"
    return scanned.selectExpr(
        "doc_id", *[n.format(k) for k in KINDS[:3]],
        f"sha2({joined.format('base_spans')}, 256) AS base_sha256",
        joined.format(f"array_sort(concat(base_spans, method_spans), {order})") + " AS spans",
    )

