"""Secret scans: three base patterns, and windows of high Shannon entropy over candidate strings.

A candidate is a run of key characters.  A window slides over it; counts of its
characters change by one in and one out, and the entropy follows from a table of
c*log2(c).  The class of the candidate (hex digits, letters alone, or mixed)
sets alphabet and threshold; windows over it merge into a span.  Allow-listed
candidates (identifiers, numbers, plain words, repeated units) give no span.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

# The base patterns.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Bits a character that a window of a class must reach.
THRESHOLDS = {"hex": 3.0, "letters": 3.6, "mixed": 3.6}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Candidates that are no secrets: one case of letters with separators, numbers, UUIDs, a unit repeated, paths, CamelCase.
ALLOW = [
    re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_/+=]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[-_/+=]*\Z"),
    re.compile(r"[0-9+/_=-]+\Z"),
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z"),
    re.compile(r"(.{1,4})\1+.{0,3}\Z"),
    re.compile(r"(?![A-Za-z]+\Z)/?[A-Za-z]+(?:/[A-Za-z]+)*[0-9]{0,4}/?\Z"),
    re.compile(r"(?:[a-z]{2,}|[A-Z]{2,5}(?=[A-Z][a-z]))?(?:[A-Z][a-z]{2,}|[A-Z]{2,5}(?=[A-Z][a-z]|\Z))+\Z"),
]
_CLOG = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]


def entropy_spans(candidate: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows whose entropy reaches the class's threshold."""
    if len(candidate) < window or any(a.match(candidate) for a in ALLOW):
        return []
    kind = "hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate) else "letters" if candidate.isalpha() else "mixed"
    least = window * (math.log2(window) - THRESHOLDS[kind])  # sum of c*log2(c) must not exceed this
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, ch in enumerate(candidate):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += _CLOG[c + 1] - _CLOG[c]
        if i >= window:
            gone = candidate[i - window]
            c = counts[gone]
            counts[gone] = c - 1
            total += _CLOG[c - 1] - _CLOG[c]
        if i >= window - 1 and total <= least + 1e-9:
            a, b = i - window + 1, i + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind in the order of KINDS."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        out += [("entropy", m.start() + a, m.start() + b) for a, b in entropy_spans(m[0])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            found = [scan(t or "") for t in part.column(1).to_pylist()]
            base = [_joined([s for s in f if s[0] != "entropy"]) for f in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array([sum(s[0] == kind for s in f) for f in found], pa.int64()) for kind in KINDS], pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array([_joined(f) for f in found])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"],
            )


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of each kind, digest of base spans, and all spans.

    Null and empty texts have none, repeated rows repeat, an empty table gives no rows, a text of any length is scanned
    whole, and other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")
