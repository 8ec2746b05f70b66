"""Secret scans by multipart credential linking.

Strong candidates are reported as they stand: assignments, access identifiers and long hexadecimal runs. Parts that prove
nothing alone (a key of 32 characters or more, an endpoint, a user name) are weak: in each scope, a paragraph, an interval join pairs
identifiers, secrets and endpoints that stand within ``REACH`` code points of one another, and a weak candidate is reported
only where a complementary part stands beside it. All of it happens where a text is read; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

# Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEY = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{32,}(?![A-Za-z0-9+/])")
ENDPOINT = re.compile(r"(?:https?|s3|postgres|mysql|mongodb)://[A-Za-z0-9.:/_@-]{4,}")
USER = re.compile(r"(?:user|username|login|account|client_id)\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}", re.ASCII | re.IGNORECASE)

KINDS = ("assign", "access", "hex", "key", "endpoint", "user")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "key": "secret", "endpoint": "endpoint", "user": "identifier"}
REACH = 400

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind), by start and then kind; strong candidates alone."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: Span):
    return span[0], KINDS.index(span[2]), span[1]


def weak_spans(text: str) -> list[Span]:
    mixed = lambda x: any(map(str.isdigit, x)) and any(map(str.isupper, x)) and any(map(str.islower, x))
    found = [(m.start(), m.end(), "key") for m in KEY.finditer(text) if mixed(m[0])]
    if "://" in text:
        found += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "user") for m in USER.finditer(text)]
    return found


def linked(text: str, base: list[Span], weak: list[Span]) -> list[Span]:
    """The weak spans that a span of another role stands within REACH of, in the same paragraph, one of them a secret.

    Of the spans of a role that start before a weak span's reach ends, the one that ends last tells whether any is near,
    so the join takes one search for each weak span, however many or long the spans are.
    """
    if not weak:
        return []
    breaks = [m.start() for m in re.finditer(r"\n[\x20\t]*\n", text)]
    sides: dict[tuple[int, bool], tuple[list[int], list[int]]] = {}
    for s, e, kind in sorted([*base, *weak], key=_order):
        starts, ends = sides.setdefault((bisect_left(breaks, s), ROLE[kind] == "secret"), ([], []))
        starts.append(s)
        ends.append(max(e, ends[-1]) if ends else e)
    out = []
    for s, e, kind in weak:
        starts, ends = sides.get((bisect_left(breaks, s), ROLE[kind] != "secret"), ((), ()))
        k = bisect_right(starts, e + REACH)
        if k and ends[k - 1] + REACH >= s:
            out.append((s, e, kind))
    return out


def _written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def scan(text: str) -> tuple[int, int, int, str, str]:
    base = base_spans(text)
    every = sorted([*base, *linked(text, base, weak_spans(text))], key=_order)
    n = {k: sum(x[2] == k for x in base) for k in KINDS[:3]}
    return n["assign"], n["access"], n["hex"], hashlib.sha256(_written(base).encode()).hexdigest(), _written(every)


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind. Null and empty texts have none: the
    hash is that of the empty string. Repeated rows give repeated results; an empty table gives an empty result; other
    columns are ignored.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], pa.int64() if k < 3 else pa.string()) for k in range(5))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
