"""Secret scan with multipart credentials.

Base findings come from three patterns. Parts of a credential that are too weak alone are reported only when parts that
complete each other meet: a secret value with an access identifier or a service endpoint, in one scope, which is a stretch
of ``scope`` characters without an empty line. Parts are joined by interval: each part finds, by binary search on the sorted
places of the other kinds, those that lie within its scope.

Null text is empty text and has no findings. Repeated rows are scanned each by itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from tallybeam.llm.shared import batches_of, text_or_empty

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more; runs are maximal, so shorter ones never match
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

# Kinds in the order in which spans with one start are listed.
BASE_KINDS = ("assign", "access", "hex")
PART_KINDS = ("identifier", "value", "endpoint")
ORDER = {kind: k for k, kind in enumerate(BASE_KINDS + PART_KINDS)}

# Weak parts: a name for an account, a value that could be a key, a place where it would be used.
WEAK = {
    "identifier": re.compile(
        r"""(?:access_?key(?:_?id)?|client_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""",
        re.ASCII | re.IGNORECASE,
    ),
    "value": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])([A-Za-z0-9+/_-]{16,}={0,2})(?![A-Za-z0-9+/_=-])", re.ASCII),
    "endpoint": re.compile(r"((?:https?|jdbc|s3|ftp|amqp|redis|postgres(?:ql)?|mysql|mongodb)(?:\+\w+)?://[^\s\"'<>]{4,})", re.ASCII),
}
BREAK = re.compile(r"\n[ \t\r]*\n")
SCOPE = 400

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _near(places: list[int], spans: list[Span], span: Span, scope: int, breaks: list[int]) -> bool:
    """Whether one of ``spans``, sorted by ``places``, lies in a scope with ``span`` and apart from it."""
    for k in range(bisect_left(places, span[2] - scope), len(spans)):
        other = spans[k]
        if other[1] - span[1] > scope:
            return False
        low, high = min(span[1], other[1]), max(span[2], other[2])
        apart = other[2] <= span[1] or span[2] <= other[1]
        if apart and high - low <= scope and bisect_left(breaks, low) == bisect_left(breaks, high):
            return True
    return False


def linked_parts(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak parts that a part of a complementing kind, weak or strong, joins within the scope."""
    weak = {kind: [(kind, m.start(1), m.end(1)) for m in pattern.finditer(text)] for kind, pattern in WEAK.items()}
    covered = sorted((s, e) for _, s, e in base)
    starts, furthest = [s for s, _ in covered], list(accumulate((e for _, e in covered), max))

    def free(span: Span) -> bool:
        at = bisect_left(starts, span[2])
        return not at or furthest[at - 1] <= span[1]

    weak = {kind: [s for s in spans if free(s)] for kind, spans in weak.items()}
    # Strong findings are parts too: an access key identifies, an assigned or hex value is a secret.
    parts = {
        "identifier": sorted([*weak["identifier"], *(s for s in base if s[0] == "access")], key=lambda s: s[1]),
        "value": sorted([*weak["value"], *(s for s in base if s[0] != "access")], key=lambda s: s[1]),
        "endpoint": weak["endpoint"],
    }
    if sum(bool(spans) for spans in parts.values()) < 2 or not any(weak.values()):
        return []
    breaks = [m.start() for m in BREAK.finditer(text)]
    places = {kind: [s[1] for s in spans] for kind, spans in parts.items()}
    found = []
    for kind, spans in weak.items():
        needed = ("value",) if kind != "value" else ("identifier", "endpoint")
        for span in spans:
            if any(_near(places[other], parts[other], span, scope, breaks) for other in needed):
                found.append(span)
    return found


def listed(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans as ``kind:start:end``."""

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows):
            out: list[list] = [[] for _ in range(5)]
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                spans = base + linked_parts(text, base, scope)
                for k, kind in enumerate(BASE_KINDS):
                    out[k].append(sum(s[0] == kind for s in base))
                out[3].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out[4].append(listed(spans))
            columns = [pa.array(v, pa.int64() if k < 3 else pa.string()) for k, v in enumerate(out)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(scan, SCHEMA)


def redacted(docs: DataFrame, scope: int = SCOPE, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark``; a null text stays null, the columns stay."""
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        out, done = [], 0
        for _, start, end in sorted(base + linked_parts(text, base, scope), key=lambda s: s[1:]):
            if start >= done:
                out += [text[done:start], mark]
            done = max(done, end)
        return "".join([*out, text[done:]])

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows):
            texts = pa.array([clean(t) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(scan, docs.schema)
