"""Secret scans: keyword, access-key and hex patterns, and a sliding-window entropy scan over candidate strings.

The entropy scan takes every run of token characters that holds a digit and a letter, classes it by alphabet (hex,
alphanumeric, base64) and moves a window of `window` characters over it. Counts of the characters in the window change
by one in and one out per step, and so does the sum of n*log2(n); the entropy follows from that sum. Windows at or above
the class's threshold are joined to spans. Allow-listed candidates are suppressed.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from quernel.llm.shared import in_slices

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, as [0-9a-f]+ gives it, of 24 or more
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGIT, _LETTER, _NOT_HEX, _NOT_ALNUM = (re.compile(x) for x in ("[0-9]", "[A-Za-z]", "[^0-9A-Fa-f]", "[^A-Za-z0-9]"))
#: Strings of fixed public form that are no secrets.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),  # UUIDs
    re.compile(r"(?i).*(?:example|placeholder|changeme|dummy|your[-_]?(?:key|token|secret)).*"),
    re.compile(r"(?i)(?:sha(?:1|256|384|512)|md5)[-=].*"),  # integrity digests
    re.compile(r"[A-Z]?[a-z]+(?:[-_/=+]?[A-Z][a-z]+|[-_/=+][a-z]+)*(?:[-_/=+]?[0-9]{1,4})?"),  # words, humps and numbered names
    re.compile(r"(?:[A-Za-z]{0,12}[0-9]{0,4}[-_/=+]){3,}[A-Za-z]{0,12}[0-9]{0,4}"),  # paths, versions, names of constants
    re.compile(r"[0-9]+(?:[-/_=+][0-9]+)*"),  # dates and numbers
)


@dataclass(frozen=True)
class Params:
    window: int = 20
    thresholds: dict = field(default_factory=lambda: {"hex": 3.0, "alnum": 3.55, "base64": 3.7})  #: bits a character
    allowed: tuple = ALLOWED


def char_class(s: str) -> str:
    return "hex" if not _NOT_HEX.search(s) else "alnum" if not _NOT_ALNUM.search(s) else "base64"


def hot_spans(s: str, window: int, least: float) -> list[tuple[int, int]]:
    """Maximal unions of windows whose entropy is at least `least`; s shorter than a window is one window."""
    w = min(window, len(s))
    if not w:
        return []
    # entropy = log2(w) - sum(n*log2(n))/w, so a window is hot when the sum is at most this
    most = w * (math.log2(w) - least) + 1e-9
    xlog = [0.0, *(n * math.log2(n) for n in range(1, w + 1))]
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += xlog[n + 1] - xlog[n]
        if i >= w:
            out = s[i - w]
            n = counts[out]
            counts[out] = n - 1
            total += xlog[n - 1] - xlog[n]
        if i >= w - 1 and total <= most:
            start = i - w + 1
            if spans and start <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([start, i + 1])
    return [tuple(x) for x in spans]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping within a kind, in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def entropy_spans(text: str, p: Params) -> list[tuple[int, int, int]]:
    found = []
    for m in _CANDIDATE.finditer(text):
        s = m.group()
        if not (_DIGIT.search(s) and _LETTER.search(s)) or any(a.fullmatch(s) for a in p.allowed):
            continue
        found += [(m.start() + a, 3, m.start() + b) for a, b in hot_spans(s, p.window, p.thresholds[char_class(s)])]
    return found


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_text(text: str | None, p: Params = Params()) -> tuple[int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    n = [0, 0, 0]
    for _, k, _ in base:
        n[k] += 1
    return *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + entropy_spans(text, p)))


def scan_secrets(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs, over whole texts.

    Null text counts as empty: no spans, and the digest of the empty string; an empty table gives an empty one. Spans
    that start together come in the order of their kinds. A very long text or candidate costs in proportion to its length.
    Repeated rows give repeated rows; other columns are ignored. Offsets are code points, ends exclusive.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]

    def run(batches):
        for b in in_slices(batches):
            cols = list(zip(*(scan_text(t, params) for t in b.column(1).to_pylist()), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, t) in zip(cols, types, strict=True))], names=["doc_id", *(n for n, _ in types)])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
