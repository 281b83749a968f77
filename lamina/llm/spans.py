"""Spans of text as the detectors of secrets and personal data report them."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate

#: (start, rank of the kind, kind, end), so that sorting gives the order of a report.
Span = tuple[int, int, str, int]


def report(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(report(spans).encode()).hexdigest()


def beside(new: list[Span], base: list[Span]) -> list[Span]:
    """Those of ``new`` that overlap none of ``base``. Spans are not empty."""
    if not base:
        return new
    starts, reach = zip(*sorted((s, e) for s, _, _, e in base), strict=True)
    reach = list(accumulate(reach, max))  # how far any span up to this one goes
    return [x for x in new if not (k := bisect_left(starts, x[3])) or reach[k - 1] <= x[0]]
