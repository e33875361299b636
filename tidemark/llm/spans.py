"""Which spans of a text meet others: sorted once, each question by bisection."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from itertools import accumulate


class Spans:
    """(start, end) spans, ends exclusive; they may overlap."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        ordered = sorted(spans)
        self._starts = [s for s, _ in ordered]
        self._furthest = list(accumulate((e for _, e in ordered), max))

    def overlap(self, start: int, end: int) -> bool:
        """Does a span share a place with this one?"""
        before = bisect_left(self._starts, end)
        return before > 0 and self._furthest[before - 1] > start

    def cover(self, start: int, end: int) -> bool:
        """Does this one lie within a span?"""
        before = bisect_right(self._starts, start)
        return before > 0 and self._furthest[before - 1] >= end
