"""Exact medians and percentiles of columns of any size.

``percentile`` keeps every distinct value of a group in one buffer. That is
fine for a checked number of rows; beyond it the wanted rank is bracketed with
``percentile_approx`` (bounded buffer), the rows below and inside the bracket
are counted exactly, and the bracket is narrowed until what is left is small
enough to sort. Each step is one scan with a one-row aggregate; no rows are
shuffled. The rank is always taken from exact counts, so the result does not
depend on how good the approximation was.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col

EXACT_ROWS = 2_000_000
# Present values of all columns that one such aggregate takes together.
EXACT_CELLS = 8_000_000
BRACKET_ROWS = 10_000
ACCURACY = 10_000


@dataclass
class _Search:
    """Search for the value at a zero-based rank of one column."""

    value: Column
    rank: int
    low: float | None = None
    high: float | None = None
    low_count: int = 0
    inside: int = 0
    found: float | None = None

    def within(self) -> Column:
        if self.low is None:
            return self.value.isNotNull()
        return (self.value >= F.lit(self.low)) & (self.value <= F.lit(self.high))


def _narrow(df: DataFrame, searches: list[_Search]) -> None:
    """One scan: propose a tighter bracket for every open search."""
    proposals = []
    for i, s in enumerate(searches):
        place = (s.rank - s.low_count) / max(s.inside - 1, 1)
        margin = 2.0 / ACCURACY
        wanted = [max(0.0, place - margin), min(1.0, place + margin)]
        inside = F.when(s.within(), s.value)
        proposals.append(F.percentile_approx(inside, wanted, ACCURACY).alias(f"p{i}"))
        proposals.append(F.min(inside).alias(f"a{i}"))
        proposals.append(F.max(inside).alias(f"z{i}"))
    row = df.agg(*proposals).first()

    counts = []
    for i, s in enumerate(searches):
        low, high = row[f"p{i}"]
        counts.append(F.count_if(s.value < F.lit(row[f"a{i}"])).alias(f"o{i}"))
        counts.append(F.count_if(s.value < F.lit(low)).alias(f"b{i}"))
        counts.append(F.count_if(s.value == F.lit(low)).alias(f"l{i}"))
        counts.append(F.count_if((s.value > F.lit(low)) & (s.value < F.lit(high))).alias(f"m{i}"))
        counts.append(F.count_if(s.value == F.lit(high)).alias(f"h{i}"))
        counts.append(F.min(F.when(s.value > F.lit(low), s.value)).alias(f"n{i}"))
        counts.append(F.max(F.when(s.value < F.lit(high), s.value)).alias(f"x{i}"))
    tally = df.agg(*counts).first()

    for i, s in enumerate(searches):
        low, high = row[f"p{i}"]
        first, last = row[f"a{i}"], row[f"z{i}"]
        below, at_low = tally[f"b{i}"], tally[f"l{i}"]
        middle, at_high = tally[f"m{i}"], tally[f"h{i}"] if high > low else 0
        if s.rank < below:
            # Bracket missed on the low side: keep the values under it.
            bottom = tally[f"o{i}"]
            s.low, s.high, s.low_count = first, _previous(low), bottom
            s.inside = below - bottom
        elif s.rank < below + at_low:
            s.found = low
        elif s.rank < below + at_low + middle:
            s.low, s.high = tally[f"n{i}"], tally[f"x{i}"]
            s.low_count, s.inside = below + at_low, middle
        elif s.rank < below + at_low + middle + at_high:
            s.found = high
        else:
            passed = below + at_low + middle + at_high
            s.inside = s.low_count + s.inside - passed
            s.low, s.high, s.low_count = _next(high), last, passed


def _next(value: float) -> float:
    return math.nextafter(value, math.inf)


def _previous(value: float) -> float:
    return math.nextafter(value, -math.inf)


def _finish(df: DataFrame, searches: list[_Search]) -> None:
    """Sort what is left of each bracket; its size was counted before."""
    picks = [
        F.element_at(
            F.array_sort(F.collect_list(F.when(s.within(), s.value))), s.rank - s.low_count + 1
        ).alias(f"v{i}")
        for i, s in enumerate(searches)
    ]
    row = df.agg(*picks).first()
    for i, s in enumerate(searches):
        s.found = row[f"v{i}"]


def _select_ranks(df: DataFrame, searches: list[_Search]) -> None:
    while True:
        open_ = [s for s in searches if s.found is None]
        if not open_:
            return
        small = [s for s in open_ if s.inside <= BRACKET_ROWS]
        if small:
            _finish(df, small)
        large = [s for s in open_ if s.inside > BRACKET_ROWS]
        if large:
            _narrow(df, large)


def percentiles(
    df: DataFrame,
    names: Sequence[str],
    fraction: float = 0.5,
    exact_rows: int = EXACT_ROWS,
    exact_cells: int = EXACT_CELLS,
    sizes: dict[str, int] | None = None,
) -> dict[str, float | None]:
    """Percentile of each column over its present values, interpolated linearly.

    ``sizes`` may pass known counts of present values and saves the first scan.
    """
    names = list(names)
    if not names:
        return {}
    value = {c: F.nanvl(col(c).cast("double"), F.lit(None)) for c in names}
    if sizes is None:
        row = df.agg(*[F.count(value[c]).alias(f"n{i}") for i, c in enumerate(names)]).first()
        sizes = {c: row[f"n{i}"] for i, c in enumerate(names)}

    result: dict[str, float | None] = {c: None for c in names}
    small = [c for c in names if 0 < sizes[c] <= exact_rows]
    while small:
        # The aggregate's one final task holds every distinct value of its columns.
        batch, held = [], 0
        while small and (not batch or held + sizes[small[0]] <= exact_cells):
            held += sizes[small[0]]
            batch.append(small.pop(0))
        row = df.agg(
            *[F.percentile(value[c], fraction).alias(f"q{i}") for i, c in enumerate(batch)]
        ).first()
        result.update({c: row[f"q{i}"] for i, c in enumerate(batch)})

    searches, parts = [], {}
    for c in names:
        if sizes[c] <= exact_rows:
            continue
        place = fraction * (sizes[c] - 1)
        pair = [
            _Search(value[c], rank, inside=sizes[c])
            for rank in (math.floor(place), math.ceil(place))
        ]
        parts[c] = (pair, place - math.floor(place))
        searches.extend(pair)
    if searches:
        _select_ranks(df, searches)
    for c, ((lower, upper), weight) in parts.items():
        result[c] = lower.found + (upper.found - lower.found) * weight
    return result


def medians(df: DataFrame, names: Sequence[str], **options) -> dict[str, float | None]:
    """Median of each column over its present values, None where there is none."""
    return percentiles(df, names, 0.5, **options)
