"""Scalar expressions: number parsing, bands, clipping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text accepted as a number. Spark's own cast also takes "1d" and "1f", so the
# text is tested first. The same pattern works in RE2-based engines.
NUMBER_PATTERN = (
    r"^\s*[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
    r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
)


def parse_number(text: Column) -> Column:
    """Text to double, null where the text is not a number."""
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def not_a_number(text: Column) -> Column:
    """True where a value is present and is not a number."""
    return text.isNotNull() & ~F.coalesce(text.rlike(NUMBER_PATTERN), F.lit(False))


def bands(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bands; the first also holds its lower edge; null outside."""
    if len(labels) != len(edges) - 1:
        raise ValueError("bands need one label less than edges")
    first = (value >= edges[0]) & (value <= edges[1])
    ladder = F.when(first, F.lit(labels[0]))
    for low, high, label in zip(edges[1:-1], edges[2:], labels[1:]):
        ladder = ladder.when((value > low) & (value <= high), F.lit(label))
    return ladder


def clip(value: Column, low: float, high: float) -> Column:
    """Limit a number to [low, high]; null and NaN become null, as neither is a value."""
    present = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return F.when(present.isNotNull(), F.least(F.greatest(present, F.lit(low)), F.lit(high)))


def percent_text(fraction: Column) -> Column:
    """0.123 as '12.3%'."""
    return F.format_string("%.1f%%", fraction * 100)
