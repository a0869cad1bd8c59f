"""Outlier scores from one histogram a column: linear in rows and columns, no neighbours needed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.functions.longform import stack
from plumbline.functions.quantiles import EXACT_CELLS, EXACT_ROWS

BINS = 10


def _value(name: str) -> Column:
    return F.nanvl(col(name).cast("double"), F.lit(None))


def bin_edges(df: DataFrame, names: Sequence[str], bins: int = BINS, rows: int | None = None) -> dict[str, list[float]]:
    """Distinct edges of bins of equal counts, from one scan; none for a column without values.

    Up to EXACT_ROWS rows (and EXACT_CELLS values) the percentiles are exact and interpolated,
    beyond that sketches of a hundredth of a bin; edges only say where bins meet, their counts are
    always exact.
    """
    shares = [i / bins for i in range(bins + 1)]
    rows = df.count() if rows is None else rows
    exact = rows <= EXACT_ROWS and rows * len(names) <= EXACT_CELLS
    picks = [
        (F.percentile(_value(c), F.lit(shares)) if exact
         else F.percentile_approx(_value(c), F.lit(shares), 100 * bins)).alias(f"e{i}")
        for i, c in enumerate(names)
    ]
    row = df.agg(*picks).first()
    return {c: sorted(set(row[f"e{i}"] or [])) for i, c in enumerate(names)}


def _bin(value: Column, edges: Sequence[float]) -> Column:
    """Number of the bin; the last one takes its upper edge."""
    return reduce(lambda a, e: a + (value >= F.lit(e)).cast("int"), edges[1:-1], F.lit(0))


def densities(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> dict[str, list[float]]:
    """Rows a unit of width in every bin, as a share of the column's densest one. One scan.

    A column of one value has one bin. The result holds at most columns x bins numbers.
    """
    names = [c for c, e in edges.items() if e]
    if not names:
        return {}
    entries = [[F.lit(i), F.when(_value(c).isNotNull(), _bin(_value(c), edges[c]))] for i, c in enumerate(names)]
    counted = stack(df, entries, ["number", "bin"]).filter("bin IS NOT NULL").groupBy("number", "bin").count()
    found: dict[str, list[float]] = {c: [0.0] * max(len(edges[c]) - 1, 1) for c in names}
    for r in counted.collect():
        name = names[r["number"]]
        low, high = edges[name][r["bin"]], edges[name][min(r["bin"] + 1, len(edges[name]) - 1)]
        found[name][r["bin"]] = r["count"] / (high - low if high > low else 1.0)
    return {c: [d / max(ds) for d in ds] for c, ds in found.items()}


def histogram_scores(df: DataFrame, names: Sequence[str], bins: int = BINS) -> DataFrame:
    """Add ``histogram_score``: the sum over columns of minus the log of the value's relative density.

    0 is a row of most usual values; a missing value adds nothing. Two scans measure, the third scores.
    """
    edges = bin_edges(df, names, bins)
    dense = densities(df, edges)
    parts = []
    for name, levels in dense.items():
        surprise = F.array(*[-F.log(F.lit(d)) if d > 0 else F.lit(0.0) for d in levels])
        part = F.get(surprise, _bin(_value(name), edges[name]))
        parts.append(F.when(_value(name).isNotNull(), part).otherwise(0.0))
    return df.withColumn("histogram_score", reduce(lambda a, b: a + b, parts, F.lit(0.0)))
