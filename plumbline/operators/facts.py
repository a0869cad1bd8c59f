"""Per-column measurements taken in as few scans as possible."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import QualityConfig
from plumbline.functions.columns import col, literal, numeric_columns, quoted
from plumbline.functions.longform import stack
from plumbline.functions.values import not_a_number


def named(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add ``column`` for the integer ``position`` that measurements are grouped by."""
    column = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("position") + 1)
    return df.withColumn("column", column)


def _double(value: float | None) -> str:
    return "cast(null as double)" if value is None else f"cast('{float(value)!r}' as double)"


def column_facts(df: DataFrame, names: Sequence[str], config: QualityConfig) -> DataFrame:
    """One row per column from one scan: missing cells, moments and values out of range.

    Columns without numbers have null moments.
    """
    numeric = set(numeric_columns(df, names))
    entries = []
    for position, name in enumerate(names):
        cell = quoted(name)
        value = f"cast({cell} as double)" if name in numeric else "cast(null as double)"
        low, high = config.ranges.get(name, (None, None)) if name in numeric else (None, None)
        entries.append(f"{position}, {value}, {cell} is null, {_double(low)}, {_double(high)}")
    measured = (
        stack(df, entries, ["position", "value", "missing", "low", "high"])
        .groupBy("position")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if("missing").alias("null_count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min_val"),
            F.max("value").alias("max_val"),
            F.count_if(F.col("value") < F.col("low")).alias("below"),
            F.count_if(F.col("value") > F.col("high")).alias("above"),
        )
    )
    return named(measured, names)


def text_facts(seen: DataFrame) -> DataFrame:
    """(column, unique_count, unparsable) from text value counts.

    Each distinct value is parsed once, however often it occurs.
    """
    strange = F.coalesce(F.col("unparsable"), not_a_number(F.col("value")))
    bad = F.when(strange, F.col("n")).otherwise(0)
    return seen.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"), F.sum(bad).alias("unparsable")
    )


def missing_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, n_rows, null_count) in one scan."""
    entries = [f"{literal(c)}, {quoted(c)} is null" for c in names]
    return (
        stack(df, entries, ["column", "missing"])
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("missing").alias("null_count"))
    )


def drop_empty_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop those of ``names`` that hold no value at all."""
    if not names:
        return df
    probe = df.agg(*[F.bool_or(col(c).isNotNull()).alias(f"c{i}") for i, c in enumerate(names)])
    row = probe.first()
    empty = {c for i, c in enumerate(names) if not row[f"c{i}"]}
    return df.select(*[col(c) for c in df.columns if c not in empty])


def moments(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """Mean and sample standard deviation of each column."""
    if not names:
        return {}
    entries = [f"{literal(c)}, cast({quoted(c)} as double)" for c in names]
    rows = (
        stack(df, entries, ["column", "value"])
        .groupBy("column")
        .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
        .collect()
    )
    found = {r["column"]: (r["mean"], r["std"]) for r in rows}
    return {c: found.get(c, (None, None)) for c in names}


def z_score(name: str, mean: float, std: float) -> Column:
    return (col(name).cast("double") - F.lit(mean)) / F.lit(std)


def scorable(facts: Sequence, config: QualityConfig) -> list[tuple[str, float, float]]:
    """(column, mean, std) of columns with enough values and some spread."""
    return [
        (f["column"], f["mean"], f["std"])
        for f in facts
        # Infinite values leave no usable spread.
        if f["std"] and math.isfinite(f["std"])
        and f["n_rows"] - f["null_count"] >= config.outlier_min_values
    ]


def outlier_counts(df: DataFrame, facts: Sequence, config: QualityConfig) -> DataFrame:
    """(column, outliers) for |z| above the threshold; second scan, no join."""
    scored = scorable(facts, config)
    if not scored:
        return df.sparkSession.createDataFrame([], "column string, outliers bigint")
    limit = _double(config.outlier_zscore_threshold)
    entries = [
        f"{i}, abs((cast({quoted(c)} as double) - {_double(m)}) / {_double(s)}) > {limit}"
        for i, (c, m, s) in enumerate(scored)
    ]
    found = (
        stack(df, entries, ["position", "hit"])
        .groupBy("position")
        .agg(F.count_if("hit").alias("outliers"))
    )
    return named(found, [c for c, _, _ in scored]).select("column", "outliers")
