"""Column profiles: counts, moments, sample values and frequent values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import QualityConfig
from plumbline.functions.columns import (
    RowKey, col, key_columns, key_struct, literal, quoted,
)
from plumbline.functions.counts import full_texts, value_counts
from plumbline.functions.longform import stack

# Rows looked at first when collecting sample values.
HEAD_ROWS = 1000


def base_profile(facts: DataFrame, distinct: DataFrame) -> DataFrame:
    """Missing and distinct counts with their share of all rows."""
    joined = facts.join(distinct, "column", "left")
    unique = F.coalesce("unique_count", F.lit(0))
    return joined.select(
        "column",
        "null_count",
        F.try_divide("null_count", "n_rows").alias("null_fraction"),
        unique.alias("unique_count"),
        F.try_divide(unique, F.col("n_rows")).alias("unique_fraction"),
    )


def number_profile(facts: DataFrame) -> DataFrame:
    """Mean, sample standard deviation and extremes of the columns with numbers."""
    return facts.filter("mean is not null").select("column", "mean", "std", "min_val", "max_val")


def most_frequent(seen: DataFrame, limit: int) -> DataFrame:
    """(column, rank, value, digest, n) from value counts: most frequent first, smaller value on ties.

    Long texts that begin alike come by digest; ``full_texts`` puts the smallest into their places.
    """
    order = [F.col("n").desc(), F.col("value"), F.col("digest")]
    rank = F.row_number().over(Window.partitionBy("column").orderBy(*order))
    return (
        seen.withColumn("rank", rank)
        .filter(F.col("rank") <= limit)
        .select("column", F.col("rank").cast("int").alias("rank"), "value", "digest", "n")
    )


def top_values(df: DataFrame, names: Sequence[str], limit: int) -> DataFrame:
    """(column, rank, value, n): most frequent texts of each column; a few rows a column."""
    rows = most_frequent(value_counts(df, names, "string"), limit).collect()
    whole = full_texts(df, rows)
    return df.sparkSession.createDataFrame(
        [(r["column"], r["rank"], whole.get((r["column"], r["digest"]), r["value"]), r["n"]) for r in rows],
        "column string, rank int, value string, n long",
    )


def _first_values(df: DataFrame, row_key: RowKey, names: Sequence[str], limit: int) -> DataFrame:
    entries = [f"{literal(c)}, cast({quoted(c)} as string)" for c in names]
    rank = F.row_number().over(Window.partitionBy("column").orderBy("__key"))
    return (
        stack(df, entries, ["column", "value"], [key_struct(row_key).alias("__key")])
        .filter("value is not null")
        .withColumn("rank", rank)
        .filter(F.col("rank") <= limit)
        .select("column", F.col("rank").cast("int").alias("rank"), "value")
    )


def sample_values(
    df: DataFrame, row_key: RowKey, present: dict[str, int], config: QualityConfig
) -> DataFrame:
    """(column, rank, value): the first present values of each column in row order.

    Nearly every column shows them within the first rows of the table, which
    one top-k scan finds; only columns sparser than that get a scan of their
    own. ``present`` maps column to its number of present values.
    """
    limit = config.sample_values
    order = [col(k) for k in key_columns(row_key)]
    names = list(present)
    wanted = [quoted(c) for c in dict.fromkeys([*key_columns(row_key), *names])]
    head = df.select(*wanted).orderBy(*order).limit(HEAD_ROWS)
    found = _first_values(head, row_key, names, limit).collect()
    per_column: dict[str, int] = {}
    for row in found:
        per_column[row["column"]] = per_column.get(row["column"], 0) + 1
    short = [c for c in names if per_column.get(c, 0) < min(limit, present[c])]
    schema = "column string, rank int, value string"
    complete = [r for r in found if r["column"] not in set(short)]
    result = df.sparkSession.createDataFrame(complete, schema)
    rest = [
        _first_values(
            df.filter(col(c).isNotNull()).orderBy(*order).limit(limit), row_key, [c], limit
        )
        for c in short
    ]
    return reduce(DataFrame.unionByName, rest, result)
