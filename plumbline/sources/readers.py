"""Read tables; CSV gets its missing markers and types the way a pandas reader would give them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import DEFAULT_NA_TEXT, MISSING_INDICATORS
from plumbline.functions.columns import col
from plumbline.functions.longform import stack
from plumbline.functions.values import NUMBER_PATTERN

INTEGER_PATTERN = r"^\s*[+-]?[0-9]+\s*$"


def _format_of(path: str) -> str:
    lower = path.rstrip("/").lower()
    for suffix in ("csv", "parquet"):
        if lower.endswith(f".{suffix}"):
            return suffix
    raise ValueError(f"Unsupported file type: {path}")


def has_multiline_records(spark: SparkSession, path: str) -> bool:
    """True if some line has an odd number of quotes, i.e. a quoted value spans lines."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not lines.filter(quotes % 2 == 1).isEmpty()


def blank_missing(df: DataFrame, indicators: Sequence[str]) -> DataFrame:
    """Turn the given texts into null in every column."""
    markers = sorted({*indicators, *DEFAULT_NA_TEXT})
    return df.select(
        *[F.when(~col(c).isin(*markers), col(c)).alias(c) for c in df.columns]
    )


def type_columns(df: DataFrame) -> DataFrame:
    """Give all-text columns the narrowest type that holds every value: bigint, double, boolean.

    One scan decides; a column without values becomes double. Whole numbers beyond 64 bits stay
    text, so that identifiers are never rounded.
    """
    if not df.columns:
        return df
    entries = [
        [
            F.lit(c), col(c).isNotNull(), col(c).rlike(INTEGER_PATTERN),
            col(c).rlike(INTEGER_PATTERN) & F.trim(col(c)).try_cast("bigint").isNotNull(),
            col(c).rlike(NUMBER_PATTERN), col(c).isin("True", "False", "TRUE", "FALSE", "true", "false"),
        ]
        for c in df.columns
    ]
    found = stack(df, entries, ["column", "present", "whole", "fits", "number", "truth"])
    rows = found.groupBy("column").agg(
        *[F.count_if(k).alias(k) for k in ("present", "whole", "fits", "number", "truth")],
        F.count(F.lit(1)).alias("rows"),
    )
    kinds = {}
    for r in rows.collect():
        if r["present"] and r["whole"] == r["present"]:
            if r["fits"] == r["present"]:
                kinds[r["column"]] = "bigint"
        elif r["number"] == r["present"]:
            kinds[r["column"]] = "double"
        elif r["truth"] == r["present"] == r["rows"]:
            kinds[r["column"]] = "boolean"
    return df.select(
        *[
            F.trim(col(c)).cast(kinds[c]).alias(c) if c in kinds else col(c)
            for c in df.columns
        ]
    )


def read_csv(
    spark: SparkSession,
    path: str,
    missing_indicators: Sequence[str] = MISSING_INDICATORS,
    multi_line: bool | None = None,
) -> DataFrame:
    """CSV with header. ``multi_line=None`` looks whether values span lines; files are
    only split among tasks when they do not."""
    if multi_line is None:
        multi_line = has_multiline_records(spark, path)
    raw = spark.read.csv(
        path, header=True, inferSchema=False, escape='"', multiLine=multi_line
    )
    return type_columns(blank_missing(raw, missing_indicators))


def read_table(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    missing_indicators: Sequence[str] = MISSING_INDICATORS,
) -> DataFrame:
    """Read CSV or parquet by suffix or explicit format. Markers only apply to CSV."""
    kind = format or _format_of(path)
    if kind == "csv":
        return read_csv(spark, path, missing_indicators)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported file type: {path} ({kind})")
