"""Write repaired tables, exported rows and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cleaned_path(path: str) -> str:
    """Name of the repaired copy of an input file."""
    stem, dot, suffix = path.rstrip("/").rpartition(".")
    if dot and suffix.lower() in ("csv", "parquet"):
        return f"{stem}_cleaned.csv"
    return f"{path.rstrip('/')}_cleaned.csv"


def write_table(df: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists") -> None:
    """Write in parallel; CSV with header and doubled quotes."""
    writer = df.write.mode(mode)
    if format == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"Unsupported file type: {path} ({format})")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round top-level floating-point columns for presentation."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)}
    return df.select(
        *[F.bround(c, digits).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def write_report(
    tables: dict[str, DataFrame], path: str, digits: int | None = None, mode: str = "errorifexists"
) -> None:
    """One JSON-lines folder per report table."""
    for name, table in tables.items():
        shown = table if digits is None else rounded(table, digits)
        shown.write.mode(mode).json(f"{path}/{name}")
