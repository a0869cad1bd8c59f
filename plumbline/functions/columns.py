"""Column selection by type, missing values and row keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RowKey = str | Sequence[str]


def quoted(name: str) -> str:
    """Column name for SQL text; it may hold dots, blanks or back-ticks."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """String literal for SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def col(name: str) -> Column:
    """Reference a column by its exact name."""
    return F.col(quoted(name))


def key_columns(row_key: RowKey) -> list[str]:
    return [row_key] if isinstance(row_key, str) else list(row_key)


def key_text(row_key: RowKey) -> Column:
    """Row key as text, for evidence rows."""
    return F.concat_ws("|", *[col(k).cast("string") for k in key_columns(row_key)])


def key_struct(row_key: RowKey) -> Column:
    """Row key as one comparable value."""
    return F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(key_columns(row_key))])


def data_columns(df: DataFrame, row_key: RowKey | None) -> list[str]:
    keys = set(key_columns(row_key)) if row_key is not None else set()
    return [c for c in df.columns if c not in keys]


def _select(df: DataFrame, names: Sequence[str], accept) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema}
    return [c for c in names if accept(kinds[c])]


def numeric_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Numbers and booleans: everything a mean can be taken of."""
    return _select(df, names, lambda t: isinstance(t, T.NumericType | T.BooleanType))


def number_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Numbers without booleans: the columns of the multivariate checks."""
    return _select(df, names, lambda t: isinstance(t, T.NumericType))


def text_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    return _select(df, names, lambda t: isinstance(t, T.StringType))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType | T.VariantType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind)


def groupable_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns Spark can group by; maps and variants cannot be compared."""
    return _select(df, names, lambda t: not _has_map(t))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in floating-point columns, so both count as missing once."""
    floats = {
        f.name: f.dataType.simpleString()
        for f in df.schema
        if isinstance(f.dataType, T.FloatType | T.DoubleType)
    }
    if not floats:
        return df
    # SQL text: one call for any number of columns.
    cells = [
        f"nanvl({quoted(c)}, cast(null as {floats[c]})) as {quoted(c)}" if c in floats else quoted(c)
        for c in df.columns
    ]
    return df.selectExpr(*cells)


def with_file_position(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add file path and row position of a file-based frame, usable as its row key."""
    keyed = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.row_index").alias("__row"),
    )
    return keyed, ["__file", "__row"]
