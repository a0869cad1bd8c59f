"""Value counts, distinct counts and modes without per-group value maps.

Everything is built on ``groupBy(column, value).count()``: map tasks combine a
hot value to one partial row each, and no task holds all values of a column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import literal, quoted
from plumbline.functions.longform import stack
from plumbline.functions.values import not_a_number

# Characters of a text that serve as grouping key.
KEY_TEXT = 256


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "bigint"
    if isinstance(kind, T.FloatType | T.DoubleType):
        return "double"
    return "string"


def _families(df: DataFrame, names: Sequence[str]) -> dict[str, list[str]]:
    kinds = {f.name: f.dataType for f in df.schema}
    found: dict[str, list[str]] = {}
    for name in names:
        found.setdefault(_family(kinds[name]), []).append(name)
    return found


def _comparable(kind: T.DataType, name: str, family: str) -> str:
    """SQL text of a column as a value of its family."""
    if isinstance(kind, T.ArrayType | T.StructType):
        return f"to_json(struct({quoted(name)}))"
    return f"cast({quoted(name)} as {family})"


def _long(df: DataFrame, names: Sequence[str], family: str) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema}
    entries = [f"{literal(c)}, {_comparable(kinds[c], c, family)}" for c in names]
    return stack(df, entries, ["column", "value"]).filter("value is not null")


def value_counts(df: DataFrame, names: Sequence[str], as_type: str) -> DataFrame:
    """(column, value, digest, n) over the values present in ``names``, cast to one type.

    A text longer than KEY_TEXT characters is counted under its first KEY_TEXT characters and a
    digest of the whole, so that long texts are never shuffled; ``full_texts`` brings them back.
    ``unparsable`` tells of such a text whether it is no number.
    """
    long = _long(df, names, as_type)
    if as_type != "string":
        counted = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        return counted.select("column", "value", F.lit(None).cast("string").alias("digest"), "n")
    value = F.col("value")
    longer = F.length(value) > KEY_TEXT
    return (
        long.select(
            "column",
            F.when(longer, F.left(value, F.lit(KEY_TEXT))).otherwise(value).alias("value"),
            F.when(longer, F.md5(value)).alias("digest"),
            F.when(longer, not_a_number(value)).alias("bad"),
        )
        .groupBy("column", "value", "digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("bad").alias("unparsable"))
    )


def full_texts(df: DataFrame, found: Sequence[Row]) -> dict[tuple[str, str], str]:
    """The whole texts behind the digests of a few counted values, by column and digest.

    Texts of one count that begin alike were ranked by digest; here the smallest of them, by their
    whole, take the places that were found, in order. Only texts with such a beginning move.
    """
    groups: dict[tuple[str, int, str], list[str]] = {}
    for r in found:
        if r["digest"] is not None:
            groups.setdefault((r["column"], r["n"], r["value"]), []).append(r["digest"])
    if not groups:
        return {}
    names = sorted({c for c, _, _ in groups})
    spark = df.sparkSession
    heads = spark.createDataFrame(sorted({(c, head) for c, _, head in groups}), "column string, head string")
    counts = spark.createDataFrame(sorted(groups), "column string, n long, head string")
    most = max(len(digests) for digests in groups.values())
    place = F.row_number().over(Window.partitionBy("column", "n", "head").orderBy("value"))
    rows = (
        _long(df, names, "string")
        .filter(F.length("value") > KEY_TEXT)
        .withColumn("head", F.left("value", F.lit(KEY_TEXT)))
        .join(F.broadcast(heads), ["column", "head"])
        .groupBy("column", "head", F.md5("value").alias("digest"))
        .agg(F.count(F.lit(1)).alias("n"), F.any_value("value").alias("value"))
        .join(F.broadcast(counts), ["column", "n", "head"])
        .withColumn("place", place)
        .filter(F.col("place") <= most)
        .collect()
    )
    texts = {(r["column"], r["n"], r["head"], r["place"]): r["value"] for r in rows}
    return {
        (group[0], digest): texts[(*group, i + 1)]
        for group, digests in groups.items()
        for i, digest in enumerate(sorted(digests))
    }


def distinct_counts(df: DataFrame, names: Sequence[str], approximate: bool = False) -> DataFrame:
    """(column, unique_count) over non-missing values."""
    parts = []
    for family, members in _families(df, names).items():
        if approximate:
            about = F.approx_count_distinct("value", 0.01).alias("unique_count")
            parts.append(_long(df, members, family).groupBy("column").agg(about))
        else:
            seen = value_counts(df, members, family)
            parts.append(seen.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count")))
    return reduce(DataFrame.unionByName, parts)


def modes(df: DataFrame, names: Sequence[str], as_type: str = "string") -> DataFrame:
    """(column, mode, n): the most frequent value, the smallest one on ties."""
    seen = value_counts(df, names, as_type)
    best = seen.groupBy("column").agg(
        F.min_by(F.struct("value", "digest"), F.struct(-F.col("n"), F.col("value"), F.col("digest"))).alias("of"),
        F.max("n").alias("n"),
    )
    best = best.select("column", "of.value", "of.digest", "n")
    if as_type != "string":
        return best.select("column", F.col("value").alias("mode"), "n")
    rows = best.collect()
    whole = full_texts(df, rows)
    return df.sparkSession.createDataFrame(
        [(r["column"], whole.get((r["column"], r["digest"]), r["value"]), r["n"]) for r in rows],
        "column string, mode string, n long",
    )
