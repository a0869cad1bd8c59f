"""A quick model to audit: binary target, encoded features, split, random forest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (
    RowKey, col, data_columns, key_columns, key_text, nan_to_null, numeric_columns, text_columns,
)
from plumbline.functions.counts import modes
from plumbline.functions.longform import stack
from plumbline.functions.quantiles import medians
from plumbline.functions.storage import pin, spread
from plumbline.operators.facts import drop_empty_columns

# Target texts (upper case, trimmed) that mean "negative".
NEGATIVE_TEXT = ("NO", "FALSE", "0", "0.0", "N", "NEGATIVE")

# Distinct values numbered in one task.
CODES_PER_TASK = 200_000


def binarize_target(df: DataFrame, target: str) -> Column:
    """1/0 label: numbers up to the median are 1; texts are 1 unless they say no.

    Missing numbers become 0 and missing texts 1.
    """
    if target in numeric_columns(df, [target]):
        middle = medians(df, [target])[target]
        small = col(target).cast("double") <= F.lit(middle).cast("double")
        return F.when(small, 1).otherwise(0)
    plain = F.upper(F.regexp_replace(col(target).cast("string"), r"^\s+|\s+$", ""))
    return F.when(plain.isin(*NEGATIVE_TEXT), 0).otherwise(1)


def class_distribution(labelled: DataFrame, label: str) -> DataFrame:
    return labelled.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _mode_type(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "bigint"
    return "double" if isinstance(kind, T.FloatType | T.DoubleType) else "string"


def impute_most_frequent(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fill the gaps of each column with its most frequent value, the smallest on ties.

    Only columns with gaps are counted by value.
    """
    if not names:
        return df
    gaps = df.agg(*[F.count_if(col(c).isNull()) for c in names]).first()
    names = [c for c, n in zip(names, gaps) if n]
    kinds = {c: df.schema[c].dataType for c in names}
    parts = []
    for family in ("bigint", "double", "string"):
        members = [c for c in names if _mode_type(kinds[c]) == family]
        if members:
            common = modes(df, members, family)
            parts.append(common.select("column", F.col("mode").cast("string").alias("mode")))
    rows = reduce(DataFrame.unionByName, parts).collect() if parts else []
    found = {r["column"]: r["mode"] for r in rows}
    cells = [
        F.coalesce(col(c), F.lit(found[c]).cast(kinds[c])).alias(c) if c in found else col(c)
        for c in df.columns
    ]
    return df.select(*cells)


def label_codes(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, value, code): codes 0.. in alphabetical order per column, any number of values.

    Distinct values are dealt into as many ranges as their number asks for; each range is numbered
    on its own and shifted by the size of the ranges before it.
    """
    entries = [[F.lit(c), col(c).cast("string")] for c in names]
    values = (
        stack(df, entries, ["column", "value"])
        .filter("value is not null")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("column", "value")
    )
    values = pin(values)
    parts = 1 + values.count() // CODES_PER_TASK
    order = ["column", "value"]
    # Pinned, so that a value keeps the range it was dealt into.
    ranged = pin(
        values.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    )
    sizes = ranged.groupBy("column", "part").count()
    before = Window.partitionBy("column").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = sizes.select(
        "column", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift")
    )
    place = F.row_number().over(Window.partitionBy("column", "part").orderBy("value"))
    return (
        ranged.withColumn("place", place)
        .join(shifts, ["column", "part"])
        .select("column", "value", (F.col("place") - 1 + F.col("shift")).alias("code"))
    )


def label_encode(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace text columns by their codes. Joined by value: few codes are broadcast by the
    optimizer once their real size is known, many are shuffled and hot values split."""
    codes = label_codes(df, names)
    encoded = df
    for name in names:
        mine = codes.filter(F.col("column") == name).select(
            F.col("value").alias("__value"), F.col("code").alias("__code")
        )
        joined = encoded.join(mine, col(name).cast("string") == F.col("__value"), "left")
        encoded = joined.select(
            *[F.col("__code").alias(c) if c == name else col(c) for c in encoded.columns]
        )
    return encoded


def in_test_part(row_key: RowKey, fraction: float = 0.3, seed: int = 42) -> Column:
    """True for rows of the test part: a hash of the row key, so it never depends on partitions."""
    digest = F.md5(F.concat(key_text(row_key), F.lit(f":{seed}")).cast("binary"))
    return F.substring(digest, 1, 8) < F.lit(f"{int(fraction * 2**32):08x}")


@dataclass(frozen=True)
class Scored:
    """Test rows with their original columns, ``y_true`` and ``y_pred``; and the class counts."""

    data: DataFrame
    classes: dict[int, int]


def _features(df: DataFrame, names: Sequence[str]) -> tuple[list[Column], list[str]]:
    """Columns a model can use, times as seconds; the others are left out."""
    usable, cells = [], []
    for name in names:
        kind = df.schema[name].dataType
        if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
            cells.append(F.unix_seconds(col(name).cast("timestamp")).alias(name))
        elif isinstance(kind, T.NumericType | T.BooleanType | T.StringType):
            cells.append(col(name))
        else:
            continue
        usable.append(name)
    return cells, usable


def score_proxy(
    df: DataFrame,
    target: str,
    row_key: RowKey,
    test_fraction: float = 0.3,
    seed: int = 42,
    trees: int = 10,
    depth: int = 10,
) -> Scored:
    """Train a small random forest on 70 % of the rows and predict the rest.

    The test rows keep their original, unimputed columns for the audit.
    """
    clean = nan_to_null(df)
    label = binarize_target(clean, target)
    classes = {
        r["label"]: r["n"]
        for r in class_distribution(clean.select(label.alias("y")), "y").collect()
    }
    if len(classes) < 2:
        raise ValueError(f"target {target!r} has a single class {classes}; nothing to model")
    cells, names = _features(clean, [c for c in data_columns(clean, row_key) if c != target])
    keys = key_columns(row_key)
    own = [col(k).alias(f"__key_{i}") for i, k in enumerate(keys)]
    held = [f"__key_{i}" for i in range(len(keys))]
    test = in_test_part(row_key, test_fraction, seed)
    model_data = clean.select(*own, label.alias("__label"), test.alias("__test"), *cells)
    model_data = drop_empty_columns(model_data, names)
    names = [c for c in names if c in model_data.columns]
    filled = impute_most_frequent(model_data, names)
    encoded = label_encode(filled, text_columns(filled, names))
    numbers = [col(c).cast("double").alias(f"f{i}") for i, c in enumerate(names)]
    ready = encoded.select(*held, "__label", "__test", *numbers)
    assembled = VectorAssembler(
        inputCols=[f"f{i}" for i in range(len(names))], outputCol="features"
    ).transform(ready)
    # Training passes over the data many times: keys and features on disk, on all cores.
    assembled = assembled.select(*held, "__label", "__test", "features")
    assembled = pin(spread(assembled, sum(classes.values())))
    forest = RandomForestClassifier(
        labelCol="__label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed
    )
    model = forest.fit(assembled.filter(~F.col("__test")).select("__label", "features"))
    predicted = model.transform(assembled.filter("__test"))
    predicted = predicted.select(
        *held, F.col("__label").alias("y_true"), F.col("prediction").cast("int").alias("y_pred")
    )
    # Only test rows get their original columns back.
    same = [col(k).eqNullSafe(F.col(h)) for k, h in zip(keys, held)]
    result = clean.filter(test).join(predicted, same).drop(*held)
    return Scored(result, classes)
