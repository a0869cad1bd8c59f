"""Why a row was flagged: which columns made it unusual, and by how much."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import RowKey, col, key_columns, nan_to_null
from plumbline.operators.facts import moments, z_score
from plumbline.operators.isolation import Forest, expected_depth

TOP = 3


def _largest(names: Sequence[str], values: Sequence[Column], top: int) -> Column:
    """The ``top`` columns of greatest value as (column, value), ties to the smaller name; nulls never."""
    cells = [F.when(v.isNotNull(), F.struct((-v).alias("o"), F.lit(c).alias("column"))) for c, v in zip(names, values)]
    ordered = F.slice(F.array_sort(F.array_compact(F.array(*cells))), 1, top)
    return F.transform(ordered, lambda x: F.struct(x["column"].alias("column"), (-x["o"]).alias("value")))


def deviations(df: DataFrame, row_key: RowKey, names: Sequence[str], threshold: float, top: int = TOP) -> DataFrame:
    """Row key and ``reasons`` of every row with a value beyond ``threshold`` standard deviations.

    Reasons are the ``top`` columns of greatest distance from the mean, in standard deviations. Columns
    of one value, and missing values, are no reason.
    """
    clean = nan_to_null(df)
    stats = moments(clean, names)
    # Infinite values leave no usable spread.
    usable = [c for c in names if stats[c][1] and math.isfinite(stats[c][1])]
    if not usable:
        none = F.lit(None).cast("array<struct<column:string,value:double>>")
        return clean.select(*[col(k) for k in key_columns(row_key)], none.alias("reasons")).limit(0)
    distance = [F.abs(z_score(c, *stats[c])) for c in usable]
    beyond = F.greatest(*distance, F.lit(0.0)) > threshold
    return clean.filter(beyond).select(
        *[col(k) for k in key_columns(row_key)], _largest(usable, distance, top).alias("reasons")
    )


def depth_saved(forest: Forest, points: np.ndarray) -> np.ndarray:
    """Rows x columns: how many steps to isolation the splits along each column have saved, mean over trees.

    A split of n rows that leads to one part of m rows saves what n rows would still take less the
    step itself and what m rows take. Savings of a path sum to the expected depth of the tree less
    the path's own, so a row's sum over columns orders rows as their score does.
    """
    rows = np.arange(len(points))
    saved = np.zeros(points.shape)
    for tree in forest.trees:
        at = np.zeros(len(points), dtype=np.int64)
        left = expected_depth(tree["size"])
        while True:
            axis = tree["axis"][at]
            inner = np.flatnonzero(axis >= 0)
            if not len(inner):
                break
            here, split = at[inner], axis[inner]
            goes_left = points[inner, split] <= tree["value"][here]
            step = np.where(goes_left, tree["left"][here], tree["right"][here])
            saved[rows[inner], split] += left[here] - 1.0 - left[step]
            at[inner] = step
    return saved / len(forest.trees)


def forest_reasons(data: DataFrame, names: Sequence[str], forest: Forest, top: int = TOP) -> DataFrame:
    """Add ``reasons``: the ``top`` columns whose splits have saved most, for the rows of ``data``.

    ``data`` is best the flagged rows only; its columns ``names`` hold no gaps.
    """
    shared = data.sparkSession.sparkContext.broadcast(forest)  # a fixed number of nodes

    @F.pandas_udf("array<double>")
    def saved(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(list(depth_saved(shared.value, frame.to_numpy(dtype=float))))

    measured = data.withColumn("__saved", saved(F.struct(*[col(c) for c in names])))
    values = [F.get("__saved", i) for i in range(len(names))]
    return measured.withColumn("reasons", _largest(names, values, top)).drop("__saved")
