"""Isolation Forest (Liu, Ting and Zhou, 2008): trees fitted per group, rows scored in batches."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import QualityConfig
from plumbline.functions.columns import RowKey, col, key_columns
from plumbline.functions.storage import python_tasks

# Tasks get the functions below with their code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def expected_depth(n):
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    deep = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def _fit_tree(rows: np.ndarray, seed: Sequence[int]) -> dict[str, list]:
    """Random splits until rows are alone, alike or the depth limit is reached."""
    random = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(len(rows), 2)))
    tree: dict[str, list] = {"axis": [], "value": [], "left": [], "right": [], "depth": [], "size": []}

    def grow(part: np.ndarray, depth: int) -> int:
        here = len(tree["axis"])
        for cells in tree.values():
            cells.append(0)
        tree["size"][here] = len(part)
        low, high = part.min(axis=0), part.max(axis=0)
        open_axes = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or not len(open_axes):
            tree["axis"][here] = -1
            tree["value"][here] = 0.0
            tree["depth"][here] = float(depth + expected_depth(len(part)))
            return here
        axis = int(random.choice(open_axes))
        value = float(random.uniform(low[axis], high[axis]))
        goes_left = part[:, axis] <= value
        if goes_left.all():
            goes_left = part[:, axis] < high[axis]
        tree["axis"][here], tree["value"][here] = axis, value
        tree["depth"][here] = 0.0
        tree["left"][here] = grow(part[goes_left], depth + 1)
        tree["right"][here] = grow(part[~goes_left], depth + 1)
        return here

    grow(rows, 0)
    return tree


def tree_samples(
    data: DataFrame, names: Sequence[str], row_key: RowKey, total: int, config: QualityConfig
) -> DataFrame:
    """(tree, place, names...): the rows with the lowest hashes of each tree.

    A hash threshold first drops all but about three times the rows needed,
    so the ranking sees a few hundred rows per tree however large the table.
    """
    keys = [col(k) for k in key_columns(row_key)]
    share = min(1.0, 3.0 * config.anomaly_tree_rows / max(total, 1))
    ceiling = F.lit(2**63 - 1 if share == 1.0 else int(-(2**63) + share * 2**64)).cast("bigint")

    def draw(tree: Column) -> Column:
        return F.xxhash64(*keys, tree, F.lit(config.anomaly_seed))

    trees = F.filter(
        F.sequence(F.lit(0), F.lit(config.anomaly_trees - 1)), lambda t: draw(t) <= ceiling
    )
    drawn = data.select(*keys, *[col(c) for c in names], F.explode(trees).alias("__tree"))
    drawn = drawn.repartition(python_tasks(data, config.anomaly_trees), "__tree")
    place = F.row_number().over(
        Window.partitionBy("__tree").orderBy(draw(F.col("__tree")), *keys)
    )
    return (
        drawn.withColumn("__place", place)
        .filter(F.col("__place") <= config.anomaly_tree_rows)
        .select("__tree", "__place", *[col(c).alias(f"x{i}") for i, c in enumerate(names)])
    )


@dataclass(frozen=True)
class Forest:
    """Trees as arrays over their nodes; a negative axis marks a leaf."""

    trees: list[dict[str, np.ndarray]]
    #: expected depth of a tree's whole sample
    scale: float


def fit_forest(
    data: DataFrame, names: Sequence[str], row_key: RowKey, total: int, config: QualityConfig
) -> Forest:
    """Trees over hashed samples, fitted side by side; at most trees x (2 x rows - 1) nodes."""
    axes = [f"x{i}" for i in range(len(names))]
    seed = config.anomaly_seed

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__place")
        number = int(frame["__tree"].iloc[0])
        tree = _fit_tree(frame[axes].to_numpy(), [seed, number])
        return pd.DataFrame({"tree": [number], **{k: [v] for k, v in tree.items()}})

    schema = (
        "tree int, axis array<int>, value array<double>, left array<int>, right array<int>, "
        "depth array<double>, size array<int>"
    )
    samples = tree_samples(data, names, row_key, total, config)
    fitted = samples.groupBy("__tree").applyInPandas(fit, schema).orderBy("tree").collect()
    parts = ("axis", "value", "left", "right", "depth", "size")
    trees = [{k: np.array(r[k]) for k in parts} for r in fitted]
    return Forest(trees, float(expected_depth(min(total, config.anomaly_tree_rows))))


def _descents(forest: Forest) -> list[tuple]:
    """(levels, axis, value, children, depth) of each tree; leaves are their own children, so all rows take every level."""
    ways = []
    for tree in forest.trees:
        leaf = tree["axis"] < 0
        here = np.arange(len(leaf))
        children = np.stack([np.where(leaf, here, tree["left"]), np.where(leaf, here, tree["right"])], axis=1)
        levels, reached = 0, np.zeros(1, np.int64)
        while not leaf[reached].all():
            levels, reached = levels + 1, np.unique(children[reached])
        axis = np.where(leaf, 0, tree["axis"]).astype(np.int64)
        ways.append((levels, axis, tree["value"], children.astype(np.int64).ravel(), tree["depth"]))
    return ways


def _depths(points: np.ndarray, ways: Sequence[tuple]) -> np.ndarray:
    """Sum over the trees of the depth each row ends at."""
    cells = np.ascontiguousarray(points).ravel()
    first = np.arange(len(points)) * points.shape[1]
    total, x, split, cell = np.zeros(len(points)), np.empty(len(points)), np.empty(len(points)), np.empty_like(first)
    for levels, axis, value, children, depth in ways:
        # All rows start at the root; numbers lie within their arrays, so nothing is clipped.
        right = ~(points[:, axis[0]] <= value[0])
        at = children.take(right, mode="clip")
        for _ in range(levels - 1):
            axis.take(at, out=cell, mode="clip")
            cell += first
            cells.take(cell, out=x, mode="clip")
            value.take(at, out=split, mode="clip")
            np.less_equal(x, split, out=right)
            at += at
            at += 1
            at -= right
            at = children.take(at, mode="clip")
        total += depth.take(at)
    return total


def forest_scores(data: DataFrame, names: Sequence[str], forest: Forest) -> DataFrame:
    """Add ``iso_score``: minus the anomaly score, so lower means more anomalous."""
    # Plain arrays: what is broadcast is read without this package.
    shared = data.sparkSession.sparkContext.broadcast(_descents(forest))
    trees, scale = len(forest.trees), forest.scale

    @F.pandas_udf("double")
    def score(frame: pd.DataFrame) -> pd.Series:
        points = frame.to_numpy(dtype=float)
        depth = _depths(points, shared.value)
        return pd.Series(-(2.0 ** (-depth / trees / scale)))

    return data.withColumn("iso_score", score(F.struct(*[col(c) for c in names])))


def isolation_scores(
    data: DataFrame, names: Sequence[str], row_key: RowKey, total: int, config: QualityConfig
) -> DataFrame:
    """Add ``iso_score`` from a forest fitted to the same rows."""
    return forest_scores(data, names, fit_forest(data, names, row_key, total, config))
