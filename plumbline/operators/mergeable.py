"""Metrics of groups from partial states that merge, for what counts of labels cannot express.

A metric has a state; every task updates one state a group from its own rows, and states are merged
in two steps, first within shares of the tasks, then all of a group. So no group's rows ever meet in
one task, and a hot group costs no more than others.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence
from itertools import batched
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators.groups import JOIN_NAMES, JOIN_VALUES, attribute_sets

#: Groups a task keeps states of at a time, and shares of the first merge.
HELD_GROUPS = 20_000
SHARES = 32


class Metric(Protocol):
    """A user's aggregate: states are any values that pickle, small whatever the number of rows."""

    def zero(self) -> Any:
        """The state of no rows."""

    def update(self, state: Any, y_true: np.ndarray, score: np.ndarray) -> Any:
        """The state with some more rows of a group, never null."""

    def merge(self, one: Any, two: Any) -> Any:
        """The state of both; order must not matter."""

    def finish(self, state: Any) -> float | None:
        """The metric."""


class AreaUnderCurve:
    """Area under the ROC curve over scores in [0, 1], told apart by ``bins`` equal steps.

    Scores of one bin tie and count half; null without both labels.
    """

    def __init__(self, bins: int = 1000):
        self.bins = bins

    def zero(self) -> np.ndarray:
        return np.zeros((2, self.bins), np.int64)

    def update(self, state: np.ndarray, y_true: np.ndarray, score: np.ndarray) -> np.ndarray:
        place = np.clip((score * self.bins).astype(np.int64), 0, self.bins - 1)
        for label in (0, 1):
            state[label] += np.bincount(place[y_true == label], minlength=self.bins)
        return state

    def merge(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return one + two

    def finish(self, state: np.ndarray) -> float | None:
        negative, positive = state
        pairs = int(negative.sum()) * int(positive.sum())
        if not pairs:
            return None
        below = np.cumsum(negative) - negative
        return int((positive * (2 * below + negative)).sum()) / (2 * pairs)


class CalibrationError:
    """Expected calibration error: distance of mean score and share of label 1 by bin, weighted by rows."""

    def __init__(self, bins: int = 10):
        self.bins = bins

    def zero(self) -> np.ndarray:
        return np.zeros((3, self.bins))

    def update(self, state: np.ndarray, y_true: np.ndarray, score: np.ndarray) -> np.ndarray:
        place = np.clip((score * self.bins).astype(np.int64), 0, self.bins - 1)
        for i, weight in enumerate((None, score, y_true)):
            state[i] += np.bincount(place, weight, minlength=self.bins)
        return state

    def merge(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return one + two

    def finish(self, state: np.ndarray) -> float | None:
        rows, scores, ones = state
        return float(np.abs(scores - ones).sum() / rows.sum()) if rows.sum() else None


STATE = "attribute string, grp string, share int, rows long, states binary"


def group_values(
    df: DataFrame, y_true: str, score: str, attributes: Sequence[str], metrics: Mapping[str, Metric],
    depth: int = 1,
) -> DataFrame:
    """(attribute, grp, n, one column a metric) of every group and intersection up to ``depth``.

    Rows without label or score count nowhere; a missing attribute value is the group "nan". A
    metric without a value is null.
    """
    names, kinds = list(metrics), list(metrics.values())
    cell = {a: F.coalesce(col(a).cast("string"), F.lit("nan")) for a in attributes}
    sets = [
        F.struct(
            F.lit(JOIN_NAMES.join(members)).alias("attribute"),
            F.concat_ws(JOIN_VALUES, *[cell[a] for a in members]).alias("grp"),
        )
        for members in attribute_sets(attributes, depth)
    ]
    rows = df.select(
        col(y_true).cast("int").alias("t"), col(score).cast("double").alias("s"), F.array(*sets).alias("g")
    ).filter("t IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    flat = rows.select("t", "s", F.explode("g").alias("g")).select("t", "s", "g.*")

    def emit(held: dict, share: int) -> pa.RecordBatch:
        keys = list(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.array([share] * len(keys), pa.int32()), pa.array([held[k][0] for k in keys], pa.int64()),
             pa.array([pickle.dumps(held[k][1]) for k in keys], pa.binary())],
            ["attribute", "grp", "share", "rows", "states"],
        )

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = TaskContext.get().partitionId() % SHARES
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).dictionary_encode() for c in ("attribute", "grp")]
            codes = keys[0].indices.to_numpy().astype(np.int64) * len(keys[1].dictionary) + keys[1].indices.to_numpy()
            truth, value = batch.column("t").to_numpy(), batch.column("s").to_numpy()
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            for some in np.split(order, cuts):
                key = tuple(k[int(some[0])].as_py() for k in keys)
                n, states = held.get(key) or (0, [m.zero() for m in kinds])
                states = [m.update(s, truth[some], value[some]) for m, s in zip(kinds, states)]
                held[key] = (n + len(some), states)
            if len(held) > HELD_GROUPS:
                yield emit(held, share)
                held = {}
        if held:
            yield emit(held, share)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(attribute, grp, rows, states) of rows that lie beside each other."""
        last = None
        for batch in batches:
            for row in batch.to_pylist():
                key, states = (row["attribute"], row["grp"]), pickle.loads(row["states"])
                if last is not None and last[0] == key:
                    joined = [m.merge(a, b) for m, a, b in zip(kinds, last[2], states)]
                    last = (key, last[1] + row["rows"], joined)
                else:
                    if last is not None:
                        yield last
                    last = (key, row["rows"], states)
        if last is not None:
            yield last

    def within_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batched(merged(batches), 1000):
            yield emit({key: (n, states) for key, n, states in some}, 0)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batched(merged(batches), 1000):
            columns = [pa.array([key[i] for key, _, _ in some], pa.string()) for i in (0, 1)]
            columns.append(pa.array([n for _, n, _ in some], pa.int64()))
            for i, metric in enumerate(kinds):
                columns.append(pa.array([metric.finish(states[i]) for _, _, states in some], pa.float64()))
            yield pa.RecordBatch.from_arrays(
                columns, ["attribute", "grp", "n", *[f"v{i}" for i in range(len(kinds))]]
            )

    partial = flat.mapInArrow(update, STATE)
    shares = partial.repartition("attribute", "grp", "share").sortWithinPartitions("attribute", "grp", "share")
    few = shares.mapInArrow(within_share, STATE).repartition("attribute", "grp").sortWithinPartitions("attribute", "grp")
    columns = "".join(f", v{i} double" for i in range(len(names)))
    return few.mapInArrow(finish, f"attribute string, grp string, n long{columns}").toDF("attribute", "grp", "n", *names)
