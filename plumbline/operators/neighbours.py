"""k nearest neighbours and Local Outlier Factor without comparing all pairs.

Equal rows are first merged into one location with a multiplicity, so however
many copies a row has, it is one point from there on. Locations are cut into
leaves of limited size by median splits; a leaf that is still too large is cut
again from a sample of its own rows, so no leaf and no sample grows with the
table, and none comes to the driver.

Exact search: each leaf finds its own nearest neighbours and with them the
radius beyond which nothing can matter; only leaves whose bounding box lies
within that radius are asked again, found by descending the tree of boxes.
Distances tie-break on the coordinates themselves. In many columns most leaves
lie within the radius, and the work nears all pairs.

Forest search: all locations are cut into large parts, and a task holds one.
Where boxes around few rows keep most rows of the part away from each other,
the task finds all neighbours with one tree of boxes. Otherwise it grows several
random trees: rows that share a leaf in any tree are compared exactly, and the
nearest of all trees are kept; work is rows x trees x leaf size in any number of
columns. What trees find are true distances; what they miss are some neighbours.
Rows whose neighbours may lie across a border ask the other parts within their
radius; where boxes are of no use or these are many, all locations are cut in
a few more ways along random directions instead. Outlier factors need the
neighbours' densities: those in the same part are looked up in the task, so
lists of neighbours are not joined; only neighbours in other parts are.

Tasks hold one leaf and one block of query points; a leaf asked by many points
is copied to several tasks.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.functions.storage import pin, python_tasks

# Tasks get the functions below with their code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF_ROWS = 2048
#: A node is cut into at most 2**FAN_LEVELS children at once, from this many sampled rows for each.
FAN_LEVELS = 9
SAMPLE_PER_LEAF = 64
QUERY_BLOCK = 50_000
CHUNK_CELLS = 4_000_000
#: Children of node n are n * CHILDREN + 1 and up; the root is 0.
CHILDREN = 1 << (FAN_LEVELS + 1)

FOREST_TREES = 8
FOREST_LEAF_ROWS = 1024
FOREST_DIRECTIONS = 8
#: The forest search cuts all rows in so many ways into parts of at least so many rows; trees grow in parts.
FOREST_CUTS = 3
FOREST_PART_ROWS = 1 << 16
#: Other parts a location asks, on average, before further cuts are made instead; a part is given up beyond the second.
FOREST_VISITS = 4
PART_VISITS = 64
PART_QUERIES = 1 << 18
#: Distances of a leaf's pairs held at once, and rows whose lists are merged at once.
LEAF_CELLS = 250_000
MERGE_ROWS = 4096
#: Rows of a box at most, rows compared for a first radius, distances held at once, boxes tried before all are used.
BOX_ROWS = 128
GROUP_ROWS = 512
BOX_CELLS = 2_000_000
BOXES_TRIED = 32


def _nearest(points: np.ndarray, queries: np.ndarray, k: int, skip: np.ndarray | None = None):
    """Positions and squared distances of the k nearest points per query, ties in point order.

    ``skip`` names for each query the point that is the query itself.
    Yields (query positions, point positions, squared distances) per chunk.
    """
    step = max(1, CHUNK_CELLS // max(len(points), 1))
    center = points.mean(axis=0)
    moved, length = points - center, None
    for start in range(0, len(queries), step):
        block = queries[start : start + step]
        slack = 0.0
        if points.shape[1] <= 4:
            squared = np.zeros((len(block), len(points)))
            for axis in range(points.shape[1]):
                gap = block[:, axis, None] - points[None, :, axis]
                squared += gap * gap
        else:
            # One matrix product instead of a pass per column; what it rounds away
            # is allowed for here and the distances kept are taken exactly below.
            shifted = block - center
            length = (moved * moved).sum(axis=1) if length is None else length
            own = (shifted * shifted).sum(axis=1)
            squared = own[:, None] + length[None, :] - 2.0 * (shifted @ moved.T)
            slack = 1e-14 * points.shape[1] * (own[:, None] + length.max())
        if skip is not None:
            squared[np.arange(len(block)), skip[start : start + step]] = np.inf
        limit = np.full((len(block), 1), np.inf)
        if k < len(points):
            limit = np.partition(squared, k - 1, axis=1)[:, k - 1 : k] + 2.0 * slack
        row, place = np.nonzero((squared <= limit) & np.isfinite(squared))
        near = np.zeros(len(row))
        for axis in range(points.shape[1]):
            gap = block[row, axis] - points[place, axis]
            near += gap * gap
        order = np.lexsort((place, near, row))
        row, place, near = row[order], place[order], near[order]
        first = np.searchsorted(row, row, side="left")
        keep = np.arange(len(row)) - first < k
        yield start + row[keep], place[keep], near[keep]


def _cut(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Median splits of a complete binary tree, in heap order: axis and value of every inner node.

    Rows below the value go left. A part that cannot be split sends everything left.
    """
    axes = np.zeros((1 << levels) - 1, dtype=np.int64)
    values = np.full(len(axes), np.inf)

    def grow(rows: np.ndarray, node: int) -> None:
        spread = np.ptp(rows, axis=0) if len(rows) > 1 else np.zeros(sample.shape[1])
        if node >= len(axes) or not spread.any():
            return
        axis = int(np.argmax(spread))
        ordered = np.sort(rows[:, axis])
        value = ordered[len(ordered) // 2]
        if value == ordered[0]:
            value = ordered[np.searchsorted(ordered, value, side="right")]
        axes[node], values[node] = axis, value
        low = rows[:, axis] < value
        grow(rows[low], 2 * node + 1)
        grow(rows[~low], 2 * node + 2)

    grow(sample, 0)
    return axes, values


def _levels(rows: int, leaf_rows: int) -> int:
    """Levels of splits that bring a node of so many rows down to leaves, as far as one cut goes."""
    return min(FAN_LEVELS, max(0, math.ceil(math.log2(max(rows, 1) / leaf_rows))))


def _split(nodes: DataFrame, over: DataFrame, leaf_rows: int, seed: int) -> DataFrame:
    """(leaf, levels, axis, value): how each of the nodes ``over`` is cut, from a sample of its rows."""
    scale = 1 << 30
    wanted = F.least(F.lit(1 << FAN_LEVELS), 2 * F.col("rows") / leaf_rows)
    rate = SAMPLE_PER_LEAF * float(scale) * wanted / F.col("rows")
    picked = nodes.join(over, "leaf").filter(
        F.pmod(F.xxhash64("loc", F.lit(seed)), F.lit(scale)) < rate
    )

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        levels = _levels(int(frame["rows"].iloc[0]), leaf_rows)
        # In a fixed order, so that ties among spreads and medians do not depend on the partitions.
        rows = np.stack(frame.sort_values("loc")["at"].to_numpy())
        axis, value = _cut(rows, levels)
        return pd.DataFrame(
            {"leaf": [frame["leaf"].iloc[0]], "levels": [levels], "axis": [axis], "value": [value]}
        )

    chosen = picked.select("leaf", "rows", "loc", "at")
    return chosen.groupBy("leaf").applyInPandas(
        cut, "leaf long, levels int, axis array<long>, value array<double>"
    )


def with_leaves(
    places: DataFrame, at: Column, leaf_rows: int, rows: int, roots: Sequence[int] = (0,)
) -> tuple[DataFrame, int]:
    """Add ``leaf``: cut ``places`` by the coordinates ``at`` until no leaf exceeds twice ``leaf_rows``.

    ``places`` may bring a column ``leaf`` of the nodes ``roots`` to start from, of ``rows`` rows
    each; several roots count from 1, as children of a node that nothing is in. Also returns how often nodes were cut. All choices are made in Spark, from samples of at most
    about SAMPLE_PER_LEAF rows for each child; a node's splits are one row, joined by its number.
    """
    started = "leaf" in places.columns
    nodes = places if started else places.withColumn("leaf", F.lit(0).cast("long"))
    kept = [*places.columns, *(() if started else ("leaf",))]
    over = None
    if rows > 2 * leaf_rows:
        cells = [(node, rows) for node in roots]
        over = places.sparkSession.createDataFrame(cells, "leaf long, rows long")
    depth = 0
    while over is not None:
        located = nodes.withColumn("at", at)
        # One row a root.
        splits = _split(located, F.broadcast(over) if depth == 0 else over, leaf_rows, depth)
        if depth == 0:
            splits = F.broadcast(splits)
        ways = splits.select(F.col("leaf").alias("__node"), "levels", "axis", "value")
        # A descent of at most FAN_LEVELS steps over the row's own node.
        end = F.aggregate(
            F.expr("sequence(1, levels)"), F.lit(0),
            lambda n, _: 2 * n + 1 + (F.element_at("at", (F.element_at("axis", n + 1) + 1).cast("int"))
                                      >= F.element_at("value", n + 1)).cast("int"),
        )
        child = F.col("leaf") * CHILDREN + end - F.expr("shiftleft(1, levels)") + 2
        joined = located.join(ways, F.col("leaf") == F.col("__node"), "left")
        moved = F.when(F.col("levels") > 0, child).otherwise(F.col("leaf"))
        nodes = pin(joined.withColumn("leaf", moved).select(*kept))
        depth += 1
        sizes = nodes.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"))
        over = sizes.filter(F.col("rows") > 2 * leaf_rows)
        if over.isEmpty():
            over = None
    return nodes, depth


def locations(data: DataFrame, names: Sequence[str]) -> DataFrame:
    """(loc, m, x0..): distinct rows numbered in coordinate order, with their multiplicity."""
    axes = [f"x{i}" for i in range(len(names))]
    merged = (
        data.select(*[col(c).alias(x) for c, x in zip(names, axes)])
        .groupBy(*axes)
        .agg(F.count(F.lit(1)).alias("m"))
    )
    # Sorted by range, so that ids grow with the coordinates; pinned, so that they stay.
    return pin(merged.orderBy(*axes).select(F.monotonically_increasing_id().alias("loc"), "m", *axes))


def _points(table: pa.Table, axes: Sequence[str]) -> np.ndarray:
    return np.column_stack([table[x].to_numpy() for x in axes])


def _lists(row: np.ndarray, rows: int, values: np.ndarray) -> pa.Array:
    """One list of values for each row; ``row`` is in order."""
    offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _with_lists(table: pa.Table, row: np.ndarray, place: np.ndarray, near: np.ndarray) -> pa.Table:
    """Add the neighbours' numbers, multiplicities and distances."""
    for name, values in (
        ("near", table["loc"].to_numpy()[place]), ("near_m", table["m"].to_numpy()[place]), ("d2", near)
    ):
        table = table.append_column(name, _lists(row, table.num_rows, values))
    return table


def _axes(places: DataFrame) -> list[str]:
    return [c for c in places.columns if c.startswith("x")]


def _boxes(treed: DataFrame, axes: Sequence[str], depth: int) -> DataFrame:
    """(node, parent, lo_x.., hi_x..) of every node below the root, leaves included."""
    line = [F.col("leaf")]
    for _ in range(depth - 1):
        line.append(F.floor((line[-1] - 1) / CHILDREN).cast("long"))
    corners = [F.min(x).alias(f"lo_{x}") for x in axes] + [F.max(x).alias(f"hi_{x}") for x in axes]
    upper = [F.min(f"lo_{x}").alias(f"lo_{x}") for x in axes] + [F.max(f"hi_{x}").alias(f"hi_{x}") for x in axes]
    leaves = treed.groupBy("leaf").agg(*corners)
    if depth < 2:
        return leaves.withColumnRenamed("leaf", "node").withColumn("parent", F.lit(0).cast("long"))
    # A leaf that was not cut again stands for itself once; the root is no one's child.
    above = leaves.select("*", F.explode(F.array_distinct(F.array(*line))).alias("node"))
    return (
        above.filter((F.col("node") > 0) | (F.col("leaf") == 0))
        .groupBy("node").agg(*upper)
        .withColumn("parent", F.floor((F.col("node") - 1) / CHILDREN).cast("long"))
    )


def _nearest_of(found: DataFrame, k: int, repeats: bool) -> DataFrame:
    """(loc, m, best): the k nearest of all lists ``best`` of a location, distance first.

    With ``repeats`` a neighbour may be in several lists; sorted, it lies beside itself.
    """
    together = found.groupBy("loc", "m").agg(F.array_sort(F.flatten(F.collect_list("best"))).alias("best"))
    best = F.col("best")
    if repeats:
        best = F.filter("best", lambda one, i: (i == 0) | (one["near"] != F.get("best", i - 1)["near"]))
    return together.withColumn("best", F.slice(best, 1, k))


def _rows(lists: DataFrame) -> DataFrame:
    return lists.select("loc", "m", F.inline("best")).select("loc", "m", "near", "near_m", "d2")


def nearest_locations(places: DataFrame, k: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(loc, m, near, near_m, d2): up to k nearest other locations of each location."""
    return _rows(nearest_lists(places, k, leaf_rows))


def nearest_lists(places: DataFrame, k: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(loc, m, best): the same as one list of (d2, near, near_m) for each location."""
    axes = _axes(places)
    total = places.count()
    treed, depth = with_leaves(places, F.array(*axes), leaf_rows, total)
    boxes = _boxes(treed, axes, depth)
    # The root's children, 2**FAN_LEVELS at most; what lies deeper is joined level by level.
    top = boxes.filter("parent = 0").orderBy("node").toPandas()
    box_leaf = top["node"].to_numpy()
    box_low = top[[f"lo_{x}" for x in axes]].to_numpy()
    box_high = top[[f"hi_{x}" for x in axes]].to_numpy()

    def within_leaf(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("loc")
        points, rows = _points(table, axes), np.arange(table.num_rows)
        row, place, near = (np.concatenate(part) for part in zip(*_nearest(points, points, k, rows)))
        # With fewer than k neighbours in the leaf, everything outside may matter.
        radius = np.full(len(points), np.inf)
        full = np.bincount(row, minlength=len(points)) >= k
        radius[full] = near[np.searchsorted(row, rows[full], side="right") - 1]

        home = table["leaf"][0].as_py()
        seen_row, seen_box = [], []
        step = max(1, CHUNK_CELLS // len(box_leaf))
        for start in range(0, len(points), step):
            block = points[start : start + step]
            squared = np.zeros((len(block), len(box_leaf)))
            for axis in range(len(axes)):
                x = block[:, axis, None]
                gap = np.maximum(np.maximum(box_low[:, axis] - x, x - box_high[:, axis]), 0.0)
                squared += gap * gap
            reached = squared <= radius[start : start + step, None]
            reached &= box_leaf[None, :] != home
            r, b = np.nonzero(reached)
            seen_row.append(start + r)
            seen_box.append(box_leaf[b])
        out = _with_lists(table.select(["loc", "m", *axes, "leaf"]), row, place, near)
        visits = _lists(np.concatenate(seen_row), len(points), np.concatenate(seen_box))
        return out.append_column("visits", visits).append_column("radius", pa.array(radius))

    schema = (
        "loc long, m long, " + ", ".join(f"{x} double" for x in axes) + ", leaf long, "
        "near array<long>, near_m array<long>, d2 array<double>, visits array<long>, radius double"
    )
    tasks = python_tasks(places, max(len(box_leaf), total // leaf_rows))
    leaves = treed.repartition(tasks, "leaf").groupBy("leaf")
    first = pin(leaves.applyInArrow(within_leaf, schema))
    own = first.select("loc", "m", F.arrays_zip("d2", "near", "near_m").alias("best"))

    asked = _visits(first, boxes, axes, depth).drop("home")
    asked, copied = _dealt(asked, treed, total, QUERY_BLOCK)

    def across(table: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["loc", "m", "near", "near_m", "d2"]
        kinds = [pa.int64()] * 4 + [pa.float64()]
        if not table.num_rows or not queries.num_rows:
            return pa.table([pa.array([], kind) for kind in kinds], names)
        table = table.combine_chunks().sort_by("loc")
        loc, m, radius = (t[c].to_numpy() for t, c in ((table, "loc"), (table, "m"), (queries, "radius")))
        q_loc, q_m = queries["loc"].to_numpy(), queries["m"].to_numpy()
        parts = []
        for row, place, near in _nearest(_points(table, axes), _points(queries, axes), k):
            keep = near <= radius[row]
            row, place, near = row[keep], place[keep], near[keep]
            parts.append((q_loc[row], q_m[row], loc[place], m[place], near))
        return pa.table([pa.array(np.concatenate(part)) for part in zip(*parts)], names)

    other = (
        copied.repartition(tasks, "leaf", "copy").groupBy("leaf", "copy")
        .cogroup(asked.repartition(tasks, "leaf", "copy").groupBy("leaf", "copy"))
        .applyInArrow(across, "loc long, m long, near long, near_m long, d2 double")
    )
    single = other.select("loc", "m", F.array(F.struct("d2", "near", "near_m")).alias("best"))
    return _nearest_of(own.unionByName(single), k, repeats=False)


def _visits(first: DataFrame, boxes: DataFrame, axes: Sequence[str], depth: int) -> DataFrame:
    """(loc, m, x0.., radius, home, leaf): each location with the leaves it asks, from the nodes in ``visits``."""
    asked = first.select(
        "loc", "m", *axes, "radius", F.col("leaf").alias("home"), F.explode("visits").alias("leaf")
    )
    return _descend(asked, boxes, axes, depth) if depth > 1 else asked


def _dealt(asked: DataFrame, treed: DataFrame, total: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Both with ``copy``: a leaf asked often is copied so that no task gets many more queries than ``block``."""
    load = []
    if total > block:
        load = asked.groupBy("leaf").count().filter(F.col("count") > block).collect()
    once = F.lit(0).cast("long")
    if not load:
        return asked.withColumn("copy", once), treed.withColumn("copy", once)
    busy = treed.sparkSession.createDataFrame(
        [(r["leaf"], math.ceil(r["count"] / block)) for r in load], "leaf long, copies long"
    )
    copies = F.coalesce("copies", F.lit(1).cast("long"))
    copy = F.pmod(F.xxhash64("loc"), copies)
    asked = asked.join(busy, "leaf", "left").withColumn("copy", copy).drop("copies")
    every = F.explode(F.sequence(once, copies - 1))
    return asked, treed.join(busy, "leaf", "left").withColumn("copy", every).drop("copies")


def _descend(asked: DataFrame, boxes: DataFrame, axes: Sequence[str], depth: int) -> DataFrame:
    """Points with nodes within their radius, down to the leaves."""
    boxes = pin(boxes)
    inner = boxes.select(F.col("parent").alias("leaf")).distinct()
    gaps = [F.greatest(F.col(f"lo_{x}") - F.col(x), F.col(x) - F.col(f"hi_{x}"), F.lit(0.0)) for x in axes]
    square = gaps[0] * gaps[0]
    for gap in gaps[1:]:
        square = square + gap * gap
    found = []
    for _ in range(depth - 1):
        found.append(asked.join(inner, "leaf", "left_anti"))
        below = boxes.withColumnRenamed("parent", "leaf")
        near = asked.join(below, "leaf").filter((square <= F.col("radius")) & (F.col("node") != F.col("home")))
        asked = near.select("loc", "m", *axes, "radius", "home", F.col("node").alias("leaf"))
    for part in found:
        asked = asked.unionByName(part)
    return asked


def _directions(columns: int, trees: int, seed: int) -> np.ndarray:
    """Random unit vectors, FOREST_DIRECTIONS for each tree."""
    drawn = np.random.default_rng(seed).normal(size=(trees, FOREST_DIRECTIONS, columns))
    return drawn / np.linalg.norm(drawn, axis=2, keepdims=True)


def _close(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, squared distance) of at least the k nearest others of each point, rows in order.

    A matrix product picks them, with room for what it rounds away; distances kept are exact.
    """
    count, columns = points.shape
    moved = points - points.mean(axis=0)
    length = np.einsum("ij,ij->i", moved, moved)
    turned = np.ascontiguousarray(-2.0 * moved.T)
    step = max(1, LEAF_CELLS // count)
    rows, places = [], []
    for start in range(0, count, step):
        block = moved[start : start + step]
        squared = block @ turned
        squared += length
        squared[np.arange(len(block)), np.arange(start, start + len(block))] = np.inf
        limit = np.full(len(block), np.finfo(np.float64).max)
        if k < count - 1:
            slack = 2e-14 * columns * (length[start : start + step] + length.max())
            limit = np.partition(squared, k - 1, axis=1)[:, k - 1] + 2.0 * slack
        row, place = np.divmod(np.flatnonzero(squared <= limit[:, None]), count)
        rows.append(row + start)
        places.append(place)
    row, place = np.concatenate(rows), np.concatenate(places)
    near = np.zeros(len(row))
    for axis in range(columns):
        gap = points[row, axis] - points[place, axis]
        near += gap * gap
    return row, place, near


def _keep_nearest(row: np.ndarray, place: np.ndarray, near: np.ndarray, best: np.ndarray, far: np.ndarray) -> None:
    """Put candidates, rows in order, into the lists ``best`` (-1: none) with distances ``far``."""
    k = best.shape[1]
    first = np.searchsorted(row, np.arange(len(best) + 1))
    for start in range(0, len(best), MERGE_ROWS):
        end = min(start + MERGE_ROWS, len(best))
        part = slice(first[start], first[end])
        order = slice(None)
        if part.stop - part.start > 4 * k * (end - start):
            order = np.lexsort((place[part], near[part], row[part]))  # many ties
        r, p, d = row[part][order], place[part][order], near[part][order]
        at = np.arange(len(r)) - np.searchsorted(r, r, side="left")
        if not isinstance(order, slice):
            r, p, d, at = (x[at < k] for x in (r, p, d, at))
        width = k + int(at.max(initial=-1)) + 1
        who = np.full((end - start, width), -1, best.dtype)
        how = np.full((end - start, width), np.inf)
        who[:, :k], how[:, :k] = best[start:end], far[start:end]
        who[r - start, k + at], how[r - start, k + at] = p, d
        # By distance, then by number: what came twice lies side by side.
        order = np.argsort(who, axis=1, kind="stable")
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(how, order, 1), axis=1, kind="stable"), 1)
        who, how = np.take_along_axis(who, order, 1), np.take_along_axis(how, order, 1)
        again = np.zeros(who.shape, bool)
        again[:, 1:] = (who[:, 1:] == who[:, :-1]) & (who[:, 1:] >= 0)
        order = np.argsort(again, axis=1, kind="stable")[:, :k]
        gone = np.take_along_axis(again, order, 1)
        best[start:end] = np.where(gone, -1, np.take_along_axis(who, order, 1))
        far[start:end] = np.where(gone, np.inf, np.take_along_axis(how, order, 1))


def _forest(points: np.ndarray, k: int, directions: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (-1: none) and squared distances of the k nearest that share a leaf of any tree."""
    best, far = np.full((len(points), k), -1, np.int32), np.full((len(points), k), np.inf)
    for tree in directions[: 1 if len(points) <= 2 * leaf_rows else None]:
        along = points @ tree.T
        open_, found = [np.arange(len(points))], []
        while open_:
            rows = open_.pop()
            if len(rows) > 2 * leaf_rows:
                part = along[rows]
                order = np.argsort(part[:, np.argmax(np.ptp(part, axis=0))], kind="stable")
                open_ += [np.sort(rows[half]) for half in np.array_split(order, 2)]
            elif len(rows) > 1:
                row, place, near = _close(points[rows], k)
                found.append((rows[row], rows[place], near))
        if found:
            row, place, near = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(row, kind="stable")
            _keep_nearest(row[order], place[order].astype(np.int32), near[order], best, far)
    return best, far


def _terms(queries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, own, slack): ``left @ right + own`` are squared distances, as far off as ``slack`` at most.

    Both come with a row for each axis. Single precision about the queries' middle does where squares
    neither vanish nor overflow. ``right`` is filled up to a multiple of eight, where distances are NaN.
    """
    center = queries.mean(axis=1, keepdims=True)
    moved, others = queries - center, points - center
    own, length = np.einsum("ij,ij->j", moved, moved), np.einsum("ij,ij->j", others, others)
    longest = max(own.max(), length.max())
    kind, share = (np.float32, 1e-6) if 1e-20 < longest < 1e30 else (np.float64, 2e-14)
    left, right = np.ones((moved.shape[1], len(moved) + 1), kind), np.empty((len(moved) + 1, -(-len(length) // 8) * 8), kind)
    left[:, :-1] = -2.0 * moved.T
    right[:-1, : len(length)], right[-1, : len(length)], right[:, len(length) :] = others, length, np.nan
    return left, right, own, share * (len(moved) + 4) * (own + length.max())


def _marked(mask: np.ndarray) -> np.ndarray:
    """Flat positions of what is true in rows of a multiple of eight; most words of eight are empty."""
    words = np.flatnonzero(mask.view(np.uint64))
    word, bit = np.nonzero(mask.reshape(-1, 8)[words])
    return words[word] * 8 + bit


class _Boxes:
    """A tree of median splits over points, down to boxes of at most BOX_ROWS rows that lie side by side."""

    def __init__(self, points: np.ndarray, group_rows: int = GROUP_ROWS):
        self.order = np.arange(len(points))
        moved, starts, groups, open_ = points.copy(), [], [], [(0, len(points), True)]
        while open_:
            start, end, outer = open_.pop()
            if outer and end - start <= group_rows:
                groups.append(start)
                outer = False
            if end - start <= BOX_ROWS:
                starts.append(start)
                continue
            part, half = moved[start:end], (end - start) // 2
            turn = np.argpartition(part[:, np.argmax(part.max(axis=0) - part.min(axis=0))], half)
            moved[start:end], self.order[start:end] = part[turn], self.order[start:end][turn]
            open_ += [(start + half, end, outer), (start, start + half, outer)]
        # From here on a row for each axis, in the order of the boxes.
        self.at, self.starts, self.groups = np.ascontiguousarray(moved.T), np.array(starts), np.array(groups)
        self.ends = np.append(self.starts[1:], len(points))
        self.low = np.minimum.reduceat(self.at, self.starts, axis=1)
        self.high = np.maximum.reduceat(self.at, self.starts, axis=1)

    def blocks(self, rows: np.ndarray | None = None) -> list[np.ndarray]:
        """The positions of all or the given points, those of a box together."""
        if rows is None:
            return np.split(self.order, self.starts[1:])
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(place))
        place = np.sort(place[rows])
        split = np.split(self.order[place], np.searchsorted(place, self.starts[1:]))
        return [block for block in split if len(block)]

    def within(self, block: np.ndarray, radius: float) -> np.ndarray:
        """Numbers of the boxes with anything within the radius, squared, of the box of some points."""
        low, high = block.min(axis=1, keepdims=True), block.max(axis=1, keepdims=True)
        gap = np.maximum(np.maximum(self.low - high, low - self.high), 0.0)
        return np.flatnonzero(np.einsum("ij,ij->j", gap, gap) <= radius)

    def bounds(self, k: int) -> np.ndarray:
        """No less than the squared distance of each point's k-th nearest other point."""
        out = np.full(len(self.order), np.inf)
        for start, end in zip(self.groups, np.append(self.groups[1:], len(out))):
            if end - start > k:
                left, right, own, slack = _terms(self.at[:, start:end], self.at[:, start:end])
                # The point itself is among them.
                squared = np.partition((left @ right)[:, : end - start], k, axis=1)[:, k]
                out[self.order[start:end]] = squared + own + 2.0 * slack
        return out

    def compared(self, radius: np.ndarray) -> float:
        """How many points a point is compared with, on average over some boxes."""
        tried = np.unique(np.linspace(0, len(self.starts) - 1, BOXES_TRIED).astype(int))
        held, rows = self.ends - self.starts, 0
        for box in tried:
            start, end = self.starts[box], self.ends[box]
            rows += held[self.within(self.at[:, start:end], radius[self.order[start:end]].max())].sum()
        return rows / len(tried)

    def nearest(
        self, queries: np.ndarray, radius: np.ndarray, k: int, blocks: Sequence[np.ndarray], own: bool
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, best, far) of some queries at a time: positions (-1: none) and squared distances of up to
        k nearest points within each query's squared radius, ties in the order of points.

        ``blocks`` name the queries, those near each other together. With ``own`` they are the points.
        """
        queries = np.ascontiguousarray(queries.T)
        found, held = [], 0
        for block in blocks:
            boxes = self.within(queries.take(block, axis=1), radius[block].max())
            if not len(boxes):
                continue
            held_by = self.ends[boxes] - self.starts[boxes]
            near = np.arange(held_by.sum()) + np.repeat(self.starts[boxes] - np.cumsum(held_by) + held_by, held_by)
            points = self.at.take(near, axis=1)
            step = max(1, BOX_CELLS // len(near))
            for rows in (block[i : i + step] for i in range(0, len(block), step)):
                left, right, length, slack = _terms(queries.take(rows, axis=1), points)
                squared = left @ right
                most = (radius[rows] - length + slack).astype(squared.dtype)
                flat = _marked(squared <= most[:, None])
                row, place = np.divmod(flat, squared.shape[1])
                if own:
                    other = self.order[near[place]] != rows[row]
                    flat, row, place = flat[other], row[other], place[other]
                several = np.bincount(row, minlength=len(rows))
                if several.max() > k:
                    # Those that may be among the k nearest, whatever was rounded away.
                    values = squared.ravel()[flat]
                    table = np.full((len(rows), several.max()), np.inf, squared.dtype)
                    table[row, np.arange(len(row)) - (np.cumsum(several) - several)[row]] = values
                    last = np.partition(table, k - 1, axis=1)[:, k - 1] + (3.0 * slack).astype(squared.dtype)
                    keep = values <= last[row]
                    row, place = row[keep], place[keep]
                found.append((rows[row], near[place]))
                held += len(row)
            if held > MERGE_ROWS * k:
                yield self._lists(queries, radius, k, found)
                found, held = [], 0
        if held:
            yield self._lists(queries, radius, k, found)

    def _lists(self, queries: np.ndarray, radius: np.ndarray, k: int, found: Sequence) -> tuple:
        row, place = (np.concatenate(part) for part in zip(*found))
        squared = np.zeros(len(row))
        for mine, theirs in zip(queries, self.at):
            gap = mine[row] - theirs[place]
            squared += gap * gap
        keep = squared <= radius[row]
        row, place, squared = row[keep], self.order[place[keep]], squared[keep]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        several = np.diff(np.append(first, len(row)))
        at = np.repeat(np.arange(len(first)), several), np.arange(len(row)) - np.repeat(first, several)
        best = np.full((len(first), max(k, several.max(initial=0))), -1)
        far = np.full(best.shape, np.inf)
        best[at], far[at] = place, squared
        order = np.argsort(best, axis=1)
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(far, order, 1), axis=1, kind="stable")[:, :k], 1)
        return row[first], np.take_along_axis(best, order, 1), np.take_along_axis(far, order, 1)


def _useful_boxes(points: np.ndarray, k: int, trees: int, leaf_rows: int) -> tuple[_Boxes, np.ndarray] | None:
    """Boxes and a first squared radius of each point, unless they compare more pairs than trees would."""
    boxes = _Boxes(points, max(GROUP_ROWS, 4 * k))
    radius = boxes.bounds(k)
    return (boxes, radius) if boxes.compared(radius) <= 2 * trees * leaf_rows else None


def _in_part(points: np.ndarray, k: int, directions: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (-1: none) and squared distances of the k nearest others, all where boxes find them."""
    best, far = np.full((len(points), k), -1, np.int32), np.full((len(points), k), np.inf)
    finite = np.flatnonzero(np.isfinite(points).all(axis=1))
    if len(finite) < 2:
        return best, far
    inner = points if len(finite) == len(points) else points[finite]
    useful = _useful_boxes(inner, k, len(directions), leaf_rows)
    if useful is None:
        place, near = _forest(inner, k, directions, leaf_rows)
        best[finite], far[finite] = np.where(place < 0, -1, finite[place]), near
        return best, far
    boxes, radius = useful
    for row, place, near in boxes.nearest(inner, radius, k, boxes.blocks(), True):
        best[finite[row]], far[finite[row]] = np.where(place < 0, -1, finite[place]), near
    return best, far


def forest_parts(places: DataFrame, total: int, seed: int) -> tuple[DataFrame, list[str]]:
    """Add ``p0``, ``p1``..: the part each location lies in, for several ways to cut them all.

    A part holds at most twice FOREST_PART_ROWS rows, so few neighbours lie across a border, and
    hardly one across a border of every cut. Rows that fit one part are one part. A first cut that
    ``places`` bring as ``p0`` stays.
    """
    axes = _axes(places)
    cuts = 1 if total <= 2 * FOREST_PART_ROWS else FOREST_CUTS
    for number, tree in enumerate(_directions(len(axes), cuts, seed + 1)):
        if f"p{number}" in places.columns:
            continue
        along = F.array(*[sum((F.col(x) * float(w) for x, w in zip(axes, way)), F.lit(0.0)) for way in tree])
        places, _ = with_leaves(places, along, FOREST_PART_ROWS, total)
        places = places.withColumnRenamed("leaf", f"p{number}")
    return places, [f"p{number}" for number in range(cuts)]


def forest_locations(
    places: DataFrame, k: int, trees: int = FOREST_TREES, leaf_rows: int = FOREST_LEAF_ROWS, seed: int = 17
) -> DataFrame:
    """(loc, m, near, near_m, d2): nearest others among those that share a leaf of any tree."""
    return _rows(forest_lists(places, k, trees, leaf_rows, seed))


def forest_lists(
    places: DataFrame, k: int, trees: int = FOREST_TREES, leaf_rows: int = FOREST_LEAF_ROWS, seed: int = 17
) -> DataFrame:
    """(loc, m, best): the same as one list of (d2, near, near_m) for each location.

    In every part of every cut, trees cut the rows at medians of random directions, always along the
    widest; a leaf holds at most twice ``leaf_rows`` rows. Distances are exact; of the true k nearest
    some are missed.
    """
    total = places.count()
    parted, cuts = forest_parts(places, total, seed)
    directions = _directions(len(_axes(places)), trees, seed)
    found = [_far_lists(parted, cuts[i : i + 1], k, directions, leaf_rows, total) for i in range(len(cuts))]
    lists = found[0]
    for one in found[1:]:
        lists = lists.unionByName(one)
    best = F.arrays_zip("d2", "near", "near_m").alias("best")
    return _nearest_of(lists.select("loc", "m", best), k, repeats=True)


def _far_lists(
    parted: DataFrame, cuts: Sequence[str], k: int, directions: np.ndarray, leaf_rows: int, total: int
) -> DataFrame:
    """(loc, m, <first cut>, near, near_m, d2): neighbours in the part of the last cut that lie in no part of the others.

    Where ``parted`` has a ``radius``, squared, no neighbour lies beyond it.
    """
    axes, own, home = _axes(parted), cuts[-1], cuts[0]
    bounded = "radius" in parted.columns

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("loc")
        best, far = _in_part(_points(table, axes), k, directions, leaf_rows)
        keep = best >= 0
        for cut in cuts[:-1]:
            part = table[cut].to_numpy()
            keep &= part[best] != part[:, None]
        if bounded:
            keep &= far <= table["radius"].to_numpy()[:, None]
        row, column = np.nonzero(keep)
        out = _with_lists(table.select(["loc", "m", home]), row, best[row, column], far[row, column])
        return out.filter(pa.array(keep.any(axis=1) | (len(cuts) == 1)))

    columns = ["loc", "m", *axes, *cuts, *(["radius"] if bounded else [])]
    schema = f"loc long, m long, {home} long, near array<long>, near_m array<long>, d2 array<double>"
    tasks = python_tasks(parted, max(1, 4 * total // FOREST_PART_ROWS))
    return parted.select(*columns).repartition(tasks, own).groupBy(own).applyInArrow(search, schema)


def _used(m: np.ndarray, near_m: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """How often each neighbour of a list, nearest first, counts among the k beside a point's copies."""
    several = np.where(np.isfinite(far), near_m, 0)
    before = np.cumsum(several, axis=1) - several
    return np.clip(np.maximum(k - m + 1, 0)[:, None] - before, 0, several)


def _beyond(
    treed: DataFrame, depth: int, k: int, directions: np.ndarray, leaf_rows: int, total: int
) -> DataFrame | None:
    """(loc, m, p0, near, near_m, d2): all neighbours in other parts, of each that is asked one row.

    None if boxes are of no use in some part, or too many parts would be asked.
    """
    axes = _axes(treed)
    nodes = _boxes(treed, axes, depth)
    top = nodes.filter("parent = 0").orderBy("node").toPandas()
    node, low, high = (top[c].to_numpy() for c in ("node", [f"lo_{x}" for x in axes], [f"hi_{x}" for x in axes]))

    def asks(table: pa.Table) -> pa.Table:
        """Rows that may have neighbours in other parts, with the radius of those in their own."""
        table = table.combine_chunks().sort_by("loc")
        home, points = table["leaf"][0].as_py(), _points(table, axes)
        finite = np.flatnonzero(np.isfinite(points).all(axis=1))
        points, away = points[finite], np.flatnonzero(node != home)
        useful = _useful_boxes(points, k, len(directions), leaf_rows) if len(points) > 1 else None
        row, part, gaps, held = [], [], [], 0
        if useful is not None:
            boxes, radius = useful
            lows, highs = (np.ascontiguousarray(side[away].T) for side in (low, high))
            for block, start, end in zip(boxes.blocks(), boxes.starts, boxes.ends):
                at = boxes.at[:, start:end]
                gap = np.maximum(lows - at.max(axis=1, keepdims=True), at.min(axis=1, keepdims=True) - highs)
                gap = np.maximum(gap, 0.0)
                some = np.flatnonzero(np.einsum("ij,ij->j", gap, gap) <= radius[block].max())
                squared = np.zeros((len(block), len(some)))
                for x, first, last in zip(at, lows, highs):
                    gap = np.maximum(np.maximum(first[some] - x[:, None], x[:, None] - last[some]), 0.0)
                    squared += gap * gap
                r, c = np.nonzero(squared <= radius[block, None])
                row.append(block[r])
                part.append(away[some[c]])
                gaps.append(squared[r, c])
                held += len(r)
                if held > PART_VISITS * len(points):
                    useful = None
                    break
        out = table.select(["loc", "m", *axes, "leaf"])
        if useful is None and len(points):
            out = out.slice(0, 1)  # a row without visits: further cuts are needed
            return out.append_column("visits", pa.array([None], pa.list_(pa.int64()))).append_column("radius", pa.array([0.0]))
        row, part, gaps = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, part, gaps))
        rows = np.unique(row)
        if len(rows):
            for who, _, far in boxes.nearest(points, radius, k, boxes.blocks(rows), True):
                radius[who] = far[:, -1]
            keep = gaps <= radius[row]
            row, part = row[keep], part[keep]
            order = np.argsort(row, kind="stable")
            row, part = row[order], part[order]
            rows = np.unique(row)
        out = out.take(pa.array(finite[rows]))
        visits = _lists(np.searchsorted(rows, row), len(rows), node[part])
        return out.append_column("visits", visits).append_column("radius", pa.array(radius[rows] if len(rows) else np.zeros(0)))

    cells = ", ".join(f"{x} double" for x in axes)
    tasks = python_tasks(treed, max(1, 4 * total // FOREST_PART_ROWS))
    first = pin(
        treed.repartition(tasks, "leaf").groupBy("leaf")
        .applyInArrow(asks, f"loc long, m long, {cells}, leaf long, visits array<long>, radius double")
    )
    tally = first.agg(
        F.count_if(F.col("visits").isNull()).alias("without"),
        F.coalesce(F.sum(F.size("visits")), F.lit(0)).alias("visits"),
    ).first()
    if tally["without"] or tally["visits"] > FOREST_VISITS * total:
        return None

    def across(table: pa.Table, queries: pa.Table) -> pa.Table:
        parts = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if table.num_rows and queries.num_rows:
            table = table.combine_chunks().sort_by("loc")
            points, asked = _points(table, axes), _points(queries, axes)
            finite = np.flatnonzero(np.isfinite(points).all(axis=1))
            if len(finite):
                boxes, radius = _Boxes(points[finite]), queries["radius"].to_numpy()
                for row, best, far in boxes.nearest(asked, radius, k, _Boxes(asked).blocks(), False):
                    r, c = np.nonzero(best >= 0)
                    for part, values in zip(parts, (row[r], finite[best[r, c]], far[r, c])):
                        part.append(values)
        row, place, near = (np.concatenate(part) for part in parts)
        order = np.argsort(row, kind="stable")
        rows, row = np.unique(row[order], return_inverse=True)
        out = queries.select(["loc", "m", "home"]).rename_columns(["loc", "m", "p0"]).combine_chunks().take(pa.array(rows))
        for name, values in (("near", table["loc"]), ("near_m", table["m"])):
            out = out.append_column(name, _lists(row, len(rows), values.to_numpy()[place[order]]))
        return out.append_column("d2", _lists(row, len(rows), near[order]))

    asked, copied = _dealt(_visits(first, nodes, axes, depth), treed, total, PART_QUERIES)
    return (
        copied.repartition(tasks, "leaf", "copy").groupBy("leaf", "copy")
        .cogroup(asked.repartition(tasks, "leaf", "copy").groupBy("leaf", "copy"))
        .applyInArrow(across, "loc long, m long, p0 long, near array<long>, near_m array<long>, d2 array<double>")
    )


def _beyond_cuts(
    parted: DataFrame, cuts: Sequence[str], k: int, directions: np.ndarray, leaf_rows: int, total: int
) -> DataFrame:
    """The same from the other cuts: neighbours that share a part of any, of each cut one row."""
    axes, home = _axes(parted), cuts[0]
    tasks = python_tasks(parted, max(1, 4 * total // FOREST_PART_ROWS))

    def radius(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("loc")
        _, far = _in_part(_points(table, axes), k, directions, leaf_rows)
        return table.append_column("radius", pa.array(far[:, -1]))

    columns = ["loc", "m", *axes, *cuts]
    kinds = "loc long, m long, " + ", ".join(f"{x} double" for x in axes) + ", " + ", ".join(f"{c} long" for c in cuts)
    bounded = pin(parted.select(*columns).repartition(tasks, home).groupBy(home).applyInArrow(radius, f"{kinds}, radius double"))
    found = [_far_lists(bounded, cuts[: last + 1], k, directions, leaf_rows, total) for last in range(1, len(cuts))]
    across = found[0]
    for one in found[1:]:
        across = across.unionByName(one)
    return across


def _spots(
    parted: DataFrame, across: DataFrame | None, k: int, directions: np.ndarray, leaf_rows: int, total: int
) -> DataFrame:
    """(loc, m, x0.., p0, k_distance, reach, near, w, far..): neighbours found, and the reach over near ones.

    ``near`` are places within the part ``p0``, in order of ``loc``, and ``w`` how often each counts;
    ``far``, ``far_w`` and ``far_d`` are of neighbours in other parts, which few locations have, from
    ``across``.
    """
    axes, home = _axes(parted), "p0"
    tasks = python_tasks(parted, max(1, 4 * total // FOREST_PART_ROWS))

    def settle(table: pa.Table, others: pa.Table | None) -> pa.Table:
        table = table.combine_chunks().sort_by("loc")
        loc, m = table["loc"].to_numpy(), table["m"].to_numpy()
        place, square = _in_part(_points(table, axes), k, directions, leaf_rows)
        place = place.astype(np.int64)
        name, near_m, foreign = loc[place], m[place], np.zeros(place.shape, bool)
        if others is not None and others.num_rows:
            others = others.combine_chunks()
            held = np.diff(others["near"].combine_chunks().offsets.to_numpy())
            row = np.repeat(np.searchsorted(loc, others["loc"].to_numpy()), held)
            order = np.argsort(row, kind="stable")
            row = row[order]
            at = k + np.arange(len(row)) - np.searchsorted(row, row, side="left")
            rows, line = np.unique(row, return_inverse=True)
            more = int(at.max(initial=k - 1)) + 1 - k

            def wider(cells: np.ndarray, fill, column: str | None) -> np.ndarray:
                out = np.concatenate((cells[rows], np.full((len(rows), more), fill, cells.dtype)), axis=1)
                out[line, at] = True if column is None else others[column].combine_chunks().flatten().to_numpy()[order]
                return out

            # Only rows with neighbours in other parts are ordered anew; no more than k are used.
            names, squares = wider(name, 0, "near"), wider(square, np.inf, "d2")
            best = np.lexsort((names, squares), axis=1)[:, :k]
            places = np.concatenate((place[rows], np.full((len(rows), more), -1)), axis=1)
            for cells, new in (
                (place, places), (name, names), (near_m, wider(near_m, 0, "near_m")), (square, squares),
                (foreign, wider(foreign, False, None)),
            ):
                cells[rows] = np.take_along_axis(new, best, 1)
        weight = _used(m, near_m, square, k)
        distance = np.sqrt(square)
        used = weight > 0
        k_distance = np.where(used, distance, 0.0).max(axis=1, initial=0.0)
        near = used & ~foreign
        row, column = np.nonzero(near)
        reach = np.bincount(
            row, weight[row, column] * np.maximum(distance[row, column], k_distance[place[row, column]]), len(loc)
        ).astype(float)  # of nothing it counts in whole numbers
        out = table.select(["loc", "m", *axes, home]).append_column("k_distance", pa.array(k_distance))
        out = out.append_column("reach", pa.array(reach))
        out = out.append_column("near", _lists(row, len(loc), place[row, column].astype(np.int32)))
        out = out.append_column("w", _lists(row, len(loc), weight[row, column].astype(np.int32)))
        row, column = np.nonzero(used & foreign)
        for title, cells in (("far", name), ("far_w", weight), ("far_d", distance)):
            out = out.append_column(title, _lists(row, len(loc), cells[row, column]))
        return out

    schema = (
        "loc long, m long, " + ", ".join(f"{x} double" for x in axes) + f", {home} long, k_distance double, "
        "reach double, near array<int>, w array<int>, far array<long>, far_w array<long>, far_d array<double>"
    )
    grouped = parted.select("loc", "m", *axes, home).repartition(tasks, home).groupBy(home)
    if across is None:
        return pin(grouped.applyInArrow(lambda table: settle(table, None), schema))
    return pin(grouped.cogroup(across.repartition(tasks, home).groupBy(home)).applyInArrow(settle, schema))


def _forest_factor(places: DataFrame, k: int, leaf_rows: int, trees: int = FOREST_TREES, seed: int = 17) -> DataFrame:
    """(x0.., lof). Lists of neighbours stay in the parts that find them: a part holds all its rows, so
    densities of neighbours are looked up there. Only neighbours in other parts are joined, and for those
    alone a table of distances and densities is made."""
    total, axes = places.count(), _axes(places)
    directions = _directions(len(axes), trees, seed)
    treed, depth = with_leaves(places, F.array(*axes), FOREST_PART_ROWS, total)
    parted, across, home = treed.withColumnRenamed("leaf", "p0"), None, "p0"
    if depth:
        across = _beyond(treed, depth, k, directions, leaf_rows, total)
        if across is None:
            parted, cuts = forest_parts(parted, total, seed)
            across = _beyond_cuts(parted, cuts, k, directions[: max(1, trees // 2)], leaf_rows, total)
    spots = _spots(parted, across, k, directions, leaf_rows, total)
    tasks = python_tasks(places, max(1, 4 * total // FOREST_PART_ROWS))
    own = spots.select("loc", *axes, home, F.least(F.col("m") - 1, F.lit(k)).alias("copies"), "k_distance", "reach", "near", "w")

    def factors(lists: pa.Table, sums: pa.Table | None) -> pa.Table:
        lists = lists.combine_chunks().sort_by("loc")
        loc, copies, reach = (lists[c].to_numpy() for c in ("loc", "copies", "reach"))
        beyond = np.zeros(len(loc))
        if sums is not None and sums.num_rows:
            at = np.searchsorted(loc, sums["loc"].to_numpy())
            reach, beyond[at] = reach.copy(), sums["far_density"].to_numpy()
            reach[at] += sums["far_reach"].to_numpy()
        density = 1.0 / ((reach + copies * lists["k_distance"].to_numpy()) / k + 1e-10)
        near, w = lists["near"].combine_chunks(), lists["w"].combine_chunks().flatten().to_numpy()
        row = np.repeat(np.arange(len(loc)), np.diff(near.offsets.to_numpy()))
        around = np.bincount(row, w * density[near.flatten().to_numpy()], len(loc)) + beyond
        return lists.select(axes).append_column("lof", pa.array(-(around + copies * density) / k / density))

    schema = ", ".join(f"{x} double" for x in axes) + ", lof double"
    grouped = own.repartition(tasks, home).groupBy(home)
    if across is None:
        return grouped.applyInArrow(lambda lists: factors(lists, None), schema)
    one = F.explode(F.arrays_zip("far", "far_w", "far_d")).alias("one")
    away = pin(spots.where(F.size("far") > 0).select("loc", one).select(
        "loc", F.col("one.far").alias("near"), F.col("one.far_w").alias("w"), F.col("one.far_d").alias("d")
    ))
    named = away.select("loc").union(away.select("near")).distinct()
    edge = pin(own.select("loc", home, "copies", "k_distance", "reach").join(named, "loc", "left_semi"))

    def summed(values: DataFrame, value: str, each: Column, name: str) -> DataFrame:
        """(loc, name): ``each`` over the neighbours in other parts."""
        target = values.select(F.col("loc").alias("near"), F.col(value).alias("of_near"))
        return away.join(target, "near").groupBy("loc").agg(F.sum(each).alias(name))

    far_reach = summed(edge, "k_distance", F.col("w") * F.greatest("d", "of_near"), "far_reach")
    reached = F.col("reach") + F.coalesce("far_reach", F.lit(0.0)) + F.col("copies") * F.col("k_distance")
    dense = pin(
        edge.join(far_reach, "loc", "left")
        .select("loc", home, "far_reach", (1.0 / (reached / k + 1e-10)).alias("density"))
    )
    far_density = summed(dense, "density", F.col("w") * F.col("of_near"), "far_density")
    sums = dense.join(far_density, "loc").select("loc", home, "far_reach", "far_density")
    return grouped.cogroup(sums.repartition(tasks, home).groupBy(home)).applyInArrow(factors, schema)


SEARCHES = ("exact", "forest")


def local_outlier_factor(
    data: DataFrame, names: Sequence[str], k: int, total: int, leaf_rows: int | None = None, search: str = "exact"
) -> DataFrame:
    """(x0.., lof): negative outlier factor of each distinct row of ``names``."""
    if search not in SEARCHES:
        raise ValueError(f"search must be one of {SEARCHES}, not {search!r}")
    k = min(k, total - 1)
    places = locations(data, names)
    if search == "forest":
        return _forest_factor(places, k, leaf_rows or FOREST_LEAF_ROWS)
    near = nearest_lists(places, k, leaf_rows or LEAF_ROWS)
    # Copies of a point are its nearest neighbours, at distance 0; the rest of
    # the k come from other locations, each counted with its multiplicity.
    copies = F.least(F.col("m") - 1, F.lit(k))
    open_slots = f"greatest({k} - m + 1, 0)"
    weights = F.expr(
        f"IF(m = 1 AND forall(best, n -> n.near_m = 1), transform(best, n -> 1L), transform(best, (n, i) -> "
        f"least(n.near_m, {open_slots} - aggregate(slice(best, 1, i), 0L, (s, x) -> s + x.near_m))))"
    )
    used = F.filter(
        F.transform(F.arrays_zip("best", "w"), lambda n: F.struct(
            n["best"]["near"].alias("near"), n["w"].alias("w"), F.sqrt(n["best"]["d2"]).alias("d"))),
        lambda n: n["w"] > 0,
    )
    last = F.coalesce(F.element_at("used", -1)["d"], F.lit(0.0))
    spots = pin(
        near.withColumn("w", weights)
        .select("loc", copies.alias("copies"), used.alias("used"))
        .withColumn("k_distance", F.when(F.size("used") > 0, last).otherwise(0.0))
    )
    links = spots.select("loc", "copies", "k_distance", F.inline_outer("used"))
    target = spots.select(F.col("loc").alias("near"), F.col("k_distance").alias("near_distance"))
    # A location of nothing but copies has no links; its row stays.
    reach = F.coalesce(F.sum(F.col("w") * F.greatest("d", "near_distance")), F.lit(0.0))
    total_reach = reach + F.col("copies") * F.col("k_distance")
    density = pin(
        links.join(target, "near", "left").groupBy("loc", "copies", "k_distance")
        .agg((1.0 / (total_reach / k + 1e-10)).alias("density"))
    )
    around = density.select(F.col("loc").alias("near"), F.col("density").alias("near_density"))
    summed = links.join(around, "near", "left").groupBy("loc").agg(
        F.coalesce(F.sum(F.col("w") * F.col("near_density")), F.lit(0.0)).alias("around")
    )
    factor = -(F.col("around") + F.col("copies") * F.col("density")) / k / F.col("density")
    scored = density.join(summed, "loc").select("loc", factor.alias("lof"))
    return places.join(scored, "loc").drop("loc", "m")
