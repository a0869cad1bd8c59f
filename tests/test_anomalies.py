"""Neighbours and outlier factors against brute force; forests by planted rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.config import QualityConfig
from plumbline.operators import anomalies
from plumbline.operators.isolation import isolation_scores, tree_samples
from plumbline.operators.neighbours import (
    forest_locations, local_outlier_factor, locations, nearest_locations,
)

CONFIG = QualityConfig()


def brute_force_lof(points: np.ndarray, k: int) -> np.ndarray:
    n = len(points)
    order = np.lexsort(points.T[::-1])
    place = np.empty(n, dtype=int)
    place[order] = np.arange(n)
    near, dist = np.empty((n, k), dtype=int), np.empty((n, k))
    for i in range(n):
        gap = points - points[i]
        squared = (gap * gap).sum(axis=1)
        squared[i] = np.inf
        near[i] = np.lexsort((place, squared))[:k]
        dist[i] = np.sqrt(squared[near[i]])
    k_distance = dist.max(axis=1)
    density = 1.0 / (np.maximum(k_distance[near], dist).mean(axis=1) + 1e-10)
    return -density[near].mean(axis=1) / density


def clouds(kind: str) -> np.ndarray:
    random = np.random.default_rng(5)
    if kind == "plane":
        return random.normal(size=(600, 2))
    if kind == "grid":
        return random.integers(0, 12, size=(600, 2)).astype(float)
    if kind == "hot point":
        points = random.normal(size=(600, 3))
        points[::3] = [0.5, 0.5, 0.5]
        return points
    if kind == "line":
        return np.column_stack([random.integers(0, 300, 600).astype(float), np.zeros(600)])
    return random.normal(size=(400, 6))


@pytest.mark.parametrize("kind", ["plane", "grid", "hot point", "line", "many columns"])
def test_lof_equals_brute_force_over_many_leaves(spark, kind):
    points = clouds(kind)
    names = [f"c{i}" for i in range(points.shape[1])]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)],
                               "k long, " + ", ".join(f"{c} double" for c in names))
    scored = anomalies.lof_scores(df, names, len(points), CONFIG, leaf_rows=40)
    found = np.array([r["lof_score"] for r in scored.orderBy("k").collect()])
    assert found == pytest.approx(brute_force_lof(points, 20), rel=1e-9)


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (5.0, 0.0)], "a double, b double")
    scored = local_outlier_factor(df, ["a", "b"], 20, 3)
    expected = brute_force_lof(np.array([[0.0, 0.0], [1.0, 0.0], [5.0, 0.0]]), 2)
    assert [r["lof"] for r in scored.orderBy("x0").collect()] == pytest.approx(expected)


def test_copied_leaves_give_the_same_neighbours(spark, monkeypatch):
    from plumbline.operators import neighbours

    points = clouds("plane")
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "a double, b double")
    places = locations(df, ["a", "b"])
    plain = sorted(nearest_locations(places, 5, 40).select("loc", "near").collect())
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    assert sorted(nearest_locations(places, 5, 40).select("loc", "near").collect()) == plain


def sizes(treed):
    return [r["count"] for r in treed.groupBy("leaf").count().collect()]


@pytest.mark.parametrize("kind", ["plane", "grid", "hot point", "many columns"])
def test_leaves_are_cut_until_small(spark, monkeypatch, kind):
    """Two children a cut and few sampled rows: many levels, the same neighbours, no large leaf."""
    from plumbline.operators import neighbours

    monkeypatch.setattr(neighbours, "FAN_LEVELS", 1)
    monkeypatch.setattr(neighbours, "SAMPLE_PER_LEAF", 16)
    points = clouds(kind)
    names = [f"c{i}" for i in range(points.shape[1])]
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], ", ".join(f"{c} double" for c in names))
    places = locations(df, names)
    at = F.array(*[c for c in places.columns if c.startswith("x")])
    treed, depth = neighbours.with_leaves(places, at, 40, places.count())
    assert depth > 1 and max(sizes(treed)) <= 80 and sum(sizes(treed)) == places.count()
    deep = sorted(nearest_locations(places, 5, 40).select("loc", "near").collect())
    plain = sorted(nearest_locations(places, 5, 10**6).select("loc", "near").collect())
    assert deep == plain


def test_forest_finds_nearly_all_neighbours(spark):
    random = np.random.default_rng(8)
    centers = random.normal(size=(12, 15)) * 4
    points = centers[random.integers(0, 12, 4000)] + random.normal(size=(4000, 15))
    points[:40] += random.normal(size=(40, 15)) * 12
    points[100:140] = points[100]
    names = [f"c{i}" for i in range(15)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)],
                               "k long, " + ", ".join(f"{c} double" for c in names))
    places = locations(df, names)
    exact = {tuple(r) for r in nearest_locations(places, 20).select("loc", "near", "d2").collect()}
    found = {tuple(r) for r in forest_locations(places, 20, leaf_rows=200).select("loc", "near", "d2").collect()}
    # What is found has its true distance, and hardly a neighbour is missed.
    assert len(found & exact) >= 0.9 * len(exact)
    assert len(found) == len(exact)

    flags = {}
    for search in ("exact", "forest"):
        config = QualityConfig(anomaly_neighbour_search=search)
        scored = anomalies.lof_scores(df, names, 4000, config, leaf_rows=200)
        flagged = anomalies.flag_lowest(scored, ["lof_score"], 4000, 0.1).filter("lof_flag")
        flags[search] = {r["k"] for r in flagged.select("k").collect()}
    assert len(flags["exact"] & flags["forest"]) >= 0.9 * len(flags["exact"])
    assert set(range(40)) <= flags["forest"]


def test_forest_of_few_or_equal_rows(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (5.0, 0.0)] + [(2.0, 2.0)] * 50, "a double, b double")
    exact = local_outlier_factor(df, ["a", "b"], 20, 53).orderBy("x0").collect()
    assert local_outlier_factor(df, ["a", "b"], 20, 53, search="forest").orderBy("x0").collect() == exact
    same = spark.createDataFrame([(1.0, 2.0)] * 60, "a double, b double")
    assert local_outlier_factor(same, ["a", "b"], 20, 60, search="forest").count() == 1
    with pytest.raises(ValueError):
        local_outlier_factor(df, ["a", "b"], 20, 53, search="some")


def test_forest_in_parts_keeps_lists_in_their_tasks(spark, monkeypatch):
    """Parts smaller than the table: factors near the exact ones, no table of rows x trees or of all distances."""
    from plumbline.operators import neighbours

    random = np.random.default_rng(3)
    points = random.normal(size=(1500, 4))
    points[:200] = np.round(points[:200])  # many ties and copies
    names = [f"c{i}" for i in range(4)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)],
                               "k long, " + ", ".join(f"{c} double" for c in names))
    exact = {r["k"]: r["lof_score"] for r in anomalies.lof_scores(df, names, 1500, CONFIG).collect()}
    stored = []

    def watched(frame):
        kept = pin(frame)
        lists = [c for c, t in kept.dtypes if t == "array<double>" and not c.startswith("far")]
        stored.append((kept.count() if "x0" in kept.columns else 0, lists))
        return kept

    pin = neighbours.pin
    monkeypatch.setattr(neighbours, "pin", watched)
    if hasattr(neighbours, "FOREST_PART_ROWS"):
        monkeypatch.setattr(neighbours, "FOREST_PART_ROWS", 300)
        monkeypatch.setattr(neighbours, "FOREST_CUTS", 8)
    config = QualityConfig(anomaly_neighbour_search="forest")
    scored = anomalies.lof_scores(df, names, 1500, config, leaf_rows=1000)
    found = {r["k"]: r["lof_score"] for r in scored.collect()}
    places = locations(df, names).count()
    assert max(rows for rows, _ in stored) <= places and not any(lists for _, lists in stored)
    close = [k for k in exact if abs(found[k] - exact[k]) <= 1e-9 * abs(exact[k])]
    # A factor is exact if none of 400 neighbours' neighbours is missed.
    assert len(found) == 1500 and len(close) >= 0.25 * len(exact)
    assert np.mean([abs(found[k] / exact[k] - 1) for k in exact]) < 0.01


def wide_and_narrow(rows: int) -> np.ndarray:
    """Eight columns of which three are wide, as keys and prices beside shares; copies, ties and far rows too."""
    random = np.random.default_rng(21)
    points = random.uniform(size=(rows, 8)) * [1000, 800, 1200, 60, 9, 1, 0.1, 0.1]
    points[:200] = np.round(points[:200] / 40) * 40
    points[200:260] = points[200]
    points[260:270] *= 1e5
    return points


@pytest.mark.parametrize("cuts", ["asked", "cut again"])
def test_forest_is_exact_where_boxes_keep_rows_apart(spark, monkeypatch, cuts):
    """Over many parts no neighbour is missed, in a part or beyond its border, and trees are not needed."""
    from plumbline.operators import neighbours

    points = wide_and_narrow(3000)
    names = [f"c{i}" for i in range(8)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)],
                               "k long, " + ", ".join(f"{c} double" for c in names))
    monkeypatch.setattr(neighbours, "FOREST_PART_ROWS", 400)
    if cuts == "cut again":
        monkeypatch.setattr(neighbours, "FOREST_VISITS", 0)
        monkeypatch.setattr(neighbours, "FOREST_CUTS", 8)
    if hasattr(neighbours, "_useful_boxes"):
        monkeypatch.setattr(neighbours, "BOX_ROWS", 16)
    config = QualityConfig(anomaly_neighbour_search="forest")
    found = np.array([r["lof_score"] for r in anomalies.lof_scores(df, names, 3000, config, leaf_rows=50).orderBy("k").collect()])
    exact = np.array([r["lof_score"] for r in anomalies.lof_scores(df, names, 3000, CONFIG).orderBy("k").collect()])
    off = np.abs(found / exact - 1)
    if cuts == "asked":
        assert off.max() < 1e-9
    else:
        # Few rows a part: some neighbours lie across a border of all cuts.
        assert np.mean(off < 1e-9) > 0.25 and np.median(off) < 0.01


def test_boxes_find_what_brute_force_finds():
    """Ties go to the smaller position; squares that vanish or overflow in single precision count too."""
    from plumbline.operators import neighbours

    random = np.random.default_rng(2)
    for points in (
        wide_and_narrow(900), random.integers(0, 9, size=(900, 3)).astype(float), random.normal(size=(300, 2)) * 1e20,
        random.normal(size=(300, 2)) * 1e-25, np.concatenate((random.normal(size=(200, 3)), [[1e14, 0, 0], [np.inf, 0, 0]])),
        random.normal(size=(12, 3)), random.normal(size=(400, 3)) + 1e9,
    ):
        points = np.unique(points, axis=0)
        best, far = neighbours._in_part(points, 20, neighbours._directions(points.shape[1], 8, 17), 1024)
        for i, row in enumerate(points):
            squared = np.zeros(len(points))
            for axis in range(points.shape[1]):
                squared += (row[axis] - points[:, axis]) ** 2
            squared[i] = np.inf
            near = np.lexsort((np.arange(len(points)), squared))[:20]
            near = near[np.isfinite(squared[near])]
            assert list(best[i][best[i] >= 0]) == list(near) and list(far[i][: len(near)]) == list(squared[near])


def test_medians_only_where_something_is_missing(spark, monkeypatch):
    asked = []
    medians = anomalies.medians
    monkeypatch.setattr(anomalies, "medians", lambda df, names, **kinds: asked.extend(names) or medians(df, names, **kinds))
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, None), (3, 5.0, 4.0)], "k long, a double, b double")
    filled, names, rows = anomalies.anomaly_input(df, "k")
    assert asked == ["b"] and names == ["a", "b"] and rows == 3
    assert sorted(tuple(r) for r in filled.collect()) == [(1, 1.0, 2.0), (2, 3.0, 3.0), (3, 5.0, 4.0)]


def planted(spark, n=500, bad=10):
    rows = [
        (i, 1000.0 + 40 * i, -900.0 - 30 * i) if i < bad
        else (i, float(np.sin(i * 12.9898) % 1), float(np.sin(i * 78.233) % 1))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, a double, b double")


def test_isolation_forest_flags_planted_rows(spark):
    df = planted(spark)
    scored = isolation_scores(df, ["a", "b"], "id", 500, CONFIG)
    flagged = anomalies.flag_lowest(scored, ["iso_score"], 500, 0.1).filter("iso_flag")
    ids = {r["id"] for r in flagged.collect()}
    assert set(range(10)) <= ids
    assert len(ids) == 50


def test_descent_of_all_rows_at_once_equals_a_walk_from_node_to_node():
    """Trees of unequal depth, one of a single leaf, and missing or infinite values; only plain arrays are sent."""
    import pickletools

    from pyspark import cloudpickle

    from plumbline.operators import isolation

    random = np.random.default_rng(6)
    points = random.normal(size=(300, 3)) * [1e6, 1, 1e-6]
    samples = [points[random.choice(300, n, replace=False)] for n in (1, 2, 30, 256)] + [np.ones((9, 3))]
    trees = [{k: np.array(v) for k, v in isolation._fit_tree(rows, [1, i]).items()} for i, rows in enumerate(samples)]
    points[0, 1], points[1, 0], points[2, 2] = np.nan, np.inf, -np.inf

    def walk(tree, row):
        at = 0
        while tree["axis"][at] >= 0:
            at = tree["left" if row[tree["axis"][at]] <= tree["value"][at] else "right"][at]
        return tree["depth"][at]

    ways = isolation._descents(isolation.Forest(trees, 1.0))
    assert list(isolation._depths(points, ways)) == [sum(walk(tree, row) for tree in trees) for row in points]
    named = [str(arg) for _, arg, _ in pickletools.genops(cloudpickle.dumps(ways)) if arg is not None]
    assert not any("plumbline" in arg for arg in named)


def test_isolation_forest_does_not_depend_on_partitions(spark):
    df = planted(spark)
    one = isolation_scores(df.coalesce(1), ["a", "b"], "id", 500, CONFIG).orderBy("id").collect()
    many = isolation_scores(df.repartition(7), ["a", "b"], "id", 500, CONFIG).orderBy("id").collect()
    assert [r["iso_score"] for r in one] == [r["iso_score"] for r in many]


def test_every_tree_gets_its_rows_from_a_large_table(spark):
    df = spark.range(20_000).select("id", F.col("id").cast("double").alias("a"))
    sizes = tree_samples(df, ["a"], "id", 20_000, CONFIG).groupBy("__tree").count().collect()
    assert len(sizes) == 100
    assert {r["count"] for r in sizes} == {256}


def test_consensus_and_single_flags(spark):
    scored = anomalies.anomaly_scores(planted(spark), "id", CONFIG)
    both = {r["id"] for r in anomalies.consensus(scored).collect()}
    assert both
    one = scored.filter("iso_flag != lof_flag").count()
    wide = QualityConfig(potential_anomaly_max_rows=one)
    narrow = QualityConfig(potential_anomaly_max_rows=one - 1)
    assert anomalies.single_flags(scored, wide).count() == one
    assert anomalies.single_flags(scored, narrow).count() == 0
    assert anomalies.single_flags(scored, CONFIG).count() == one


def test_gate():
    assert anomalies.gate(49, 5, CONFIG) == "small"
    assert anomalies.gate(5000, 1, CONFIG) == "small"
    assert anomalies.gate(2_800_000, 2, CONFIG) == "run"
    assert anomalies.gate(2_800_001, 2, CONFIG) == "run"
    assert anomalies.gate(2_800_001, 2, QualityConfig(max_data_points_for_ml=5_600_000)) == "large"
