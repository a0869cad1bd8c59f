"""Histogram scores, reasons of flags and audits of many classes against plain versions."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.config import QualityConfig
from plumbline.operators import classes, explain, histogram
from plumbline.operators.isolation import fit_forest, forest_scores


def test_histogram_scores(spark):
    draw = np.random.default_rng(3)
    rows = [(i, float(draw.normal()), float(draw.integers(0, 3)), 7.0, None) for i in range(400)]
    rows[0] = (0, 40.0, 1.0, 7.0, None)
    rows[1] = (1, None, float("nan"), 7.0, None)
    names = ["a", "b", "same", "none"]
    df = spark.createDataFrame(rows, "k long, a double, b double, same double, none double").repartition(3)
    got = {r.k: r.histogram_score for r in histogram.histogram_scores(df, names, 8).collect()}
    wanted = dict.fromkeys(got, 0.0)
    for at in (1, 2, 3):
        cells = {r[0]: r[at] for r in rows if r[at] is not None and r[at] == r[at]}
        edges = np.unique(np.quantile(list(cells.values()), np.arange(9) / 8))
        place = {k: int(np.searchsorted(edges[1:-1], v, "right")) for k, v in cells.items()}
        counts = collections.Counter(place.values())
        wide = np.diff(edges) if len(edges) > 1 else [1.0]
        dense = {b: n / wide[b] for b, n in counts.items()}
        for k, b in place.items():
            wanted[k] += math.log(max(dense.values()) / dense[b])
    assert got == pytest.approx(wanted)
    assert got[1] == 0.0
    assert histogram.histogram_scores(df.limit(0), names).count() == 0


def test_edges_of_large_tables_are_close(spark, monkeypatch):
    df = spark.range(20_000).select(((F.col("id") * 7919) % 20_000).cast("double").alias("a"))
    exact = histogram.bin_edges(df, ["a"])["a"]
    monkeypatch.setattr(histogram, "EXACT_ROWS", 100)
    about = histogram.bin_edges(df, ["a"])["a"]
    assert len(about) == len(exact) and np.abs(np.array(about) - exact).max() <= 40


def test_deviations(spark):
    rows = [(i, "x", float(i % 5), 1.0, None if i % 2 else 3.0 * (i % 4)) for i in range(100)]
    rows += [(100, "y", 100.0, 1.0, None), (100, "z", 2.0, 1.0, 90.0), (101, "z", 50.0, 1.0, float("nan"))]
    names = ["a", "same", "b"]
    df = spark.createDataFrame(rows, "k long, l string, a double, same double, b double").repartition(3)
    got = {(r.k, r.l): [(x.column, x.value) for x in r.reasons] for r in explain.deviations(df, ["k", "l"], names, 3.0).collect()}
    a = np.array([r[2] for r in rows])
    b = np.array([r[4] for r in rows if r[4] is not None and r[4] == r[4]])
    far = lambda x, of: abs(x - of.mean()) / of.std(ddof=1)
    assert set(got) == {(100, "y"), (100, "z"), (101, "z")}
    assert got[100, "y"] == [("a", pytest.approx(far(100.0, a)))]
    assert got[100, "z"] == [("b", pytest.approx(far(90.0, b))), ("a", pytest.approx(far(2.0, a)))]
    assert explain.deviations(df.limit(0), "k", names, 3.0).count() == 0


def plain_saved(tree, point):
    """Savings by column along one path, step by step."""

    def depth(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    at, out = 0, np.zeros(len(point))
    while tree["axis"][at] >= 0:
        axis = tree["axis"][at]
        after = tree["left"][at] if point[axis] <= tree["value"][at] else tree["right"][at]
        out[axis] += depth(tree["size"][at]) - 1 - depth(tree["size"][after])
        at = after
    return out


def test_depth_saved_is_that_of_a_plain_walk(spark):
    draw = np.random.default_rng(1)
    points = draw.normal(size=(600, 3))
    points[:5, 1] += 30
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "k long, a double, b double, c double")
    config = QualityConfig(anomaly_trees=20)
    names = ["a", "b", "c"]
    forest = fit_forest(df, names, "k", 600, config)
    got = explain.depth_saved(forest, points[:50])
    wanted = np.array([np.mean([plain_saved(t, p) for t in forest.trees], axis=0) for p in points[:50]])
    assert got == pytest.approx(wanted)
    # The savings of a row add up to what its score is made of.
    scores = np.array([r.iso_score for r in forest_scores(df, names, forest).orderBy("k").limit(50).collect()])
    assert got.sum(axis=1) == pytest.approx(forest.scale * (1 + np.log2(-scores)), abs=1e-9)
    reasons = explain.forest_reasons(df.filter("k < 5"), names, forest, top=2).collect()
    assert all(r.reasons[0].column == "b" and len(r.reasons) == 2 for r in reasons)


def test_many_classes(spark):
    draw = np.random.default_rng(2)
    rows = [
        (str(draw.choice(["x", "y", None])), str(draw.choice(["p", "p_q"])), str(draw.choice(list("abc"))),
         None if draw.random() < 0.02 else str(draw.choice(list("abcd"))))
        for _ in range(900)
    ]
    df = spark.createDataFrame(rows, "s string, t string, truth string, guess string").repartition(4)
    counts = classes.confusion_counts(df, "truth", "guess", ["s", "t"])
    metrics = classes.class_metrics(classes.group_confusion(counts, ["s", "t"], 2))
    seen = 0
    for r in metrics.collect():
        keys = {"s": [0], "t": [1], "s_&_t": [0, 1]}[r.attribute]
        some = [x for x in rows if [x[k] for k in keys] == r.members and x[3] is not None]
        c = r["class"]
        hits = sum(x[2] == c == x[3] for x in some)
        support, predicted = sum(x[2] == c for x in some), sum(x[3] == c for x in some)
        assert (r.n, r.hits, r.support, r.predicted) == (len(some), hits, support, predicted)
        assert r.fpr == pytest.approx((predicted - hits) / (len(some) - support) if len(some) > support else 0)
        assert r.accuracy == pytest.approx(sum((x[2] == c) == (x[3] == c) for x in some) / len(some))
        seen += 1
    assert seen == 4 * (3 + 2 + 6)
    macro = {(r.attribute, r.grp): r for r in classes.macro_metrics(metrics).collect()}
    x = [r for r in metrics.collect() if (r.attribute, r.grp) == ("s", "x")]
    assert macro["s", "x"].macro_tpr == pytest.approx(np.mean([r.tpr for r in x]))
    assert macro["s", "x"].accuracy == pytest.approx(sum(r.hits for r in x) / x[0].n)
    gaps = {(r.attribute, r["class"]): r for r in classes.class_gaps(metrics).collect()}
    rates = [r.selection_rate for r in metrics.collect() if r.attribute == "s" and r["class"] == "a"]
    assert gaps["s", "a"].parity_difference == pytest.approx(max(rates) - min(rates))
