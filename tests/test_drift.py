"""Counts of a stream by window, restarts and late rows, and changes between windows."""

import datetime
import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import drift
from plumbline.streaming import windows

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 3, 9)
SCHEMA = "ts timestamp_ntz, y_true int, y_pred int, sex string, score double"
PLAN = windows.WindowPlan("ts", "y_true", "y_pred", ("sex",), ("score",), lateness="2 days")
COUNTED = ["n", "predicted", "hits", "false_alarms", "positives", "missing_score"]


def batch_of(first_day, days, seed, rows=200):
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(rows):
        at = START + DAY * first_day + datetime.timedelta(seconds=int(draw.integers(0, days * 86400)))
        score = [None, float("nan"), 1.5][int(draw.integers(0, 3))]
        sex = [None, "f", "m"][int(draw.integers(0, 3))]
        out.append((at, int(draw.integers(0, 2)), int(draw.integers(0, 2)), sex, score))
    return out


def plain(batches, lateness=2 * DAY):
    """Counts by (day, group); rows are late whose window ended before the watermark of two files ago."""
    counts, latest = {}, [datetime.datetime.min + 10 * DAY] * 2
    for rows in batches:
        mark = latest[-2] - lateness
        for at, t, p, sex, score in rows:
            day = datetime.datetime(at.year, at.month, at.day)
            if day + DAY <= mark:
                continue
            cell = counts.setdefault((day, "sex", sex or "nan"), [0] * 6)
            missing = score is None or math.isnan(score)
            for i, one in enumerate((1, p, p and t, p and not t, t, missing)):
                cell[i] += int(bool(one))
        latest.append(max([latest[-1], *(r[0] for r in rows)]))
    return {k: tuple(v) for k, v in counts.items()}


def put(spark, folder, number, rows):
    """One file of a stream's folder, younger than the one before."""
    path = f"{folder}/part-{number}.parquet"
    spark.createDataFrame(rows, SCHEMA).toPandas().to_parquet(path, coerce_timestamps="us")
    os.utime(path, (time.time() - 1000 + number, time.time() - 1000 + number))


def result(spark, folder):
    rows = windows.windows_so_far(spark, PLAN, folder).collect()
    return {(r.window_start, r.attribute, r.grp): tuple(r[c] for c in COUNTED) for r in rows}


def test_restart_changes_nothing_and_late_rows_go(spark, tmp_path):
    # Rows of the first day come again when its window has long ended.
    batches = [batch_of(0, 3, 1), batch_of(4, 3, 2), batch_of(6, 2, 3), batch_of(0, 1, 4, 50) + batch_of(7, 2, 5)]
    like = spark.createDataFrame([], SCHEMA)
    source, once, twice = (str(tmp_path / name) for name in ("source", "once", "twice"))
    os.makedirs(source)
    for number, rows in enumerate(batches[:2]):
        put(spark, source, number, rows)
    windows.run_windows(windows.stream_of(spark, source, like, 1), PLAN, twice)
    assert result(spark, twice) == plain(batches[:2])
    for number, rows in enumerate(batches[2:], 2):
        put(spark, source, number, rows)
    windows.run_windows(windows.stream_of(spark, source, like, 1), PLAN, twice)
    windows.run_windows(windows.stream_of(spark, source, like, 1), PLAN, once)
    wanted = plain(batches)
    assert sum(v[0] for v in wanted.values()) < sum(map(len, batches))  # some rows are late
    assert result(spark, once) == wanted
    assert result(spark, twice) == wanted
    # Nothing new: the same result again.
    windows.run_windows(windows.stream_of(spark, source, like, 1), PLAN, once)
    assert result(spark, once) == wanted


def test_a_batch_run_again_replaces_its_rows(spark, tmp_path):
    """The versions of a micro-batch are overwritten, not added to."""
    rows = windows.window_counts(spark.createDataFrame(batch_of(0, 2, 7), SCHEMA), PLAN)
    for _ in range(2):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/versions/batch=0")
    assert result(spark, str(tmp_path)) == plain([batch_of(0, 2, 7)])


def test_windows_do_not_depend_on_the_time_zone(spark):
    rows = spark.createDataFrame(batch_of(0, 3, 9), SCHEMA)
    zone = spark.conf.get("spark.sql.session.timeZone")
    found = []
    for name in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", name)
        try:
            found.append(sorted(map(tuple, windows.window_counts(rows, PLAN).collect())))
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
    assert found[0] == found[1] == found[2]


def counts_of(spark, rows):
    cells = [(START + DAY * day, "a", grp, n, x) for day, grp, n, x in rows]
    return spark.createDataFrame(
        cells, "window_start timestamp_ntz, attribute string, grp string, n long, predicted long"
    )


def plain_changes(series, slack, alarm):
    """{(group, direction): (alarm day, first day, peak)} by the restarting sum itself."""
    out = {}
    for grp, rows in series.items():
        rows = [r for r in sorted(rows) if r[1]]
        level = sum(x for _, _, x in rows) / sum(n for _, n, _ in rows)
        if not 0 < level < 1:
            continue
        for direction, sign in (("up", 1), ("down", -1)):
            total, began, peak, hit = 0.0, None, 0.0, None
            for day, n, x in rows:
                total += sign * (x / n - level) / math.sqrt(level * (1 - level) / n) - slack
                if total <= 0:
                    total, began = 0.0, None
                    continue
                began = day if began is None else began
                peak = max(peak, total)
                if total > alarm and hit is None:
                    hit = (day, began)
            if hit:
                out[grp, direction] = (*hit, peak)
    return out


@pytest.mark.parametrize("alarm", [2.0, 4.0])
def test_change_points(spark, alarm):
    draw = np.random.default_rng(6)
    series = {}
    for grp in range(12):
        jump = int(draw.integers(5, 25))
        rows = []
        for day in range(30):
            if draw.random() < 0.1:
                continue
            n = int(draw.integers(0, 60))
            rate = 0.3 + (0.3 if day >= jump and grp % 3 else 0.0) - (0.2 if day >= jump and grp % 3 == 2 else 0.0)
            rows.append((day, n, int(draw.binomial(n, rate))))
        series[f"g{grp}"] = rows
    series["never"] = [(d, 10, 0) for d in range(10)]
    counts = counts_of(spark, [(d, g, n, x) for g, rows in series.items() for d, n, x in rows])
    got = {
        (r.grp, r.direction): ((r.alarm_at - START).days, (r.began_at - START).days, r.peak)
        for r in drift.change_points(counts.repartition(3), alarm=alarm).collect()
    }
    wanted = plain_changes(series, drift.SLACK, alarm)
    assert set(got) == set(wanted) and wanted
    for key, (at, began, peak) in wanted.items():
        assert got[key][:2] == (at, began) and got[key][2] == pytest.approx(peak)


def test_stability_and_rates(spark):
    counts = counts_of(spark, [
        (0, "x", 50, 10), (0, "y", 50, 10), (1, "x", 50, 30), (1, "y", 50, 10), (2, "x", 100, 0), (4, "x", 5, 5),
    ])
    shifts = {(r.window_start - START).days: r for r in drift.stability(counts, "1 DAY").collect()}
    assert set(shifts) == {1, 2}  # day 3 is empty, day 4 has nothing before it
    assert shifts[1].population_stability == pytest.approx(0.0)
    p, q = 100.5 / 101, 0.5 / 101
    assert shifts[2].population_stability == pytest.approx((p - 0.5) * math.log(p / 0.5) + (q - 0.5) * math.log(q / 0.5))
    rates = {((r.window_start - START).days, r.grp): r for r in drift.rate_shifts(counts, "1 DAY").collect()}
    assert set(rates) == {(1, "x"), (1, "y"), (2, "x")}
    assert rates[1, "x"].z == pytest.approx(0.4 / math.sqrt(0.4 * 0.6 * 2 / 50))
    assert rates[1, "y"].z == pytest.approx(0.0)
    none = drift.change_points(counts.filter(F.lit(False)))
    assert none.count() == 0 and drift.stability(counts.limit(0), "1 DAY").count() == 0
