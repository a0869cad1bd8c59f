"""Repair actions, plans and chains."""

import pytest

import plumbline as pl
from plumbline.config import QualityConfig
from plumbline.operators import repair
from plumbline.operators.repair import Fix, apply_fixes, issue_categories
from plumbline.plans.remediate import propose_plan, remediate, revalidate

ROWS = [
    (0, 1, 25.0, "72", "a"), (1, 2, 150.0, "80", None), (2, 3, None, "high", "b"),
    (3, 4, -5.0, None, "b"), (4, 5, 60.0, "70", "a"), (5, 5, 60.0, "70", "a"),
]
SCHEMA = "k long, patient_id long, age double, heart_rate string, ward string"


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def column(result, name):
    return [r[name] for r in result.data.orderBy("k").collect()]


def fix_one(df, *fix, **options):
    return apply_fixes(df, [Fix(*fix)], "k", **options)


def test_fills(df):
    assert column(fix_one(df, "HIGH_NULL_RATE", "age", "fill_median"), "age")[2] == 60.0
    assert column(fix_one(df, "HIGH_NULL_RATE", "age", "fill_mean"), "age")[2] == 58.0
    assert column(fix_one(df, "MODERATE_NULL_RATE", "ward", "fill_mode"), "ward")[1] == "a"


def test_mode_prefers_the_smallest_value_and_needs_one(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None)], "k long, w string")
    assert column(fix_one(df, "HIGH_NULL_RATE", "w", "fill_mode"), "w")[2] == "a"
    empty = spark.createDataFrame([(0, None)], "k long, w string")
    assert column(fix_one(empty, "HIGH_NULL_RATE", "w", "fill_mode"), "w") == [None]


def test_drops(df, spark):
    assert column(fix_one(df, "HIGH_NULL_RATE", "age", "drop_rows"), "k") == [0, 1, 3, 4, 5]
    assert column(fix_one(df, "VALUE_BELOW_RANGE", "age", "drop_rows"), "k") == [0, 1, 2, 4, 5]
    assert column(fix_one(df, "VALUE_ABOVE_RANGE", "age", "drop_rows"), "k") == [0, 2, 3, 4, 5]
    assert "ward" not in fix_one(df, "EMPTY_COLUMN", "ward", "drop_column").data.columns
    nan = spark.createDataFrame([(0, float("nan")), (1, 1.0)], "k long, v double")
    assert column(fix_one(nan, "HIGH_NULL_RATE", "v", "drop_rows"), "k") == [1]


def test_conversions(df):
    median = fix_one(df, "TYPE_INCONSISTENCY", "heart_rate", "convert_numeric_fill_median")
    assert column(median, "heart_rate") == [72.0, 80.0, 71.0, 71.0, 70.0, 70.0]
    null = fix_one(df, "TYPE_INCONSISTENCY", "heart_rate", "convert_numeric_nan")
    assert column(null, "heart_rate") == [72.0, 80.0, None, None, 70.0, 70.0]
    # Dropping leaves the column as text and also drops rows without a value.
    drop = fix_one(df, "TYPE_INCONSISTENCY", "heart_rate", "convert_numeric_drop")
    assert column(drop, "heart_rate") == ["72", "80", "70", "70"]


def test_caps(spark):
    values = [0.0] * 50 + [1000.0]
    df = spark.createDataFrame(list(enumerate(values)), "k long, age double")
    mean, std = 1000 / 51, 1000 / 51**0.5
    capped = column(fix_one(df, "VALUE_ABOVE_RANGE", "age", "cap_values"), "age")
    assert max(capped) == pytest.approx(mean + 3 * std)
    tight = fix_one(df, "STATISTICAL_OUTLIER", "age", "cap_outliers", {"threshold": 1.0})
    assert max(column(tight, "age")) == pytest.approx(mean + std)
    assert max(column(fix_one(df, "VALUE_ABOVE_RANGE", "age", "cap_range"), "age")) == 120.0


def test_a_single_value_has_no_spread_to_cap(spark):
    df = spark.createDataFrame([(0, 5.0)], "k long, age double")
    assert column(fix_one(df, "STATISTICAL_OUTLIER", "age", "cap_outliers"), "age") == [5.0]


def test_replacements_touch_every_offending_row(spark):
    rows = [(i, 500.0 if i < 40 else 10.0 + i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, age double")
    fixed = column(fix_one(df, "VALUE_ABOVE_RANGE", "age", "replace_median"), "age")
    assert max(fixed) < 120 and fixed.count(11.0) >= 40
    few = [(i, 1e6 if i < 3 else float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(few, "k long, v double")
    fixed = column(fix_one(df, "STATISTICAL_OUTLIER", "v", "replace_outliers_median"), "v")
    assert fixed[:3] == [2.0, 2.0, 2.0]


def test_duplicates(spark, df):
    first = fix_one(df, "DUPLICATE_ROWS", None, "drop_duplicates", {"keep": "first"})
    last = fix_one(df, "DUPLICATE_ROWS", None, "drop_duplicates", {"keep": "last"})
    assert column(first, "k") == [0, 1, 2, 3, 4]
    assert column(last, "k") == [0, 1, 2, 3, 5]
    assert first.data.columns == df.columns
    ids = fix_one(df, "DUPLICATE_IDS", "patient_id", "drop_duplicate_ids",
                  {"id_column": "patient_id", "confirm": True})
    assert column(ids, "k") == [0, 1, 2, 3, 4]


def test_duplicates_after_a_flagging_fix(spark):
    # Rows 0 and 1 become equal once the outlier-free value replaces the bad one.
    df = spark.createDataFrame([(0, 500.0), (1, 7.0), (2, 7.0)], "k long, age double")
    plan = [
        Fix("VALUE_ABOVE_RANGE", "age", "replace_median"),
        Fix("DUPLICATE_ROWS", None, "drop_duplicates", {"keep": "first"}),
        Fix("VALUE_ABOVE_RANGE", "age", "drop_rows"),
    ]
    # The last fix drops row 0, which was flagged at the start.
    assert apply_fixes(df, plan, "k").data.collect() == []
    assert column(apply_fixes(df, plan[:2], "k"), "k") == [0]


def test_unnamed_columns(spark):
    df = spark.createDataFrame([(0, 1, 2)], "k long, `Unnamed: 1` int, _c2 int")
    assert fix_one(df, "UNNAMED_COLUMNS", None, "drop_unnamed_columns").data.columns == ["k"]


def test_losses_must_be_confirmed_and_actions_must_fit(df):
    for bad in (
        Fix("DUPLICATE_IDS", "patient_id", "drop_duplicate_ids"),
        Fix("MULTIVARIATE_ANOMALY", None, "drop_rows"),
        Fix("EMPTY_COLUMN", "age", "fill_mean"),
        Fix("LOW_NULL_RATE", "age", "fill_mean"),
        Fix("INSUFFICIENT_ROWS", None, "drop_rows"),
    ):
        with pytest.raises(ValueError):
            apply_fixes(df, [bad], "k")


def test_impossible_fixes_are_logged_and_skipped(df):
    plan = [
        Fix("EMPTY_COLUMN", "ward", "drop_column"),
        Fix("HIGH_NULL_RATE", "ward", "fill_mode"),
        Fix("HIGH_NULL_RATE", "heart_rate", "fill_median"),
        Fix("HIGH_NULL_RATE", "age", "fill_median"),
        Fix("MULTIVARIATE_ANOMALY", None, "export_anomalies"),
    ]
    result = apply_fixes(df, plan, "k")
    log = [(r["step"], r["status"]) for r in result.log.orderBy("step").collect()]
    assert log == [(0, "applied"), (1, "skipped"), (2, "skipped"), (3, "applied"), (4, "skipped")]
    assert column(result, "age")[2] == 60.0


def test_statistics_follow_the_fixes_before_them(df):
    plan = [
        Fix("VALUE_ABOVE_RANGE", "age", "drop_rows"),
        Fix("VALUE_BELOW_RANGE", "age", "drop_rows"),
        Fix("HIGH_NULL_RATE", "age", "fill_mean"),
    ]
    filled = column(apply_fixes(df, plan, "k"), "age")
    assert filled == pytest.approx([25.0, 145 / 3, 60.0, 60.0])


def test_fixes_on_different_columns_share_a_batch():
    plan = [
        Fix("HIGH_NULL_RATE", "a", "fill_median"), Fix("HIGH_NULL_RATE", "b", "fill_mean"),
        Fix("HIGH_NULL_RATE", "a", "fill_mean"), Fix("HIGH_NULL_RATE", "a", "drop_rows"),
    ]
    assert [[i for i, _ in group] for group in repair._batches(plan)] == [[0, 1], [2], [3]]


def test_anomaly_actions(spark, df, tmp_path):
    flagged = spark.createDataFrame([(1,), (3,)], "k long")
    written = []
    plan = [
        Fix("MULTIVARIATE_ANOMALY", None, "export_anomalies"),
        Fix("MULTIVARIATE_ANOMALY", None, "drop_rows", {"confirm": True}),
    ]
    result = apply_fixes(df, plan, "k", anomalies=flagged, export=written.append)
    assert sorted(r["k"] for r in written[0].collect()) == [1, 3]
    assert column(result, "k") == [0, 2, 4, 5]


def test_plan_from_report(spark, df):
    report = pl.validate(df, "k")
    choices = {
        ("VALUE_ABOVE_RANGE", "age"): "drop_rows",
        "VALUE_BELOW_RANGE": "replace_median",
        "TYPE_INCONSISTENCY": "convert_numeric_fill_median",
        "MODERATE_NULL_RATE": "fill_mode",
        "DUPLICATE_IDS": ("drop_duplicate_ids", {"confirm": True}),
    }
    with pytest.raises(ValueError):
        propose_plan(report.issues, {"DUPLICATE_IDS": "drop_duplicate_ids"})
    plan = propose_plan(report.issues, choices, df.columns)
    # Categories come in a fixed order: missing values, types, ranges, duplicates.
    assert [f.issue_type for f in plan][0] == "MODERATE_NULL_RATE"
    assert plan[-1].parameters["id_column"] == "patient_id"
    result = remediate(df, report, choices, "k")
    left = {r["issue_type"] for r in pl.validate(result.data, "k").issues.collect()}
    assert not left & {"VALUE_ABOVE_RANGE", "VALUE_BELOW_RANGE", "DUPLICATE_IDS"}
    again = revalidate(df, plan, "k")
    assert {r["issue_type"] for r in again.issues.collect()} == left


def test_categories(spark, df):
    got = {r["category"]: r["n_issues"] for r in issue_categories(pl.validate(df, "k").issues).collect()}
    assert got == {
        "Missing Values": 3, "Type Inconsistencies": 2, "Domain Violations": 2,
        "Duplicate Data": 2, "Other": 1,
    }


def test_dedup_with_columns_that_cannot_be_ordered(spark):
    rows = [(1, "a", {"x": 1}, [1]), (2, "a", {"x": 1}, [2]), (3, "b", {"x": 2}, [3]), (4, "b", {"y": 2}, [3])]
    df = spark.createDataFrame(rows, "k long, name string, tags map<string,int>, list array<int>")
    for keep, expected in (("first", {1, 2, 3}), ("last", {1, 2, 4})):
        fix = Fix("DUPLICATE_ROWS", None, "drop_duplicates", {"keep": keep})
        repaired = apply_fixes(df, [fix], "k")
        got = {r["k"]: r["tags"] for r in repaired.data.collect()}
        assert set(got) == expected and got[1] == {"x": 1}
        assert repaired.log.first()["status"] == "applied"


def test_dedup_plan_does_not_sort_to_aggregate(spark):
    df = spark.range(100).selectExpr("id as k", "id % 7 as a", "cast(id % 3 as string) as b", "map('x', id) as m")
    fix = Fix("DUPLICATE_ROWS", None, "drop_duplicates", {"keep": "first"})
    plan = apply_fixes(df, [fix], "k").data._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_failing_fixes_are_skipped_whatever_fails(spark, monkeypatch):
    from plumbline.operators import repair

    df = spark.createDataFrame([(1, "a", None), (2, "b", 4.0), (3, None, 6.0)], "k long, s string, v double")
    plain = repair.moments
    monkeypatch.setattr(repair, "moments", lambda *a: (_ for _ in ()).throw(RuntimeError("no statistics")) if a[1] else plain(*a))
    monkeypatch.setattr(
        repair, "keep_first_per_id", lambda frame, *_: frame.select("no_such_column")
    )
    plan = [
        Fix("MODERATE_NULL_RATE", "v", "fill_mean"),
        Fix("DUPLICATE_IDS", "k", "drop_duplicate_ids", {"confirm": True}),
        Fix("MODERATE_NULL_RATE", "s", "fill_mode"),
    ]
    repaired = apply_fixes(df, plan, "k")
    assert [r["status"] for r in repaired.log.orderBy("step").collect()] == ["skipped", "skipped", "applied"]
    assert {r["s"] for r in repaired.data.collect()} == {"a", "b"}


def test_few_values_have_no_outliers_to_repair(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(8)] + [(9, 900.0)], "k long, v double")
    fix = Fix("STATISTICAL_OUTLIER", "v", "drop_rows")
    loose = QualityConfig(outlier_zscore_threshold=2.0)
    assert apply_fixes(df, [fix], "k", loose).data.count() == 9
    strict = QualityConfig(outlier_zscore_threshold=2.0, outlier_min_values=5)
    assert apply_fixes(df, [fix], "k", strict).data.count() == 8
