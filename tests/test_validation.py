"""Quality checks, profiles and reports."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import plumbline as pl
from plumbline.config import QualityConfig
from plumbline.operators import checks, duplicates, evidence, facts, profile
from plumbline.plans.validate import validate

VITALS = (
    "row_key long, patient_id long, age long, heart_rate string, blood_pressure_systolic double, "
    "oxygen_saturation long"
)
SIX = [
    (0, 1, 25, "72", 120.0, 98), (1, 2, 150, "80", 130.0, 97), (2, 3, 45, "high", 500.0, 150),
    (3, 4, -5, "95", 110.0, 95), (4, 5, 60, "70", None, 99), (5, 5, 60, "70", None, 99),
]


def found(report):
    return {
        (r["issue_type"], r["column"]): r["affected_rows"] for r in report.issues.collect()
    }


def severities(report):
    return sorted(r["severity"] for r in report.issues.collect())


def test_clean_but_short_table(spark):
    rows = [(0, 1, 25, 72), (1, 2, 45, 80), (2, 3, 60, 85), (3, 4, 35, 95), (4, 5, 50, 70)]
    df = spark.createDataFrame(rows, "row_key long, patient_id long, age long, heart_rate long")
    report = validate(df, "row_key")
    assert report.status == "WARNING"
    assert found(report) == {("INSUFFICIENT_ROWS", None): 5}
    assert (report.summary["total_rows"], report.summary["total_columns"]) == (5, 3)
    assert [r["recommendation"] for r in report.recommendations.collect()] == [
        "✅ No major issues. Data appears suitable for ML pipeline."
    ]


def test_table_with_many_defects(spark):
    report = validate(spark.createDataFrame(SIX, VITALS), "row_key")
    assert report.status == "FAIL"
    assert found(report) == {
        ("INSUFFICIENT_ROWS", None): 6, ("DUPLICATE_ROWS", None): 1,
        ("DUPLICATE_IDS", "patient_id"): 1, ("MODERATE_NULL_RATE", "blood_pressure_systolic"): 2,
        ("TYPE_INCONSISTENCY", "heart_rate"): 1, ("VALUE_BELOW_RANGE", "age"): 1,
        ("VALUE_ABOVE_RANGE", "age"): 1, ("VALUE_ABOVE_RANGE", "blood_pressure_systolic"): 1,
        ("VALUE_ABOVE_RANGE", "oxygen_saturation"): 1,
    }
    assert severities(report) == ["critical"] * 5 + ["warning"] * 4
    assert report.summary["overall_completeness"] == "93.3%"
    assert report.summary["duplicate_rows"] == 1
    assert [r["rule"] for r in report.recommendations.collect()] == [1, 2, 4, 5]
    evidence_of = {r["issue_type"]: r["examples"] for r in report.issues.collect()}
    assert [(e["row_key"], e["value"]) for e in evidence_of["DUPLICATE_IDS"]] == [("5", "5")]
    assert [(e["row_key"], e["value"]) for e in evidence_of["TYPE_INCONSISTENCY"]] == [("2", "high")]
    profiles = {r["column"]: r for r in report.profiles.collect()}
    heart = profiles["heart_rate"]
    assert heart["sample_values"] == ["72", "80", "high", "95", "70"]
    assert [tuple(t) for t in heart["top_categories"]][:2] == [("70", 2), ("72", 1)]
    assert profiles["age"]["mean"] == pytest.approx(335 / 6)
    assert profiles["age"]["top_categories"] is None
    assert profiles["blood_pressure_systolic"]["unique_count"] == 4


def test_tables_without_rows_or_columns(spark):
    empty = spark.createDataFrame([], "row_key long, note string, age long")
    report = validate(empty, "row_key")
    assert report.status == "FAIL"
    assert found(report) == {("EMPTY_DATASET", None): 0}
    only_key = spark.range(3).withColumnRenamed("id", "row_key")
    assert found(validate(only_key, "row_key")) == {("NO_COLUMNS", None): 3}
    assert found(validate(only_key.limit(0), "row_key")) == {("EMPTY_DATASET", None): 0}


def test_repeated_column_names_stop_the_checks(spark):
    df = spark.range(3).select(F.col("id").alias("row_key"), F.lit(1).alias("a"), F.lit(2).alias("a"))
    report = validate(df, "row_key")
    assert report.status == "FAIL"
    assert found(report) == {("DUPLICATE_COLUMNS", None): 3}
    assert report.issues.first()["examples"][0]["value"] == "a"


def test_unnamed_columns():
    names = ["a", "Unnamed: 2", "_c3", "x_c4", "_c"]
    assert checks.unnamed_columns(names) == ["Unnamed: 2", "_c3"]
    assert checks.repeated_names(["a", "b", "a", "a"]) == ["a", "a"]


@pytest.mark.parametrize(
    ("missing", "kind"),
    [(0, None), (1, "LOW_NULL_RATE"), (9, "LOW_NULL_RATE"), (10, "MODERATE_NULL_RATE"),
     (49, "MODERATE_NULL_RATE"), (50, "HIGH_NULL_RATE"), (99, "HIGH_NULL_RATE"),
     (100, "EMPTY_COLUMN")],
)
def test_missing_grades_include_their_limit(spark, missing, kind):
    known = spark.createDataFrame([("c", 100, missing)], "column string, n_rows long, null_count long")
    rows = checks.completeness_issues(known, QualityConfig()).collect()
    assert [r["issue_type"] for r in rows] == ([kind] if kind else [])


def test_nan_is_missing_and_never_out_of_range(spark):
    df = spark.createDataFrame([(i, float("nan") if i < 3 else 50.0) for i in range(20)],
                               "row_key long, age double")
    report = validate(df, "row_key")
    assert ("VALUE_ABOVE_RANGE", "age") not in found(report)
    assert found(report)[("MODERATE_NULL_RATE", "age")] == 3
    assert report.profiles.first()["max_val"] == 50.0


def test_outliers_need_ten_values_and_spread(spark):
    config = QualityConfig()
    few = spark.createDataFrame([(i, 0.0 if i else 1e6) for i in range(9)], "row_key long, v double")
    flat = spark.createDataFrame([(i, 1.0) for i in range(30)], "row_key long, v double")
    many = spark.createDataFrame([(i, 0.0 if i else 1e6) for i in range(30)], "row_key long, v double")
    results = []
    for df in (few, flat, many):
        measured = facts.column_facts(df, ["v"], config).collect()
        results.append([r["outliers"] for r in facts.outlier_counts(df, measured, config).collect()])
    assert results == [[], [], [1]]


def test_infinite_values_are_no_outliers_but_out_of_range(spark):
    rows = [(i, float("inf") if i == 0 else 50.0 + i % 5) for i in range(30)]
    df = spark.createDataFrame(rows, "row_key long, age double")
    assert found(validate(df, "row_key")) == {
        ("VALUE_ABOVE_RANGE", "age"): 1,
        ("DUPLICATE_ROWS", None): 24,
    }


def test_names_with_quotes(spark):
    df = spark.createDataFrame([(i, None, "x") for i in range(12)], "row_key long, `it's \\ \"a\"` int, `b.``c` string")
    report = validate(df, "row_key")
    assert ("EMPTY_COLUMN", "it's \\ \"a\"") in found(report)
    assert [r["unique_count"] for r in report.profiles.orderBy("column").collect()] == [1, 0]


def test_booleans_count_as_numbers(spark):
    df = spark.createDataFrame([(i, i == 0) for i in range(200)], "row_key long, flag boolean")
    report = validate(df, "row_key")
    assert found(report)[("STATISTICAL_OUTLIER", "flag")] == 1
    assert report.summary["numeric_columns"] == 0
    assert report.profiles.first()["mean"] == pytest.approx(1 / 200)


def test_few_distinct_texts_are_categories(spark):
    df = spark.createDataFrame(
        [(i, "yes" if i % 2 else "no", str(i) if i else "none") for i in range(100)],
        "row_key long, category string, code string",
    )
    assert found(validate(df, "row_key"))[("TYPE_INCONSISTENCY", "code")] == 1
    assert ("TYPE_INCONSISTENCY", "category") not in found(validate(df, "row_key"))


def test_first_repeats_come_in_row_order(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v")).repartition(7)
    shown = duplicates.first_repeats(df, ["v"], "k", 5, F.col("v")).collect()
    assert [(r["rank"], r["row_key"], r["value"]) for r in shown] == [
        (1, "3", "0"), (2, "4", "1"), (3, "5", "2"), (4, "6", "0"), (5, "7", "1")
    ]


def test_missing_equals_missing_in_repeats(spark):
    rows = [(1, None), (1, None), (None, 1), (None, None), (None, None), (2, 3)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert duplicates.repeat_count(df, ["a", "b"]).first()[0] == 2


def test_columns_that_cannot_be_compared_are_left_out_of_repeats(spark):
    df = spark.sql("SELECT id AS row_key, 1 AS a, map('k', id) AS m FROM range(12)")
    assert found(validate(df, "row_key"))[("DUPLICATE_ROWS", None)] == 11


def test_rank_limit_reaches_the_map_side(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    bad = [checks.RowCheck("TYPE_INCONSISTENCY", "v", F.col("v").isNotNull())]
    plan = evidence.issue_examples(df, "k", bad, QualityConfig())._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_samples_of_sparse_columns(spark, monkeypatch):
    monkeypatch.setattr(profile, "HEAD_ROWS", 10)
    df = spark.range(200).select(
        F.col("id").alias("k"),
        F.col("id").alias("full"),
        F.when(F.col("id") >= 150, F.col("id")).alias("late"),
    )
    rows = profile.sample_values(df, "k", {"full": 200, "late": 50}, QualityConfig()).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["column"], []).append(r["value"])
    assert got == {"full": list("01234"), "late": ["150", "151", "152", "153", "154"]}


def test_wide_tables(spark):
    width = 120
    df = spark.range(50).select(
        F.col("id").alias("k"), *[(F.col("id") + i).alias(f"c{i}") for i in range(width)]
    )
    report = validate(df, "k", QualityConfig(run_anomaly_checks=False))
    assert report.profiles.count() == width
    assert report.summary["total_missing_values"] == 0


def test_size_limit_of_the_anomaly_checks(spark):
    df = spark.range(60).select(F.col("id").alias("k"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    report = validate(df, "k", QualityConfig(max_data_points_for_ml=119))
    skipped = report.issues.filter("issue_type = 'ML_ANOMALY_DETECTION_SKIPPED'").first()
    assert skipped["severity"] == "info"
    assert "120 data points (limit: 119)" in skipped["description"]
    assert report.ml_methods_used == ["Isolation Forest"]
    found = report.issues.filter("issue_type = 'POTENTIAL_ANOMALY'").first()
    assert found["affected_rows"] == 6
    assert {tuple(e["flagged_by"]) for e in found["examples"]} == {("Isolation Forest",)}
    off = QualityConfig(max_data_points_for_ml=119, run_anomaly_checks=False)
    kinds = {r["issue_type"] for r in validate(df, "k", off).issues.collect()}
    assert "ML_ANOMALY_DETECTION_SKIPPED" not in kinds


def test_anomaly_checks_in_the_report(spark):
    rows = [(i, float((i * 37) % 101), float((i * 53) % 97)) for i in range(200)]
    rows += [(200 + i, 5000.0 + 300 * i, -4000.0 - 500 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    report = validate(df, "k")
    assert report.ml_methods_used == ["Isolation Forest", "Local Outlier Factor (LOF)"]
    strange = report.issues.filter("issue_type = 'MULTIVARIATE_ANOMALY'").first()
    planted = {str(200 + i) for i in range(5)}
    assert planted & {e["row_key"] for e in strange["examples"]}
    assert set(strange["examples"][0]["values"]) == {"a", "b"}
    assert report.anomalies.count() == strange["affected_rows"]


def test_result_does_not_depend_on_order_or_partitions(spark):
    df = spark.createDataFrame(SIX * 5, VITALS).withColumn("row_key", F.monotonically_increasing_id())
    fixed = spark.createDataFrame(df.collect(), df.schema)
    one = validate(fixed.coalesce(1), "row_key").issues.collect()
    other = validate(fixed.orderBy(F.rand(3)).repartition(5), "row_key").issues.collect()
    assert one == other


def test_several_key_columns(spark):
    df = spark.createDataFrame([(1, "a", 500), (1, "b", 20)], "k long, part string, age long")
    shown = validate(df, ["k", "part"]).issues.filter("issue_type = 'VALUE_ABOVE_RANGE'").first()
    assert shown["examples"][0]["row_key"] == "1|a"


# --- files -------------------------------------------------------------------


def test_csv_markers_and_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        'id,amount,flag,note,empty,code\n'
        '1,1.5,True,"a, ""b""",?,007x\n'
        '2,?,False,null,,9\n'
        '3,NA,True,"two\nlines", ,-nan\n'
    )
    df = pl.read_csv(spark, str(path))
    kinds = {f.name: f.dataType for f in df.schema}
    assert isinstance(kinds["id"], T.LongType) and isinstance(kinds["amount"], T.DoubleType)
    assert isinstance(kinds["flag"], T.BooleanType) and isinstance(kinds["empty"], T.DoubleType)
    rows = df.orderBy("id").collect()
    assert [r["amount"] for r in rows] == [1.5, None, None]
    assert [r["note"] for r in rows] == ['a, "b"', None, "two\nlines"]
    assert [r["code"] for r in rows] == ["007x", "9", None]


def test_validate_file(spark, tmp_path):
    rows = spark.createDataFrame(SIX, VITALS).drop("row_key")
    rows.coalesce(1).write.option("header", True).csv(str(tmp_path / "v.csv"))
    rows.coalesce(1).write.parquet(str(tmp_path / "v.parquet"))
    from_csv = pl.validate_file(spark, str(tmp_path / "v.csv"))
    from_parquet = pl.validate_file(spark, str(tmp_path / "v.parquet"))
    assert found(from_csv) == found(from_parquet)
    assert from_csv.summary["total_columns"] == 5
    with pytest.raises(ValueError, match="Unsupported"):
        pl.validate_file(spark, "table.xlsx")


def test_report_as_json(spark, tmp_path):
    report = validate(spark.createDataFrame(SIX, VITALS), "row_key")
    report.write_json(str(tmp_path / "r"))
    summary = spark.read.json(str(tmp_path / "r" / "summary")).first()
    assert (summary["status"], summary["total_rows"]) == ("FAIL", 6)
    issues = spark.read.json(str(tmp_path / "r" / "issues"))
    assert issues.count() == report.issues.count()
    assert json.loads(issues.toJSON().first())["issue_type"]


def test_cleaned_file_names(spark, tmp_path):
    from plumbline.sources.writers import cleaned_path

    assert cleaned_path("/d/t.csv") == "/d/t_cleaned.csv"
    assert cleaned_path("/d/t.parquet") == "/d/t_cleaned.csv"
    df = spark.createDataFrame([(1, 'x, "y"')], "a long, b string")
    pl.write_table(df, str(tmp_path / "o.csv"))
    assert pl.read_csv(spark, str(tmp_path / "o.csv")).collect() == df.collect()
    with pytest.raises(ValueError):
        pl.write_table(df, str(tmp_path / "o.x"), format="xlsx")


@pytest.mark.parametrize("late", [False, True])
def test_first_repeats_read_no_more_of_the_table_than_they_need(spark, monkeypatch, late):
    """Whole blocks are copies: the first repeats come from a beginning, in the order of the whole."""
    monkeypatch.setattr(duplicates, "HEAD_ROWS", 500, raising=False)
    keyed = spark.range(8000).select(
        F.when(F.col("id") % 400 > 0, F.col("id")).alias("k"), F.col("id").alias("j"),
        (F.col("id") % F.lit(7990 if late else 60)).cast("string").alias("v"),
    )
    asked = []
    plain = duplicates.repeat_candidates
    monkeypatch.setattr(duplicates, "repeat_candidates", lambda d, n: asked.append(d.count()) or plain(d, n))
    shown = duplicates.first_repeats(keyed, ["v"], ["k", "j"], 30).collect()
    seen, expected = set(), []
    for j in sorted(range(8000), key=lambda i: (i % 400 > 0, i)):
        v = j % (7990 if late else 60)
        if v in seen:
            expected.append(str(v))
        seen.add(v)
    found = duplicates.first_repeats(keyed, ["v"], ["k", "j"], 30, F.col("v")).collect()
    assert [r["value"] for r in found] == expected[:30] and len(shown) == min(30, len(expected))
    assert max(asked) == 8000 if late else max(asked) < 2000


def test_many_repeated_hashes_are_counted_without_a_look_up(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("cast(id % 1000 as string) as a", "id % 2 as b", "1.5D as c")
    monkeypatch.setattr(duplicates, "FEW_HASHES", 10, raising=False)
    groups = duplicates.repeat_groups(rows, ["a", "b", "c"])
    assert "LeftSemi" not in groups._jdf.queryExecution().toString()
    assert {r["n"] for r in groups.collect()} == {3} and groups.count() == 1000
