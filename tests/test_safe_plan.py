"""Plans with safe defaults: what they promise is what the fixes leave."""

import random

import pytest

import plumbline as pl
from plumbline.config import QualityConfig
from plumbline.operators.repair import apply_fixes
from plumbline.plans.safe import propose_safe_plan

CONFIG = QualityConfig(run_anomaly_checks=False, ranges={"age": (0.0, 120.0)})
SCHEMA = "k long, age double, ward string, pulse string, flag boolean, empty string, spare array<int>"


def table(spark, seed, rows):
    rng = random.Random(seed)
    made = []
    for _ in range(rows):
        age = rng.choice([None, float("nan"), -4.0, 130.0, *[float(rng.randint(20, 60)) for _ in range(16)]])
        ward = rng.choice([None, "a", "b", "b", "c", "c"])
        pulse = rng.choice(["high", None, *[str(rng.randint(60, 90)) for _ in range(9)]])
        made.append((age, ward, pulse, rng.choice([None, True, False, True]), None, rng.choice([None, [1], [2]])))
    made += made[: rows // 30]
    return spark.createDataFrame([(i, *row) for i, row in enumerate(made)], SCHEMA)


def promised(df, share, issues=None, **options):
    issues = issues or pl.validate(df, "k", CONFIG).issues
    plan = propose_safe_plan(df, issues, "k", CONFIG, share, **options)
    repaired = apply_fixes(df, plan.fixes, "k", CONFIG)
    assert {r["status"] for r in repaired.log.collect()} <= {"applied"}
    rows = repaired.data.drop("k").collect()
    gaps = sum(v is None or v != v for row in rows for v in row)
    return plan, len(rows), gaps


@pytest.mark.parametrize("seed", [1, 2])
def test_the_plan_leaves_what_it_promises(spark, seed):
    df = table(spark, seed, 150)
    issues = pl.validate(df, "k", CONFIG).issues
    repaired = []
    for share in (0.0, 0.04, 0.15, 0.6):
        plan, rows, gaps = promised(df, share, issues)
        assert (plan.rows_after, plan.gaps_left) == (rows, gaps)
        assert plan.rows_before == 155 and plan.rows_lost <= share * 155
        if share == 0:
            assert not plan.rows_lost and "drop_rows" not in {f.action for f in plan.fixes}
        repaired.append(plan.repaired)
    # A larger allowance leaves fewer values to make up.
    assert repaired == sorted(repaired, reverse=True) and repaired[0] > repaired[-1]


def test_rows_that_carry_most_findings_go_first(spark):
    # Three rows lack both, five only the first: the allowance of three takes the former.
    rows = [(i, None if i < 8 else 40.0, None if i < 3 else "a") for i in range(20)]
    df = spark.createDataFrame(rows, "k long, age double, ward string")
    plan, left, gaps = promised(df, 0.15)
    assert [(f.column, f.action) for f in plan.fixes] == [("ward", "drop_rows"), ("age", "fill_median")]
    assert (plan.rows_after, left, gaps, plan.repaired) == (17, 17, 0, 5)


def test_outliers_are_dropped_only_on_request(spark):
    rows = [(i, 1000.0 if i == 0 else float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, x double")
    plan, *_ = promised(df, 0.05)
    assert [f.action for f in plan.fixes if f.issue_type == "STATISTICAL_OUTLIER"] == ["cap_outliers"]
    assert plan.rows_lost == 0 or plan.fixes[0].action == "drop_duplicates"
    plan, rows, _ = promised(df, 0.05, droppable=("STATISTICAL_OUTLIER",))
    assert plan.fixes[0].action == "drop_rows" and plan.rows_after == rows == 59


def test_repeats_go_only_as_a_whole(spark):
    rows = [(i, 1.0 if i < 5 else float(i), None if i % 9 == 8 else "w") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, x double, ward string")
    assert "drop_duplicates" not in {f.action for f in promised(df, 0.09)[0].fixes}
    plan, left, _ = promised(df, 0.1)
    assert [f.action for f in plan.fixes][0] == "drop_duplicates" and plan.rows_after == left == 36


def test_words_stay_words_and_empty_tables_have_no_plan(spark):
    words = [(i, "7" if i % 5 == 0 else f"name{i}", None if i % 4 else 2.0) for i in range(40)]
    df = spark.createDataFrame(words, "k long, label string, x double")
    plan, *_ = promised(df, 0.0)
    assert "label" not in {f.column for f in plan.fixes}
    empty = df.limit(0)
    plan = propose_safe_plan(empty, pl.validate(df, "k", CONFIG).issues, "k", CONFIG)
    assert (plan.rows_before, plan.rows_after, plan.gaps_left) == (0, 0, 0)


def test_many_findings_span_several_words(spark):
    names = [f"c{i}" for i in range(70)]
    rng = random.Random(5)
    rows = [(i, *[None if rng.random() < 0.2 else float(rng.randint(0, 9)) for _ in names]) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in names))
    plan, left, gaps = promised(df, 0.3)
    assert (plan.rows_after, plan.gaps_left) == (left, gaps)
