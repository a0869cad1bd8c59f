"""Repair queries: one per action, a chain, and validation of the repaired table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.issues_sql import issues_sql
from plumbline.catalog.views import READINGS, VITALS, VITALS_COLUMNS, View, number_sql
from plumbline.config import CLINICAL_RANGES, QualityConfig
from plumbline.operators.repair import Fix, apply_fixes
from plumbline.plans.remediate import revalidate as revalidate_plan
from plumbline.plans.safe import propose_safe_plan
from plumbline.plans.validate import validate

CONFIG = QualityConfig(run_anomaly_checks=False)

ORDER_ROWS = View("orders", ("o_orderkey AS row_key", "o_custkey", "o_orderstatus"))


def _repair(view: View, fixes: Sequence[Fix], rounded: Sequence[str] = ()):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        data = apply_fixes(view.frame(spark, folder), fixes, "row_key", CONFIG).data
        return data.withColumns({c: F.round(c, 6) for c in rounded})

    return query


def _vitals_with(name: str, expression: str, where: str = "TRUE") -> str:
    """The vitals with one column replaced."""
    cells = ", ".join(
        f"{expression} AS {c}" if c == name else c for c in ("row_key", *VITALS_COLUMNS)
    )
    return f"WITH v AS ({VITALS.sql}) SELECT {cells} FROM v WHERE {where}"


def _readings_with(expression: str) -> str:
    return f"""WITH v AS ({READINGS.sql}),
m AS (SELECT avg(heart_rate) AS mean, stddev_samp(heart_rate) AS std,
  median(heart_rate) AS middle FROM v)
SELECT row_key, round({expression}, 6) AS heart_rate, event_type, note FROM v, m"""


def _first_sql(view: View, keys: str, direction: str = "") -> str:
    return f"""SELECT * FROM ({view.sql})
QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY row_key {direction}) = 1"""


_MEAN = "(SELECT avg({0}) FROM v)"
_MEDIAN = "(SELECT median({0}) FROM v)"
_MODE = (
    "(SELECT {0} FROM v WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1)"
)
_NUMBER = number_sql("heart_rate")
_PARSED_MEDIAN = f"(SELECT median({_NUMBER}) FROM v)"

CHAIN = [
    Fix("EMPTY_COLUMN", "bmi", "drop_column"),
    Fix("HIGH_NULL_RATE", "weight_kg", "fill_median"),
    Fix("MODERATE_NULL_RATE", "blood_pressure_systolic", "fill_mean"),
    Fix("TYPE_INCONSISTENCY", "heart_rate", "convert_numeric_fill_median"),
    Fix("VALUE_ABOVE_RANGE", "age", "drop_rows"),
    Fix("VALUE_BELOW_RANGE", "age", "replace_median"),
    Fix("DUPLICATE_IDS", "patient_id", "drop_duplicate_ids", {"confirm": True}),
    Fix("MODERATE_NULL_RATE", "segment", "fill_mode"),
    Fix("MODERATE_NULL_RATE", "bmi", "fill_median"),
]
# The last fix names a column that is gone: it is logged and skipped.
CHAIN_SQL = f"""v AS ({VITALS.sql}),
c1 AS (SELECT row_key, patient_id, age, {_NUMBER} AS parsed, blood_pressure_systolic, weight_kg,
  segment, age < 0 AS low_age, age > 120 AS high_age FROM v),
c2 AS (SELECT row_key, patient_id, age, low_age, high_age, segment,
  coalesce(parsed, (SELECT median(parsed) FROM c1)) AS heart_rate,
  coalesce(blood_pressure_systolic, (SELECT avg(blood_pressure_systolic) FROM c1))
    AS blood_pressure_systolic,
  coalesce(weight_kg, (SELECT median(weight_kg) FROM c1)) AS weight_kg FROM c1),
c3 AS (SELECT * FROM c2 WHERE NOT high_age),
c4 AS (SELECT row_key, patient_id,
  CASE WHEN low_age THEN (SELECT median(age) FROM c3) ELSE CAST(age AS DOUBLE) END AS age,
  heart_rate, blood_pressure_systolic, weight_kg, segment FROM c3),
c5 AS (SELECT * FROM c4
  QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY row_key) = 1),
c6 AS (SELECT row_key, patient_id, age, heart_rate, blood_pressure_systolic, weight_kg,
  coalesce(segment, (SELECT segment FROM c5 WHERE segment IS NOT NULL GROUP BY segment
    ORDER BY count(*) DESC, segment LIMIT 1)) AS segment FROM c5)"""


def fix_effects(spark: SparkSession, folder: str) -> DataFrame:
    """Log of the chain beside what each applied fix of rows or gaps leaves behind, from the data."""
    repaired = apply_fixes(VITALS.frame(spark, folder), CHAIN, "row_key", CONFIG)
    applied = repaired.log.filter("status = 'applied'").count()
    return repaired.data.agg(
        F.lit(applied).cast("bigint").alias("applied"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("weight_kg").isNull() | F.col("segment").isNull()).alias("gaps"),
        F.count_distinct("patient_id").alias("patients"),
        F.count_if((F.col("age") < 0) | (F.col("age") > 120)).alias("out_of_range"),
    )


FIX_EFFECTS_SQL = f"""WITH {CHAIN_SQL}
SELECT CAST({len(CHAIN) - 1} AS BIGINT) AS applied, count(*) AS rows,
  count_if(weight_kg IS NULL OR segment IS NULL) AS gaps, count(DISTINCT patient_id) AS patients,
  count_if(age < 0 OR age > 120) AS out_of_range FROM c6"""


def fix_log(spark: SparkSession, folder: str) -> DataFrame:
    return apply_fixes(VITALS.frame(spark, folder), CHAIN, "row_key", CONFIG).log.select(
        "step", "action", "column", "status"
    )


# A fix is skipped where an earlier one dropped its column, which it does as the column is empty.
_STEPS = ", ".join(
    f"({i}, '{f.action}', '{f.column}', {i > 0 and f.column in {d.column for d in CHAIN[:i] if d.action == 'drop_column'}})"
    for i, f in enumerate(CHAIN)
)
FIX_LOG_SQL = f"""WITH v AS ({VITALS.sql}), e AS (SELECT count(bmi) = 0 AS nothing FROM v)
SELECT step, action, "column", CASE WHEN after_drop AND nothing THEN 'skipped' ELSE 'applied' END AS status
FROM (VALUES {_STEPS}) AS t(step, action, "column", after_drop), e"""


def revalidate(spark: SparkSession, folder: str) -> DataFrame:
    report = revalidate_plan(VITALS.frame(spark, folder), CHAIN, "row_key", CONFIG)
    return report.issues.select("severity", "issue_type", "column", "affected_rows", "fraction")


_LEFT = ("patient_id", "age", "heart_rate", "blood_pressure_systolic", "weight_kg")
REVALIDATE_SQL = f"""WITH {CHAIN_SQL}, {issues_sql('c6', _LEFT, ('segment',), 'patient_id')}
SELECT severity, issue_type, "column", affected_rows, affected_rows * 1.0 / n_rows AS fraction
FROM issues"""

SAFE_SHARE = 0.06
_RANGED = ("age", "blood_pressure_systolic", "weight_kg")


def safe_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What the plan with safe defaults promises, beside what its fixes leave."""
    frame = VITALS.frame(spark, folder)
    issues = validate(frame, "row_key", CONFIG).issues
    droppable = ("TYPE_INCONSISTENCY", "VALUE_ABOVE_RANGE")
    plan = propose_safe_plan(frame, issues, "row_key", CONFIG, SAFE_SHARE, droppable)
    left = apply_fixes(frame, plan.fixes, "row_key", CONFIG).data
    cells = [c for c in left.columns if c != "row_key"]
    gaps = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("bigint") for c in cells])
    return left.agg(
        F.lit(plan.rows_before).cast("bigint").alias("rows_before"),
        F.lit(plan.rows_after).cast("bigint").alias("rows_promised"),
        F.count(F.lit(1)).alias("rows_left"),
        F.lit(plan.gaps_left).cast("bigint").alias("gaps_promised"),
        F.sum(gaps).cast("bigint").alias("gaps_left"),
        F.lit(plan.repaired).cast("bigint").alias("repaired"),
    )


# Droppable findings below the bound go, which they fit into together; a column with less than a tenth
# missing keeps its gaps.
_DROPPABLE_MARKS = {
    "bad_pulse": f"{_NUMBER} IS NULL",
    **{f"high_{c}": f"{c} > {CLINICAL_RANGES[c][1]}" for c in _RANGED},
}
_MARKS = {
    **_DROPPABLE_MARKS, **{f"low_{c}": f"{c} < {CLINICAL_RANGES[c][0]}" for c in _RANGED},
    "no_pressure": "blood_pressure_systolic IS NULL", "no_weight": "weight_kg IS NULL",
}
_GONE = " OR ".join(f"(s.{m} <= {SAFE_SHARE} AND f.{m})" for m in _DROPPABLE_MARKS)
_REPAIRED = " + ".join(
    f"CASE WHEN s.{m} <= {SAFE_SHARE} AND {m in _DROPPABLE_MARKS} THEN 0 ELSE k.{m} END" for m in _MARKS
)
_OPEN = "CASE WHEN s.no_segment < 0.1 THEN k.no_segment ELSE 0 END"
SAFE_PLAN_SQL = f"""WITH v AS ({VITALS.sql}),
f AS (SELECT segment IS NULL AS no_segment,
  {', '.join(f'coalesce({e}, FALSE) AS {m}' for m, e in _MARKS.items())} FROM v),
s AS (SELECT {', '.join(f'count_if({m}) * 1.0 / count(*) AS {m}' for m in ('no_segment', *_MARKS))} FROM f),
k AS (SELECT count(*) AS n, {', '.join(f'count_if(f.{m}) AS {m}' for m in ('no_segment', *_MARKS))}
  FROM f, s WHERE NOT ({_GONE}))
SELECT (SELECT count(*) FROM v) AS rows_before, k.n AS rows_promised, k.n AS rows_left,
  {_OPEN} AS gaps_promised, {_OPEN} AS gaps_left, CAST({_REPAIRED} AS BIGINT) AS repaired FROM k, s"""

_LOW_AGE = Fix("VALUE_BELOW_RANGE", "age", "drop_rows")
_OUTLIER = ("STATISTICAL_OUTLIER", "heart_rate")

QUERIES = {
    "fix_drop_column": (
        _repair(VITALS, [Fix("EMPTY_COLUMN", "bmi", "drop_column")]),
        f"SELECT * EXCLUDE (bmi) FROM ({VITALS.sql})",
    ),
    "fix_fill_median": (
        _repair(VITALS, [Fix("HIGH_NULL_RATE", "weight_kg", "fill_median")]),
        _vitals_with("weight_kg", f"coalesce(weight_kg, {_MEDIAN.format('weight_kg')})"),
    ),
    "fix_fill_mean": (
        _repair(
            VITALS, [Fix("MODERATE_NULL_RATE", "blood_pressure_systolic", "fill_mean")],
            ["blood_pressure_systolic"],
        ),
        _vitals_with(
            "blood_pressure_systolic",
            "round(coalesce(CAST(blood_pressure_systolic AS DOUBLE), "
            f"{_MEAN.format('blood_pressure_systolic')}), 6)",
        ),
    ),
    "fix_fill_mode": (
        _repair(VITALS, [Fix("MODERATE_NULL_RATE", "segment", "fill_mode")]),
        _vitals_with("segment", f"coalesce(segment, {_MODE.format('segment')})"),
    ),
    "fix_drop_missing": (
        _repair(VITALS, [Fix("MODERATE_NULL_RATE", "blood_pressure_systolic", "drop_rows")]),
        f"SELECT * FROM ({VITALS.sql}) WHERE blood_pressure_systolic IS NOT NULL",
    ),
    "fix_drop_flagged": (
        _repair(VITALS, [_LOW_AGE]), f"SELECT * FROM ({VITALS.sql}) WHERE NOT age < 0"
    ),
    "fix_numeric_median": (
        _repair(VITALS, [Fix("TYPE_INCONSISTENCY", "heart_rate", "convert_numeric_fill_median")]),
        _vitals_with("heart_rate", f"coalesce({_NUMBER}, {_PARSED_MEDIAN})"),
    ),
    "fix_numeric_drop": (
        _repair(VITALS, [Fix("TYPE_INCONSISTENCY", "heart_rate", "convert_numeric_drop")]),
        f"SELECT * FROM ({VITALS.sql}) WHERE {_NUMBER} IS NOT NULL",
    ),
    "fix_numeric_null": (
        _repair(VITALS, [Fix("TYPE_INCONSISTENCY", "heart_rate", "convert_numeric_nan")]),
        _vitals_with("heart_rate", _NUMBER),
    ),
    "fix_cap_sigma": (
        _repair(READINGS, [Fix("VALUE_ABOVE_RANGE", "heart_rate", "cap_values")], ["heart_rate"]),
        _readings_with("least(greatest(heart_rate, mean - 3 * std), mean + 3 * std)"),
    ),
    "fix_cap_range": (
        _repair(VITALS, [Fix("VALUE_ABOVE_RANGE", "age", "cap_range")]),
        _vitals_with("age", "least(greatest(CAST(age AS DOUBLE), 0.0), 120.0)"),
    ),
    "fix_replace_median": (
        _repair(VITALS, [Fix("VALUE_ABOVE_RANGE", "age", "replace_median")]),
        _vitals_with(
            "age", f"CASE WHEN age > 120 THEN {_MEDIAN.format('age')} ELSE CAST(age AS DOUBLE) END"
        ),
    ),
    "fix_dedup_first": (
        _repair(ORDER_ROWS, [Fix("DUPLICATE_ROWS", None, "drop_duplicates", {"keep": "first"})]),
        _first_sql(ORDER_ROWS, "o_custkey, o_orderstatus"),
    ),
    "fix_dedup_last": (
        _repair(ORDER_ROWS, [Fix("DUPLICATE_ROWS", None, "drop_duplicates", {"keep": "last"})]),
        _first_sql(ORDER_ROWS, "o_custkey, o_orderstatus", "DESC"),
    ),
    "fix_dedup_ids": (
        _repair(
            VITALS, [Fix("DUPLICATE_IDS", "patient_id", "drop_duplicate_ids", {"confirm": True})]
        ),
        _first_sql(VITALS, "patient_id"),
    ),
    "fix_cap_outliers": (
        _repair(READINGS, [Fix(*_OUTLIER, "cap_outliers", {"threshold": 2.0})], ["heart_rate"]),
        _readings_with("least(greatest(heart_rate, mean - 2 * std), mean + 2 * std)"),
    ),
    "fix_outliers_median": (
        _repair(READINGS, [Fix(*_OUTLIER, "replace_outliers_median")], ["heart_rate"]),
        _readings_with(
            "CASE WHEN abs((heart_rate - mean) / std) > 3 THEN middle ELSE heart_rate END"
        ),
    ),
    "fix_drop_outliers": (
        _repair(READINGS, [Fix(*_OUTLIER, "drop_rows")]),
        f"""WITH v AS ({READINGS.sql}),
m AS (SELECT avg(heart_rate) AS mean, stddev_samp(heart_rate) AS std FROM v)
SELECT v.* FROM v, m WHERE NOT abs((heart_rate - mean) / std) > 3""",
    ),
    "fix_chain": (
        _repair(VITALS, CHAIN, ["blood_pressure_systolic"]),
        f"WITH {CHAIN_SQL} SELECT * REPLACE (round(blood_pressure_systolic, 6) "
        "AS blood_pressure_systolic) FROM c6",
    ),
    "fix_log": (fix_log, FIX_LOG_SQL),
    "fix_effects": (fix_effects, FIX_EFFECTS_SQL),
    "revalidate": (revalidate, REVALIDATE_SQL),
    "safe_plan": (safe_plan, SAFE_PLAN_SQL),
}
