"""Data-quality queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.issues_sql import COMPLETENESS, facts_sql, issues_sql
from plumbline.catalog.views import (
    READINGS, VITALS, VITALS_COLUMNS, VITALS_NUMBERS, VITALS_TEXTS, View, number_sql, table,
)
from plumbline.config import QualityConfig
from plumbline.functions.columns import nan_to_null, text_columns
from plumbline.functions.counts import distinct_counts, value_counts
from plumbline.functions.storage import shared_folder
from plumbline.functions.values import parse_number
from plumbline.operators import checks, duplicates, evidence, facts, profile
from plumbline.operators.repair import issue_categories
from plumbline.plans.validate import ValidationReport, validate
from plumbline.sources.readers import read_csv, read_table
from plumbline.sources.writers import write_table
from plumbline.texts import QUALITY_ADVICE, QUALITY_ADVICE_NONE

CONFIG = QualityConfig()
# The anomaly checks draw random trees and have queries of their own.
WITHOUT_ANOMALIES = QualityConfig(run_anomaly_checks=False)
WITH_FOREST = QualityConfig(anomaly_neighbour_search="forest")

LINEITEM_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)
LINEITEM_NUMBERS = LINEITEM_COLUMNS[:8]
LINEITEM_REPEATS = ("l_returnflag", "l_linestatus", "l_quantity", "l_discount")

CSV_TABLE = View(
    "customer",
    (
        "CAST(c_custkey AS STRING) AS row_key",
        "CASE WHEN c_custkey % 7 = 0 THEN '?' WHEN c_custkey % 11 = 0 THEN 'N/A' "
        "ELSE CAST(c_acctbal AS STRING) END AS amount",
        "CASE WHEN c_custkey % 5 = 0 THEN 'None' ELSE CAST(c_nationkey AS STRING) END AS nation",
        "concat(c_name, ', \"', c_mktsegment, '\"') AS label",
        "CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END AS segment",
        "'NA' AS nothing",
        "CAST(1234567890123456000 + c_custkey AS STRING) AS long_id",
    ),
)


def scan_csv_missing(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/customers-{uuid.uuid4().hex}.csv"
    write_table(CSV_TABLE.frame(spark, folder), path)
    return read_csv(spark, path)


SCAN_CSV_SQL = """
SELECT c_custkey AS row_key,
  CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS amount,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS nation,
  concat(c_name, ', "', c_mktsegment, '"') AS label,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment,
  CAST(NULL AS DOUBLE) AS nothing,
  1234567890123456000 + CAST(c_custkey AS BIGINT) AS long_id
FROM customer"""


def scan_parquet(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, f"{folder}/part.parquet")


NOISY = View(
    "customer",
    (*VITALS.cells, "CASE WHEN c_custkey % 4 = 0 THEN CAST('NaN' AS DOUBLE) "
     "WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS noisy"),
)


def missing_mask(spark: SparkSession, folder: str) -> DataFrame:
    clean = nan_to_null(NOISY.frame(spark, folder))
    return facts.missing_counts(clean, [*VITALS_COLUMNS, "noisy"])


MISSING_SQL = f"WITH v AS ({NOISY.sql}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count_if({c} IS NULL) AS null_count FROM v"
    if c != "noisy"
    else f"SELECT '{c}', count(*), count_if({c} IS NULL OR isnan({c})) FROM v"
    for c in [*VITALS_COLUMNS, "noisy"]
)


def drop_empty_columns(spark: SparkSession, folder: str) -> DataFrame:
    return facts.drop_empty_columns(VITALS.frame(spark, folder), VITALS_COLUMNS)


DROP_EMPTY_SQL = f"SELECT * EXCLUDE (bmi) FROM ({VITALS.sql})"


def insufficient_rows(spark: SparkSession, folder: str) -> DataFrame:
    small = checks.too_few_rows(table(spark, folder, "region"), CONFIG)
    large = checks.too_few_rows(table(spark, folder, "nation"), CONFIG)
    return small.unionByName(large)


INSUFFICIENT_SQL = """
SELECT 'warning' AS severity, 'INSUFFICIENT_ROWS' AS issue_type, n AS affected_rows
FROM (SELECT count(*) AS n FROM region UNION ALL SELECT count(*) FROM nation) WHERE n < 10"""

REPEAT_SETS = (
    ("lineitem", LINEITEM_REPEATS), ("lineitem", LINEITEM_COLUMNS), ("documents", ("text",)),
)


def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        duplicates.repeat_count(table(spark, folder, source), columns).select(
            F.lit(f"{source}:{len(columns)}").alias("compared"), "affected_rows"
        )
        for source, columns in REPEAT_SETS
    ]
    vitals = duplicates.repeat_count(VITALS.frame(spark, folder), ["weight_kg", "segment"])
    parts.append(vitals.select(F.lit("vitals:2").alias("compared"), "affected_rows"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _repeats_sql(label: str, source: str, columns: tuple) -> str:
    return (
        f"SELECT '{label}' AS compared, CAST(sum(n - 1) AS BIGINT) AS affected_rows FROM "
        f"(SELECT count(*) AS n FROM {source} GROUP BY {', '.join(columns)})"
    )


DUPLICATE_ROWS_SQL = " UNION ALL ".join(
    [_repeats_sql(f"{s}:{len(c)}", s, c) for s, c in REPEAT_SETS]
    + [_repeats_sql("vitals:2", f"({VITALS.sql})", ("weight_kg", "segment"))]
)


def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.repeat_count(VITALS.frame(spark, folder), ["patient_id"]).select(
        F.lit("patient_id").alias("column"), "affected_rows"
    )


DUPLICATE_IDS_SQL = f"""
SELECT 'patient_id' AS "column", CAST(sum(n - 1) AS BIGINT) AS affected_rows
FROM (SELECT count(*) AS n FROM ({VITALS.sql}) GROUP BY patient_id)"""


def ids_under_key(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated identifiers where the identifier is the row key too."""
    vitals = VITALS.frame(spark, folder).drop("row_key")
    issues = validate(vitals, "patient_id", WITHOUT_ANOMALIES).issues
    return issues.filter("issue_type = 'DUPLICATE_IDS'").select("issue_type", "column", "affected_rows")


IDS_UNDER_KEY_SQL = f"""
SELECT 'DUPLICATE_IDS' AS issue_type, 'patient_id' AS "column", CAST(sum(n - 1) AS BIGINT) AS affected_rows
FROM (SELECT count(*) AS n FROM ({VITALS.sql}) GROUP BY patient_id) HAVING sum(n - 1) > 0"""


def duplicate_examples(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return duplicates.first_repeats(
        orders, ["o_custkey", "o_orderstatus"], "o_orderkey", CONFIG.max_examples,
        F.col("o_custkey"),
    )


DUPLICATE_EXAMPLES_SQL = """
SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS rank,
  CAST(o_orderkey AS VARCHAR) AS row_key, CAST(o_custkey AS VARCHAR) AS value
FROM (SELECT o_orderkey, o_custkey,
        row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS place
      FROM orders)
WHERE place > 1 ORDER BY o_orderkey LIMIT 20"""


def _vitals_facts(spark: SparkSession, folder: str) -> DataFrame:
    return facts.column_facts(VITALS.frame(spark, folder), VITALS_COLUMNS, CONFIG)


ISSUE_COLUMNS = ("severity", "issue_type", "column", "affected_rows", "fraction")
VITALS_FACTS_SQL = f"v AS ({VITALS.sql}), {facts_sql('v', VITALS_NUMBERS, VITALS_TEXTS)}"
VITALS_ISSUES_SQL = (
    f"v AS ({VITALS.sql}), {issues_sql('v', VITALS_NUMBERS, VITALS_TEXTS, 'patient_id')}"
)


def completeness(spark: SparkSession, folder: str) -> DataFrame:
    return checks.completeness_issues(_vitals_facts(spark, folder), CONFIG)


COMPLETENESS_SQL = f"""
WITH {VITALS_FACTS_SQL}
SELECT CASE WHEN issue_type IN ('EMPTY_COLUMN', 'HIGH_NULL_RATE') THEN 'critical'
            WHEN issue_type = 'MODERATE_NULL_RATE' THEN 'warning' ELSE 'info' END AS severity,
  issue_type, "column", affected_rows, affected_rows * 1.0 / n_rows AS fraction
FROM ({COMPLETENESS}) WHERE issue_type IS NOT NULL"""


def type_inconsistency(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    parts = []
    for frame in (VITALS.frame(spark, folder), documents):
        names = text_columns(frame, frame.columns)
        known = facts.text_facts(value_counts(frame, names, "string"))
        rows = facts.missing_counts(frame, names)
        parts.append(checks.type_issues(rows.join(known, "column"), CONFIG))
    return parts[0].unionByName(parts[1])


def _type_sql(source: str, texts: tuple) -> str:
    return f"""SELECT 'warning' AS severity, 'TYPE_INCONSISTENCY' AS issue_type, "column",
  unparsable AS affected_rows, unparsable * 1.0 / n_rows AS fraction
FROM (WITH v AS ({source}), {facts_sql('v', (), texts)} SELECT * FROM facts)
WHERE unparsable > 0 AND texts * 1.0 / n_rows >= 0.05"""


TYPE_SQL = (
    f"{_type_sql(VITALS.sql, VITALS_TEXTS)} UNION ALL "
    f"{_type_sql('SELECT * FROM documents', ('text', 'lang', 'source'))}"
)


def domain_violations(spark: SparkSession, folder: str) -> DataFrame:
    readings = READINGS.frame(spark, folder)
    return checks.range_issues(_vitals_facts(spark, folder)).unionByName(
        checks.range_issues(facts.column_facts(readings, ["heart_rate"], CONFIG))
    )


def _range_sql(with_: str) -> str:
    return f"""SELECT 'critical' AS severity, issue_type, "column", affected_rows,
  affected_rows * 1.0 / n_rows AS fraction FROM (WITH {with_}
  SELECT 'VALUE_BELOW_RANGE' AS issue_type, "column", below AS affected_rows, n_rows FROM facts
  UNION ALL SELECT 'VALUE_ABOVE_RANGE', "column", above, n_rows FROM facts)
WHERE affected_rows > 0"""


READINGS_FACTS_SQL = f"v AS ({READINGS.sql}), {facts_sql('v', ('heart_rate',), ())}"
DOMAIN_SQL = f"{_range_sql(VITALS_FACTS_SQL)} UNION ALL {_range_sql(READINGS_FACTS_SQL)}"


def zscore_outliers(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name, numbers in (("events", ["value", "user_id"]), ("lineitem", LINEITEM_NUMBERS)):
        frame = table(spark, folder, name)
        measured = facts.column_facts(frame, numbers, CONFIG).collect()
        rows = measured[0]["n_rows"]
        found = facts.outlier_counts(frame, measured, CONFIG)
        parts.append(checks.outlier_issues(found.withColumn("n_rows", F.lit(rows))))
    return parts[0].unionByName(parts[1])


def _outlier_sql(source: str, numbers: tuple) -> str:
    return f"""SELECT 'warning' AS severity, 'STATISTICAL_OUTLIER' AS issue_type, "column",
  affected_rows, affected_rows * 1.0 / n_rows AS fraction
FROM (WITH {facts_sql(source, numbers, ())} SELECT * FROM outliers)"""


OUTLIER_SQL = (
    f"{_outlier_sql('events', ('value', 'user_id'))} UNION ALL "
    f"{_outlier_sql('lineitem', LINEITEM_NUMBERS)}"
)


def issue_examples(spark: SparkSession, folder: str) -> DataFrame:
    readings = READINGS.frame(spark, folder)
    measured = facts.column_facts(readings, ["heart_rate", "event_type", "note"], CONFIG).collect()
    found = checks.row_checks(readings, measured, CONFIG)
    shown = evidence.issue_examples(readings, "row_key", found, CONFIG)
    return shown.withColumn("z_score", F.round("z_score", 6))


def _example_sql(issue_type: str, name: str, where: str, limit: int, score: str) -> str:
    return f"""SELECT '{issue_type}' AS issue_type, '{name}' AS "column",
  CAST(row_number() OVER (ORDER BY row_key) AS INTEGER) AS rank,
  CAST(row_key AS VARCHAR) AS row_key, CAST({name} AS VARCHAR) AS value, {score} AS z_score
FROM v, m WHERE {where} QUALIFY row_number() OVER (ORDER BY row_key) <= {limit}"""


_Z = "(heart_rate - mean) / std"
_NO_Z = "CAST(NULL AS DOUBLE)"
EXAMPLES_SQL = f"""WITH v AS ({READINGS.sql}),
m AS (SELECT avg(heart_rate) AS mean, stddev_samp(heart_rate) AS std FROM v)
{_example_sql('VALUE_BELOW_RANGE', 'heart_rate', 'heart_rate < 20', 20, _NO_Z)} UNION ALL
{_example_sql('VALUE_ABOVE_RANGE', 'heart_rate', 'heart_rate > 250', 20, _NO_Z)} UNION ALL
{_example_sql('STATISTICAL_OUTLIER', 'heart_rate', f'abs({_Z}) > 3', 20, f'round({_Z}, 6)')} UNION ALL
{_example_sql('TYPE_INCONSISTENCY', 'event_type', f'event_type IS NOT NULL AND {number_sql("event_type")} IS NULL', 10, _NO_Z)} UNION ALL
{_example_sql('TYPE_INCONSISTENCY', 'note', f'note IS NOT NULL AND {number_sql("note")} IS NULL', 10, _NO_Z)}"""


def profile_base(spark: SparkSession, folder: str) -> DataFrame:
    frame = table(spark, folder, "lineitem").select(*LINEITEM_COLUMNS)
    lines = profile.base_profile(
        facts.column_facts(frame, LINEITEM_COLUMNS, CONFIG),
        distinct_counts(frame, LINEITEM_COLUMNS),
    )
    vitals = VITALS.frame(spark, folder)
    return lines.unionByName(
        profile.base_profile(
            facts.column_facts(vitals, VITALS_COLUMNS, CONFIG),
            distinct_counts(vitals, VITALS_COLUMNS),
        )
    )


def _base_sql(source: str, columns: tuple) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS null_count, "
        f"count_if({c} IS NULL) * 1.0 / count(*) AS null_fraction, "
        f"count(DISTINCT {c}) AS unique_count, "
        f"count(DISTINCT {c}) * 1.0 / count(*) AS unique_fraction FROM {source}"
        for c in columns
    )


PROFILE_BASE_SQL = (
    f"WITH v AS ({VITALS.sql}) {_base_sql('lineitem', LINEITEM_COLUMNS)} UNION ALL "
    f"{_base_sql('v', VITALS_COLUMNS)}"
)


def profile_samples(spark: SparkSession, folder: str) -> DataFrame:
    vitals = VITALS.frame(spark, folder)
    counted = facts.missing_counts(vitals, VITALS_COLUMNS).collect()
    present = {r["column"]: r["n_rows"] - r["null_count"] for r in counted}
    return profile.sample_values(vitals, "row_key", present, CONFIG)


PROFILE_SAMPLES_SQL = f"WITH v AS ({VITALS.sql}) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY row_key) AS INTEGER) AS rank,
  CAST({c} AS VARCHAR) AS value FROM v WHERE {c} IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY row_key) <= 5"""
    for c in VITALS_COLUMNS
)


def profile_numeric(spark: SparkSession, folder: str) -> DataFrame:
    frame = table(spark, folder, "lineitem")
    lines = profile.number_profile(facts.column_facts(frame, LINEITEM_NUMBERS, CONFIG))
    both = lines.unionByName(profile.number_profile(_vitals_facts(spark, folder)))
    return both.withColumns({"mean": F.round("mean", 5), "std": F.round("std", 5)})


def _number_sql(with_: str) -> str:
    return f"""SELECT * FROM (WITH {with_} SELECT "column", round(mean, 5) AS mean,
  round(std, 5) AS std, min_val, max_val FROM facts WHERE mean IS NOT NULL)"""


PROFILE_NUMERIC_SQL = (
    f"{_number_sql(facts_sql('lineitem', LINEITEM_NUMBERS, ()))} UNION ALL "
    f"{_number_sql(VITALS_FACTS_SQL)}"
)


def profile_top_categories(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    vitals = VITALS.frame(spark, folder)
    return profile.top_values(orders, ["o_orderstatus", "o_orderpriority"], 5).unionByName(
        profile.top_values(vitals, VITALS_TEXTS, 5)
    )


def _top_sql(source: str, name: str) -> str:
    return f"""SELECT '{name}' AS "column",
  CAST(row_number() OVER (ORDER BY count(*) DESC, {name}) AS INTEGER) AS rank,
  {name} AS value, count(*) AS n
FROM {source} WHERE {name} IS NOT NULL GROUP BY {name}
QUALIFY row_number() OVER (ORDER BY count(*) DESC, {name}) <= 5"""


PROFILE_TOP_SQL = f"WITH v AS ({VITALS.sql}) " + " UNION ALL ".join(
    [_top_sql("orders", "o_orderstatus"), _top_sql("orders", "o_orderpriority")]
    + [_top_sql("v", c) for c in VITALS_TEXTS]
)


def _vitals_report(spark: SparkSession, folder: str) -> ValidationReport:
    return validate(VITALS.frame(spark, folder), "row_key", WITHOUT_ANOMALIES)


def dq_issues(spark: SparkSession, folder: str) -> DataFrame:
    return _vitals_report(spark, folder).issues.select(*ISSUE_COLUMNS)


DQ_ISSUES_SQL = f"""WITH {VITALS_ISSUES_SQL}
SELECT severity, issue_type, "column", affected_rows, affected_rows * 1.0 / n_rows AS fraction
FROM issues"""


def dq_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = _vitals_report(spark, folder).summary
    return spark.createDataFrame(
        [tuple(summary.values())],
        "total_rows bigint, total_columns int, numeric_columns int, categorical_columns int, "
        "total_missing_values bigint, completeness double, overall_completeness string, "
        "duplicate_rows bigint, critical_issues bigint, warnings bigint, info bigint",
    )


DQ_SUMMARY_SQL = f"""WITH {VITALS_ISSUES_SQL},
cells AS (SELECT CAST(sum(null_count) AS BIGINT) AS missing, max(n_rows) AS n FROM facts)
SELECT n AS total_rows, {len(VITALS_COLUMNS)} AS total_columns,
  {len(VITALS_NUMBERS)} AS numeric_columns, {len(VITALS_TEXTS)} AS categorical_columns,
  missing AS total_missing_values, 1 - missing * 1.0 / (n * {len(VITALS_COLUMNS)}) AS completeness,
  printf('%.1f%%', (1 - missing * 1.0 / (n * {len(VITALS_COLUMNS)})) * 100) AS overall_completeness,
  coalesce((SELECT any_value(affected_rows) FROM issues WHERE issue_type = 'DUPLICATE_ROWS'), 0)
    AS duplicate_rows,
  (SELECT count(*) FROM issues WHERE severity = 'critical') AS critical_issues,
  (SELECT count(*) FROM issues WHERE severity = 'warning') AS warnings,
  (SELECT count(*) FROM issues WHERE severity = 'info') AS info
FROM cells"""


def dq_status(spark: SparkSession, folder: str) -> DataFrame:
    return checks.status_of(_vitals_report(spark, folder).issues)


DQ_STATUS_SQL = f"""WITH {VITALS_ISSUES_SQL}
SELECT CASE WHEN count_if(severity = 'critical') > 0 THEN 'FAIL'
            WHEN count_if(severity = 'warning') > 0 THEN 'WARNING' ELSE 'PASS' END AS status
FROM issues"""


def dq_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    return _vitals_report(spark, folder).recommendations


def _advice_sql(issues: str) -> str:
    rules = ", ".join(
        f"({n}, '{kind}', '{text}')"
        for n, (kinds, text) in enumerate(QUALITY_ADVICE, 1)
        for kind in kinds
    )
    return f"""WITH {issues},
rules(rule, issue_type, recommendation) AS (VALUES {rules}),
fired AS (SELECT DISTINCT rule, recommendation FROM rules WHERE issue_type IN
  (SELECT issue_type FROM issues WHERE severity IN ('critical', 'warning')))
SELECT * FROM fired UNION ALL
SELECT {len(QUALITY_ADVICE) + 1}, '{QUALITY_ADVICE_NONE}' WHERE NOT EXISTS (SELECT 1 FROM fired)"""


def categories(spark: SparkSession, folder: str) -> DataFrame:
    return issue_categories(_vitals_report(spark, folder).issues)


CATEGORIES_SQL = f"""WITH {VITALS_ISSUES_SQL}
SELECT CASE WHEN issue_type = 'EMPTY_COLUMN' THEN 'Empty Columns'
    WHEN issue_type IN ('HIGH_NULL_RATE', 'MODERATE_NULL_RATE') THEN 'Missing Values'
    WHEN issue_type = 'TYPE_INCONSISTENCY' THEN 'Type Inconsistencies'
    WHEN issue_type IN ('VALUE_BELOW_RANGE', 'VALUE_ABOVE_RANGE') THEN 'Domain Violations'
    WHEN issue_type IN ('DUPLICATE_ROWS', 'DUPLICATE_IDS') THEN 'Duplicate Data'
    WHEN issue_type = 'STATISTICAL_OUTLIER' THEN 'Outliers & Anomalies'
    ELSE 'Other' END AS category, count(*) AS n_issues
FROM issues WHERE severity IN ('critical', 'warning') GROUP BY 1"""


def validate_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Validation of the largest table, whose keys name the rows, without the anomaly checks.

    ``validate_lines`` takes all columns, ``validate_wide`` the anomaly checks too.
    """
    frame = table(spark, folder, "lineitem").select(*LINEITEM_COLUMNS).withColumns(
        {"line": F.col("l_linenumber"), "order_key": F.col("l_orderkey"),
         "part": F.col("l_partkey"), "supplier": F.col("l_suppkey")}
    )
    frame = frame.drop("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    report = validate(frame, ["order_key", "line", "part", "supplier"], WITHOUT_ANOMALIES)
    return report.issues.select(*ISSUE_COLUMNS)


# Days stand for dates, which have neither a range nor, spread evenly, outliers.
_LINE_SOURCE = "(SELECT * REPLACE (date_diff('day', DATE '1992-01-01', l_shipdate) AS l_shipdate) FROM lineitem)"
_LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
_LINE_TEXTS = ("l_returnflag", "l_linestatus")
VALIDATE_LINEITEM_SQL = f"""WITH {issues_sql(_LINE_SOURCE, _LINE_NUMBERS, _LINE_TEXTS)}
SELECT severity, issue_type, "column", affected_rows, affected_rows * 1.0 / n_rows AS fraction
FROM issues"""


# Every column of the largest table, some under names that have a plausible range.
LINES = View(
    "lineitem",
    (
        "l_orderkey AS order_key", "l_linenumber AS line", "l_partkey AS part", "l_suppkey AS supplier",
        "l_quantity AS heart_rate", "l_extendedprice AS price", "l_discount * 100 AS ECOG",
        "l_tax * 100 AS pain_score", "l_returnflag AS flag", "l_linestatus AS status",
        "CAST(l_shipdate AS STRING) AS shipped",
    ),
)
LINES_NUMBERS = ("part", "supplier", "heart_rate", "price", "ECOG", "pain_score")
LINES_TEXTS = ("flag", "status", "shipped")


def validate_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Full validation of all columns of the largest table, with values out of range."""
    report = validate(LINES.frame(spark, folder), ["order_key", "line"], WITHOUT_ANOMALIES)
    return report.issues.select(*ISSUE_COLUMNS)


def validate_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Full validation of the largest table with both anomaly methods, neighbours from a forest."""
    report = validate(LINES.frame(spark, folder), ["order_key", "line"], WITH_FOREST)
    return report.issues.select(*ISSUE_COLUMNS)


VALIDATE_LINES_SQL = f"""WITH v AS ({LINES.sql}), {issues_sql('v', LINES_NUMBERS, LINES_TEXTS)}
SELECT severity, issue_type, "column", affected_rows, affected_rows * 1.0 / n_rows AS fraction
FROM issues"""


def to_numeric_coerce(spark: SparkSession, folder: str) -> DataFrame:
    return VITALS.frame(spark, folder).select(
        "row_key", "heart_rate", parse_number(F.col("heart_rate")).alias("number")
    )


TO_NUMERIC_SQL = f"SELECT row_key, heart_rate, {number_sql('heart_rate')} AS number FROM ({VITALS.sql})"

QUERIES = {
    "scan_csv_missing": (scan_csv_missing, SCAN_CSV_SQL),
    "scan_parquet": (scan_parquet, "SELECT * FROM part"),
    "missing_mask": (missing_mask, MISSING_SQL),
    "drop_empty_columns": (drop_empty_columns, DROP_EMPTY_SQL),
    "insufficient_rows": (insufficient_rows, INSUFFICIENT_SQL),
    "duplicate_rows": (duplicate_rows, DUPLICATE_ROWS_SQL),
    "duplicate_ids": (duplicate_ids, DUPLICATE_IDS_SQL),
    "ids_under_key": (ids_under_key, IDS_UNDER_KEY_SQL),
    "duplicate_examples": (duplicate_examples, DUPLICATE_EXAMPLES_SQL),
    "completeness": (completeness, COMPLETENESS_SQL),
    "type_inconsistency": (type_inconsistency, TYPE_SQL),
    "domain_violations": (domain_violations, DOMAIN_SQL),
    "zscore_outliers": (zscore_outliers, OUTLIER_SQL),
    "issue_examples": (issue_examples, EXAMPLES_SQL),
    "profile_base": (profile_base, PROFILE_BASE_SQL),
    "profile_samples": (profile_samples, PROFILE_SAMPLES_SQL),
    "profile_numeric": (profile_numeric, PROFILE_NUMERIC_SQL),
    "profile_top_categories": (profile_top_categories, PROFILE_TOP_SQL),
    "dq_issues": (dq_issues, DQ_ISSUES_SQL),
    "dq_summary": (dq_summary, DQ_SUMMARY_SQL),
    "dq_status": (dq_status, DQ_STATUS_SQL),
    "dq_recommendations": (dq_recommendations, _advice_sql(VITALS_ISSUES_SQL)),
    "issue_categories": (categories, CATEGORIES_SQL),
    "validate_lineitem": (validate_lineitem, VALIDATE_LINEITEM_SQL),
    "validate_lines": (validate_lines, VALIDATE_LINES_SQL),
    "validate_wide": (validate_wide, None),
    "to_numeric_coerce": (to_numeric_coerce, TO_NUMERIC_SQL),
}
