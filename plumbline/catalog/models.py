"""Queries of the proxy model: target, imputation, encoding, split, predictions, full audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.views import CASES, VITALS, VITALS_COLUMNS, table
from plumbline.operators import scoring
from plumbline.operators.facts import drop_empty_columns
from plumbline.plans.audit import audit_table

_NEGATIVE = "('NO', 'FALSE', '0', '0.0', 'N', 'NEGATIVE')"


def binarize_target(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"
    )
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        scoring.binarize_target(lines, "l_quantity").alias("by_number"),
        scoring.binarize_target(lines, "l_returnflag").alias("by_text"),
    )


BINARIZE_SQL = f"""SELECT l_orderkey, l_linenumber,
  CASE WHEN l_quantity <= (SELECT median(l_quantity) FROM lineitem) THEN 1 ELSE 0 END AS by_number,
  CASE WHEN upper(trim(l_returnflag)) IN {_NEGATIVE} THEN 0 ELSE 1 END AS by_text
FROM lineitem"""


def class_distribution(spark: SparkSession, folder: str) -> DataFrame:
    cases = CASES.frame(spark, folder)
    return scoring.class_distribution(
        cases.select(scoring.binarize_target(cases, "outcome").alias("y")), "y"
    )


CLASSES_SQL = f"""SELECT CASE WHEN upper(trim(outcome)) IN {_NEGATIVE} THEN 0 ELSE 1 END AS label,
  count(*) AS n FROM ({CASES.sql}) GROUP BY 1"""


def impute_most_frequent(spark: SparkSession, folder: str) -> DataFrame:
    vitals = drop_empty_columns(VITALS.frame(spark, folder), VITALS_COLUMNS)
    names = [c for c in vitals.columns if c != "row_key"]
    return scoring.impute_most_frequent(vitals, names)


IMPUTE_SQL = f"WITH v AS ({VITALS.sql}) SELECT row_key, " + ", ".join(
    f"coalesce({c}, (SELECT {c} FROM v WHERE {c} IS NOT NULL GROUP BY {c} "
    f"ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}"
    for c in VITALS_COLUMNS if c != "bmi"
) + " FROM v"


def label_encode(spark: SparkSession, folder: str) -> DataFrame:
    cases = CASES.frame(spark, folder).select("row_key", "gender", "race", "urgency")
    return scoring.label_encode(cases, ["gender", "race", "urgency"])


ENCODE_SQL = "SELECT row_key, " + ", ".join(
    f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}" for c in ("gender", "race", "urgency")
) + f" FROM ({CASES.sql})"


def label_codes(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.label_codes(table(spark, folder, "documents"), ["text", "lang", "source"])


CODES_SQL = " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS \"column\", {c} AS value, "
    f"dense_rank() OVER (ORDER BY {c}) - 1 AS code FROM documents"
    for c in ("text", "lang", "source")
)


def train_test_split(spark: SparkSession, folder: str) -> DataFrame:
    cases = CASES.frame(spark, folder)
    return cases.select("row_key", scoring.in_test_part("row_key").alias("is_test"))


SPLIT_SQL = f"""SELECT row_key,
  substr(md5(CAST(row_key AS VARCHAR) || ':42'), 1, 8) < '{int(0.3 * 2**32):08x}' AS is_test
FROM ({CASES.sql})"""


def proxy_model(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score_proxy(CASES.frame(spark, folder), "outcome", "row_key").data


def audit_end_to_end(spark: SparkSession, folder: str) -> DataFrame:
    report = audit_table(CASES.frame(spark, folder), "outcome", "row_key")
    return report.attribute_metrics.withColumn("value", F.round("value", 6))


def proxy_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The part of the proxy model that no tree decides: which rows are tested, and their labels."""
    return proxy_model(spark, folder).select("row_key", "y_true")


PROXY_LABELS_SQL = f"""SELECT row_key,
  CASE WHEN upper(trim(outcome)) IN {_NEGATIVE} THEN 0 ELSE 1 END AS y_true
FROM ({CASES.sql}) WHERE substr(md5(CAST(row_key AS VARCHAR) || ':42'), 1, 8) < '{int(0.3 * 2**32):08x}'"""


def audit_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and positive labels that an end-to-end audit counts."""
    info = audit_table(CASES.frame(spark, folder), "outcome", "row_key").dataset_info
    row = (info["total_samples"], info["positive_count"], info["negative_count"])
    return spark.createDataFrame([row], "total_samples long, positive_count long, negative_count long")


AUDIT_TOTALS_SQL = f"""SELECT count(*) AS total_samples, CAST(sum(y_true) AS BIGINT) AS positive_count,
  CAST(sum(1 - y_true) AS BIGINT) AS negative_count FROM ({PROXY_LABELS_SQL})"""


QUERIES = {
    "proxy_labels": (proxy_labels, PROXY_LABELS_SQL),
    "audit_totals": (audit_totals, AUDIT_TOTALS_SQL),
    "binarize_target": (binarize_target, BINARIZE_SQL),
    "class_distribution": (class_distribution, CLASSES_SQL),
    "impute_most_frequent": (impute_most_frequent, IMPUTE_SQL),
    "label_encode": (label_encode, ENCODE_SQL),
    "label_codes": (label_codes, CODES_SQL),
    "train_test_split": (train_test_split, SPLIT_SQL),
    "proxy_model": (proxy_model, None),
    "audit_end_to_end": (audit_end_to_end, None),
}
