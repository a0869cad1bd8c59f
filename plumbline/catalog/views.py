"""Inputs of the queries: projections of the given tables, the same text in Spark and ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@dataclass(frozen=True)
class View:
    """A projection of one table."""

    source: str
    cells: Sequence[str]

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, self.source).selectExpr(*self.cells)

    @property
    def sql(self) -> str:
        return f"SELECT {', '.join(self.cells)} FROM {self.source}"


# Measurements with every kind of defect the checks look for.
VITALS = View(
    "customer",
    (
        "c_custkey AS row_key",
        "CASE WHEN c_custkey % 50 = 49 THEN c_custkey - 1 ELSE c_custkey END AS patient_id",
        "CAST(floor(c_acctbal / 75.0) AS BIGINT) AS age",
        "CASE WHEN c_custkey % 97 = 0 THEN 'high' WHEN c_custkey % 89 = 0 THEN '1d' "
        "ELSE CAST(20 + c_custkey AS STRING) END AS heart_rate",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 60 + c_custkey % 200 END "
        "AS blood_pressure_systolic",
        "CASE WHEN c_custkey % 10 < 6 THEN NULL ELSE c_acctbal END AS weight_kg",
        "CAST(NULL AS DOUBLE) AS bmi",
        "CASE WHEN c_custkey % 40 = 0 THEN NULL ELSE c_mktsegment END AS segment",
    ),
)
VITALS_NUMBERS = ("patient_id", "age", "blood_pressure_systolic", "weight_kg", "bmi")
VITALS_TEXTS = ("heart_rate", "segment")
VITALS_COLUMNS = (
    "patient_id", "age", "heart_rate", "blood_pressure_systolic", "weight_kg", "bmi", "segment",
)

# A heavy-tailed stream of values read as heart rates.
READINGS = View(
    "events", ("event_id AS row_key", "value AS heart_rate", "event_type", "props AS note")
)

# Labels and predictions with small, invalid and out-of-range groups.
DECISIONS = View(
    "orders",
    (
        "o_orderkey AS row_key",
        "CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS y_true",
        "CASE WHEN o_totalprice > 150000 + CASE WHEN o_custkey % 2 = 0 THEN 60000 ELSE 0 END "
        "THEN 1 ELSE 0 END AS y_pred",
        "CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender",
        "CAST(o_custkey % 110 - 3 AS BIGINT) AS age",
        "CASE WHEN o_orderkey % 1000 = 7 THEN 'Rare' WHEN o_custkey % 11 = 0 THEN '?' "
        "WHEN o_custkey % 11 = 1 THEN 'Unknown' WHEN o_custkey % 11 < 5 THEN 'Asian' "
        "ELSE 'Other' END AS race",
    ),
)

# Decisions with a score, for metrics that counts cannot express.
SCORES = View(
    "orders",
    (
        "CASE WHEN o_totalprice + (o_custkey % 97) * 2000 > 250000 THEN 1 ELSE 0 END AS y_true",
        "o_totalprice / 450000 AS score",
        "CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender",
        "o_orderstatus AS status", "o_orderpriority AS urgency",
        "CASE WHEN o_custkey % 11 < 5 THEN 'Asian' WHEN o_orderkey % 1000 = 7 THEN 'Rare' ELSE 'Other' END AS race",
        "CASE WHEN o_totalprice > 200000 + CASE WHEN o_custkey % 2 = 1 AND o_custkey % 11 < 5 THEN 120000 ELSE 0 END "
        "THEN 1 ELSE 0 END AS y_pred",
    ),
)

# A guess of four languages that is worse for long texts.
LANGUAGES = View(
    "documents",
    (
        "lang AS y_true", "source", "CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END AS size",
        "CASE WHEN doc_id % 10 < CASE WHEN n_chars < 1000 THEN 1 ELSE 3 END THEN 'en' "
        "WHEN doc_id % 17 = 0 THEN 'other' ELSE lang END AS y_pred",
    ),
)

# A table to model: demographic columns, features with gaps and a textual target.
CASES = View(
    "orders",
    (
        "o_orderkey AS row_key",
        "CASE WHEN o_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender",
        "CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE CAST(o_custkey % 90 AS BIGINT) END AS age",
        "CASE WHEN o_custkey % 11 = 1 THEN 'Unknown' WHEN o_custkey % 11 < 5 THEN 'Asian' "
        "ELSE 'Other' END AS race",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS amount",
        "o_orderpriority AS urgency",
        "CAST(NULL AS DOUBLE) AS unused",
        "CASE WHEN o_totalprice > 150000 + (o_custkey % 2) * 40000 + (o_orderkey % 7) * 5000 "
        "THEN 'Yes' ELSE 'No' END AS outcome",
    ),
)

PARTS = View(
    "part", ("p_partkey AS row_key", "CAST(p_size AS DOUBLE) AS x1", "p_retailprice AS x2")
)

# The number pattern of plumbline.functions.values as an SQL literal.
NUMBER_SQL = (
    r"'^\s*[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
    r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$'"
)


def number_sql(text: str) -> str:
    return (
        f"CASE WHEN regexp_matches({text}, {NUMBER_SQL}) THEN TRY_CAST({text} AS DOUBLE) END"
    )
