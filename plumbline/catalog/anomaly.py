"""Multivariate-anomaly queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.views import PARTS, VITALS, VITALS_NUMBERS, table
from plumbline.config import QualityConfig
from plumbline.functions.storage import pin, shared_folder, spread
from plumbline.operators import anomalies, explain, histogram
from plumbline.operators.isolation import fit_forest, forest_scores, isolation_scores
from plumbline.operators.repair import Fix, apply_fixes
from plumbline.plans.validate import validate
from plumbline.sources.writers import write_table

CONFIG = QualityConfig()


def median_impute(spark: SparkSession, folder: str) -> DataFrame:
    vitals = VITALS.frame(spark, folder)
    filled, _, _ = anomalies.anomaly_input(vitals, "row_key")
    return filled


_FILLED = [c for c in VITALS_NUMBERS if c != "bmi"]
MEDIAN_SQL = f"WITH v AS ({VITALS.sql}) SELECT row_key, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM v)) AS {c}" for c in _FILLED
) + " FROM v"


def isolation_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and flags of the whole event stream; this method needs no size limit."""
    numbers = ["user_id", "value"]
    events = table(spark, folder, "events").select("event_id", *numbers)
    rows, sizes = anomalies.present_counts(events, numbers)
    filled, names = anomalies.fill_for_anomalies(events, "event_id", numbers, sizes)
    scored = pin(isolation_scores(spread(filled, rows), names, "event_id", rows, CONFIG))
    return anomalies.flag_lowest(scored, ["iso_score"], rows, CONFIG.anomaly_contamination)


def lof(spark: SparkSession, folder: str) -> DataFrame:
    filled, names, rows = anomalies.anomaly_input(PARTS.frame(spark, folder), "row_key")
    scored = anomalies.lof_scores(filled, names, rows, CONFIG)
    flagged = anomalies.flag_lowest(scored, ["lof_score"], rows, CONFIG.anomaly_contamination)
    return flagged.select("row_key", F.round("lof_score", 6).alias("lof_score"), "lof_flag")


# All pairs, ties by the coordinates of the neighbour.
LOF_SQL = f"""WITH p AS ({PARTS.sql}),
pairs AS (SELECT a.row_key AS a, b.row_key AS b,
    (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2) AS d2, b.x1, b.x2
  FROM p a, p b WHERE a.row_key <> b.row_key),
near AS (SELECT a, b, sqrt(d2) AS d FROM pairs
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY d2, x1, x2, b) <= 20),
kd AS (SELECT a, max(d) AS kdist FROM near GROUP BY a),
lrd AS (SELECT n.a, 1 / (avg(greatest(kd.kdist, n.d)) + 1e-10) AS lrd
  FROM near n JOIN kd ON kd.a = n.b GROUP BY n.a),
scored AS (SELECT n.a AS row_key, -avg(o.lrd) / any_value(own.lrd) AS lof
  FROM near n JOIN lrd o ON o.a = n.b JOIN lrd own ON own.a = n.a GROUP BY n.a)
SELECT row_key, round(lof, 6) AS lof_score,
  lof < (SELECT quantile_cont(lof, 0.1) FROM scored) AS lof_flag FROM scored"""


def lof_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Outlier factors over all numeric columns of the largest table, neighbours from a forest."""
    lines = table(spark, folder, "lineitem").withColumn("row_key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    config = QualityConfig(anomaly_neighbour_search="forest")
    filled, names, rows = anomalies.anomaly_input(lines, "row_key")
    scored = pin(anomalies.lof_scores(spread(filled, rows), names, rows, config))
    flagged = anomalies.flag_lowest(scored, ["lof_score"], rows, config.anomaly_contamination)
    return flagged.select("row_key", "lof_score", "lof_flag")


def _scored_parts(spark: SparkSession, folder: str) -> DataFrame:
    return anomalies.anomaly_scores(PARTS.frame(spark, folder), "row_key", CONFIG)


def anomaly_consensus(spark: SparkSession, folder: str) -> DataFrame:
    return anomalies.consensus(_scored_parts(spark, folder))


def anomaly_single(spark: SparkSession, folder: str) -> DataFrame:
    return anomalies.single_flags(_scored_parts(spark, folder), CONFIG)


def validate_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Full validation with both anomaly methods."""
    report = validate(table(spark, folder, "part"), "p_partkey", CONFIG)
    return report.issues.select("severity", "issue_type", "column", "affected_rows", "fraction")


def export_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    parts = PARTS.frame(spark, folder)
    path = f"{shared_folder(spark)}/anomalies-{uuid.uuid4().hex}"
    plan = [Fix("MULTIVARIATE_ANOMALY", None, "export_anomalies")]
    apply_fixes(
        parts, plan, "row_key", CONFIG, anomalies.consensus(_scored_parts(spark, folder)),
        export=lambda rows: write_table(rows, path),
    )
    return spark.read.csv(path, header=True, schema=parts.schema)


def forest_flags(spark: SparkSession, folder: str) -> DataFrame:
    """How many events the forest flags: a tenth, whatever trees it has drawn."""
    flagged = isolation_forest(spark, folder).filter("iso_flag")
    return flagged.agg(F.count(F.lit(1)).alias("flagged"), F.count_distinct("event_id").alias("events"))


# Those strictly below the interpolated percentile, if scores at the cut do not tie.
FOREST_FLAGS_SQL = """SELECT CAST(ceil((count(*) - 1) * 0.1) AS BIGINT) AS flagged,
  CAST(ceil((count(*) - 1) * 0.1) AS BIGINT) AS events FROM events"""


def export_outlying(spark: SparkSession, folder: str) -> DataFrame:
    """Export of the rows that LOF alone flags."""
    parts = PARTS.frame(spark, folder)
    path = f"{shared_folder(spark)}/anomalies-{uuid.uuid4().hex}"
    plan = [Fix("MULTIVARIATE_ANOMALY", None, "export_anomalies")]
    apply_fixes(
        parts, plan, "row_key", CONFIG, lof(spark, folder).filter("lof_flag"),
        export=lambda rows: write_table(rows, path),
    )
    return spark.read.csv(path, header=True, schema=parts.schema)


EXPORT_OUTLYING_SQL = f"""WITH f AS ({LOF_SQL}), p AS ({PARTS.sql})
SELECT p.* FROM p JOIN f ON f.row_key = p.row_key WHERE f.lof_flag"""


# --- without neighbours, and why --------------------------------------------------

_LINE_NUMBERS = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
_LINE_KEY = ("l_orderkey", "l_linenumber")


def histogram_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Outlier score of every line from one histogram a column."""
    lines = table(spark, folder, "lineitem").select(*_LINE_KEY, *_LINE_NUMBERS)
    scored = histogram.histogram_scores(lines, _LINE_NUMBERS)
    return scored.select(*_LINE_KEY, F.round("histogram_score", 6).alias("histogram_score"))


def _histogram_sql() -> str:
    shares = [i / histogram.BINS for i in range(histogram.BINS + 1)]
    parts, joins, terms = [], [], []
    for i, c in enumerate(_LINE_NUMBERS):
        number = f"len(list_filter(e{i}.e[2 : len(e{i}.e) - 1], lambda x: x <= {c}))"
        parts.append(
            f"e{i} AS (SELECT list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), {shares}))) AS e FROM lineitem), "
            f"b{i} AS (SELECT {number} AS bin, count(*) AS n FROM lineitem, e{i} GROUP BY 1), "
            f"d{i} AS (SELECT bin, n / CASE WHEN len(e) > 1 THEN e[bin + 2] - e[bin + 1] ELSE 1 END AS d FROM b{i}, e{i}), "
            f"s{i} AS (SELECT bin, -ln(d / (SELECT max(d) FROM d{i})) AS s FROM d{i})"
        )
        joins.append(f"CROSS JOIN e{i} JOIN s{i} ON s{i}.bin = {number}")
        terms.append(f"s{i}.s")
    return (
        f"WITH {', '.join(parts)} SELECT {', '.join(_LINE_KEY)}, round({' + '.join(terms)}, 6) AS histogram_score "
        f"FROM lineitem {' '.join(joins)}"
    )


def flag_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with a value beyond 1.7 standard deviations, and their three most unusual columns."""
    lines = table(spark, folder, "lineitem").select(*_LINE_KEY, *_LINE_NUMBERS)
    found = explain.deviations(lines, _LINE_KEY, _LINE_NUMBERS, 1.7)
    each = found.select(*_LINE_KEY, F.posexplode("reasons").alias("rank", "reason"))
    return each.select(
        *_LINE_KEY, (F.col("rank") + 1).alias("rank"), "reason.column", F.round("reason.value", 6).alias("deviations")
    )


_DISTANCES = ", ".join(f"{{'o': -abs({c} - m_{c}) / s_{c}, 'c': '{c}'}}" for c in _LINE_NUMBERS)
REASONS_SQL = f"""WITH m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in _LINE_NUMBERS)}
  FROM lineitem),
z AS (SELECT {', '.join(_LINE_KEY)}, list_sort([{_DISTANCES}]) AS z FROM lineitem, m),
r AS (SELECT *, unnest([1, 2, 3]) AS rank FROM z WHERE -z[1].o > 1.7)
SELECT {', '.join(_LINE_KEY)}, rank, z[rank].c AS "column", round(-z[rank].o, 6) AS deviations FROM r"""


def forest_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Events the forest flags, with the columns that isolate them."""
    numbers = ["user_id", "value"]
    events = table(spark, folder, "events").select("event_id", *numbers)
    rows, sizes = anomalies.present_counts(events, numbers)
    filled, names = anomalies.fill_for_anomalies(events, "event_id", numbers, sizes)
    filled = pin(spread(filled, rows))
    forest = fit_forest(filled, names, "event_id", rows, CONFIG)
    scored = pin(forest_scores(filled, names, forest))
    flagged = anomalies.flag_lowest(scored, ["iso_score"], rows, CONFIG.anomaly_contamination).filter("iso_flag")
    return explain.forest_reasons(flagged, names, forest).select("event_id", "iso_score", "reasons")


QUERIES = {
    "histogram_scores": (histogram_scores, _histogram_sql()),
    "flag_reasons": (flag_reasons, REASONS_SQL),
    "forest_reasons": (forest_reasons, None),
    "forest_flags": (forest_flags, FOREST_FLAGS_SQL),
    "export_outlying": (export_outlying, EXPORT_OUTLYING_SQL),
    "median_impute": (median_impute, MEDIAN_SQL),
    "isolation_forest": (isolation_forest, None),
    "lof": (lof, LOF_SQL),
    "lof_wide": (lof_wide, None),
    "anomaly_consensus": (anomaly_consensus, None),
    "validate_parts": (validate_parts, None),
    "anomaly_single": (anomaly_single, None),
    "export_anomalies": (export_anomalies, None),
}
