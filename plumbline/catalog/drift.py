"""Queries over the stream of events: counts by window, and what changes between windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.views import View, table
from plumbline.functions.storage import pin, shared_folder
from plumbline.operators import drift
from plumbline.streaming import windows

# Events as decisions, one in seven without a value.
CELLS = (
    "ts", "event_type", "CAST(user_id % 7 AS STRING) AS region",
    "CASE WHEN event_id % 7 = 3 THEN NULL ELSE value END AS value",
    "CASE WHEN value > 30 THEN 1 ELSE 0 END AS y_true",
    "CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) >= CASE WHEN event_type = 'view' "
    "AND extract(DAY FROM ts) > 15 THEN 40 ELSE 50 END THEN 1 ELSE 0 END AS y_pred",
)
EVENTS = View("events", CELLS)
PLAN = windows.WindowPlan("ts", "y_true", "y_pred", ("event_type", "region"), ("value",))


def stream_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every day and group, from a stream over the event files."""
    like = table(spark, folder, "events")
    events = windows.stream_of(spark, f"{folder}/events.parquet*", like).selectExpr(*CELLS)
    work = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    windows.run_windows(events, PLAN, work)
    return windows.windows_so_far(spark, PLAN, work)


_COUNTS = """c AS (SELECT date_trunc('day', ts) AS window_start, attribute, grp, count(*) AS n,
  count(*) FILTER (y_pred = 1) AS predicted, count(*) FILTER (y_pred = 1 AND y_true = 1) AS hits,
  count(*) FILTER (y_pred = 1 AND y_true = 0) AS false_alarms, count(*) FILTER (y_true = 1) AS positives,
  count(*) FILTER (value IS NULL) AS missing_value
  FROM (SELECT *, 'event_type' AS attribute, event_type AS grp FROM e
    UNION ALL SELECT *, 'region', region FROM e) GROUP BY 1, 2, 3)"""
_WITH = f"WITH e AS ({EVENTS.sql}), {_COUNTS}"
STREAM_SQL = f"{_WITH} SELECT CAST(window_start AS TIMESTAMP) AS window_start, * EXCLUDE (window_start) FROM c"


def stream_rates(spark: SparkSession, folder: str) -> DataFrame:
    return windows.rates(stream_counts(spark, folder), PLAN.columns)


RATES_SQL = f"""{_WITH} SELECT CAST(window_start AS TIMESTAMP) AS window_start, attribute, grp, n,
  predicted / n AS selection_rate, coalesce(hits / nullif(positives, 0), 0) AS tpr,
  coalesce(false_alarms / nullif(n - positives, 0), 0) AS fpr, missing_value / n AS missing_value_rate FROM c"""


def drift_stability(spark: SparkSession, folder: str) -> DataFrame:
    shifts = drift.stability(pin(stream_counts(spark, folder)), "1 DAY")
    return shifts.withColumn("population_stability", F.round("population_stability", 9))


_PAIRS = f"""{_WITH},
b AS (SELECT attribute, grp, CAST(window_start AS TIMESTAMP) AS window_start, n, predicted FROM c),
p AS (SELECT coalesce(y.attribute, x.attribute) AS attribute, coalesce(y.grp, x.grp) AS grp,
    coalesce(y.window_start, x.window_start + INTERVAL 1 DAY) AS window_start, coalesce(x.n, 0) AS n0,
    coalesce(y.n, 0) AS n1, coalesce(x.predicted, 0) AS x0, coalesce(y.predicted, 0) AS x1
  FROM b AS x FULL JOIN b AS y ON x.attribute = y.attribute AND x.grp = y.grp
    AND x.window_start + INTERVAL 1 DAY = y.window_start)"""
STABILITY_SQL = f"""{_PAIRS},
s AS (SELECT *, sum(n0) OVER w AS all0, sum(n1) OVER w AS all1, count(*) OVER w AS n_groups FROM p
  WINDOW w AS (PARTITION BY attribute, window_start)),
r AS (SELECT *, (n0 + {drift.PRIOR}) / (all0 + {drift.PRIOR} * n_groups) AS p0,
  (n1 + {drift.PRIOR}) / (all1 + {drift.PRIOR} * n_groups) AS p1 FROM s WHERE all0 > 0 AND all1 > 0)
SELECT attribute, window_start, n_groups, round(sum((p1 - p0) * ln(p1 / p0)), 9) AS population_stability
FROM r GROUP BY ALL"""


def drift_rates(spark: SparkSession, folder: str) -> DataFrame:
    return drift.rate_shifts(stream_counts(spark, folder), "1 DAY")


DRIFT_RATES_SQL = f"""{_PAIRS}
SELECT attribute, grp, window_start, x0 / n0 AS rate_before, x1 / n1 AS rate,
  (x1 / n1 - x0 / n0) / nullif(sqrt((x0 + x1) / (n0 + n1) * (1 - (x0 + x1) / (n0 + n1)) * (1 / n0 + 1 / n1)), 0) AS z
FROM p WHERE n0 > 0 AND n1 > 0"""


def drift_changes(spark: SparkSession, folder: str) -> DataFrame:
    counts = pin(stream_counts(spark, folder))
    return drift.change_points(counts).withColumn("peak", F.round("peak", 6))


CHANGES_SQL = f"""{_WITH},
b AS (SELECT attribute, grp, CAST(window_start AS TIMESTAMP) AS window_start, n, predicted,
  sum(predicted) OVER g / sum(n) OVER g AS level FROM c WINDOW g AS (PARTITION BY attribute, grp)),
d AS (SELECT *, (predicted / n - level) / sqrt(level * (1 - level) / n) AS distance FROM b
  WHERE level > 0 AND level < 1),
s AS (SELECT attribute, grp, window_start, 'up' AS direction, distance - {drift.SLACK} AS surplus FROM d
  UNION ALL SELECT attribute, grp, window_start, 'down', -distance - {drift.SLACK} FROM d),
t AS (SELECT *, sum(surplus) OVER w AS total FROM s
  WINDOW w AS (PARTITION BY attribute, grp, direction ORDER BY window_start)),
l AS (SELECT *, total - least(min(total) OVER w, 0) AS level_sum FROM t
  WINDOW w AS (PARTITION BY attribute, grp, direction ORDER BY window_start)),
r AS (SELECT *, max(CASE WHEN level_sum = 0 THEN window_start END) OVER w AS restart FROM l
  WINDOW w AS (PARTITION BY attribute, grp, direction ORDER BY window_start)),
m AS (SELECT *, min(CASE WHEN level_sum > 0 THEN window_start END)
  OVER (PARTITION BY attribute, grp, direction, restart) AS began FROM r)
SELECT attribute, grp, direction, min(window_start) FILTER (level_sum > {drift.ALARM}) AS alarm_at,
  arg_min(began, window_start) FILTER (level_sum > {drift.ALARM}) AS began_at, round(max(level_sum), 6) AS peak
FROM m GROUP BY ALL HAVING max(level_sum) > {drift.ALARM}"""

QUERIES = {
    "stream_counts": (stream_counts, STREAM_SQL),
    "stream_rates": (stream_rates, RATES_SQL),
    "drift_stability": (drift_stability, STABILITY_SQL),
    "drift_rates": (drift_rates, DRIFT_RATES_SQL),
    "drift_changes": (drift_changes, CHANGES_SQL),
}
