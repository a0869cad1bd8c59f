"""SQL text of the quality issues of a relation, for comparison."""

from __future__ import annotations

from collections.abc import Sequence

from plumbline.config import CLINICAL_RANGES
from plumbline.catalog.views import NUMBER_SQL

COMPLETENESS = """
SELECT "column", n_rows, null_count AS affected_rows,
  CASE WHEN null_count = n_rows THEN 'EMPTY_COLUMN'
       WHEN null_count * 1.0 / n_rows >= 0.5 THEN 'HIGH_NULL_RATE'
       WHEN null_count * 1.0 / n_rows >= 0.1 THEN 'MODERATE_NULL_RATE'
       WHEN null_count > 0 THEN 'LOW_NULL_RATE' END AS issue_type
FROM facts"""


def facts_sql(source: str, numbers: Sequence[str], texts: Sequence[str]) -> str:
    """CTE bodies ``facts`` (one row per column) and ``scored`` (one row per numeric cell)."""
    rows = []
    for c in numbers:
        low, high = CLINICAL_RANGES.get(c, (None, None))
        low, high = ("NULL" if x is None else str(x) for x in (low, high))
        rows.append(
            f"SELECT '{c}', CAST({c} AS DOUBLE), {c} IS NULL, FALSE, CAST(NULL AS VARCHAR), "
            f"CAST({low} AS DOUBLE), CAST({high} AS DOUBLE) FROM {source}"
        )
    for c in texts:
        rows.append(
            f"SELECT '{c}', CAST(NULL AS DOUBLE), {c} IS NULL, "
            f"{c} IS NOT NULL AND NOT regexp_matches({c}, {NUMBER_SQL}), "
            f"{c}, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM {source}"
        )
    long = " UNION ALL ".join(rows)
    return f"""long("column", value, missing, unparsable, txt, low, high) AS ({long}),
facts AS (SELECT "column", count(*) AS n_rows, count_if(missing) AS null_count,
  avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min_val, max(value) AS max_val,
  count_if(value < low) AS below, count_if(value > high) AS above,
  count_if(unparsable) AS unparsable, count(DISTINCT txt) AS texts
  FROM long GROUP BY "column"),
outliers AS (SELECT l."column", any_value(f.n_rows) AS n_rows, count(*) AS affected_rows
  FROM long l JOIN facts f ON l."column" = f."column"
  WHERE f.std > 0 AND f.n_rows - f.null_count >= 10 AND abs((l.value - f.mean) / f.std) > 3.0
  GROUP BY l."column")"""


def issues_sql(
    source: str,
    numbers: Sequence[str],
    texts: Sequence[str],
    identifier: str | None = None,
) -> str:
    """CTE bodies up to ``issues``: (severity, issue_type, column, affected_rows, n_rows)."""
    every = ", ".join([*numbers, *texts])
    duplicates = ""
    if identifier:
        duplicates = f"""
  UNION ALL SELECT '{identifier}', any_value(total), CAST(sum(n - 1) AS BIGINT), 'DUPLICATE_IDS'
    FROM (SELECT count(*) AS n, (SELECT count(*) FROM {source}) AS total
          FROM {source} GROUP BY {identifier}) HAVING sum(n - 1) > 0"""
    return f"""{facts_sql(source, numbers, texts)},
found AS (SELECT * FROM ({COMPLETENESS}) WHERE issue_type IS NOT NULL
  UNION ALL SELECT "column", n_rows, unparsable, 'TYPE_INCONSISTENCY' FROM facts
    WHERE unparsable > 0 AND texts * 1.0 / n_rows >= 0.05
  UNION ALL SELECT "column", n_rows, below, 'VALUE_BELOW_RANGE' FROM facts WHERE below > 0
  UNION ALL SELECT "column", n_rows, above, 'VALUE_ABOVE_RANGE' FROM facts WHERE above > 0
  UNION ALL SELECT "column", n_rows, affected_rows, 'STATISTICAL_OUTLIER' FROM outliers
  UNION ALL SELECT NULL, any_value(total), CAST(sum(n - 1) AS BIGINT), 'DUPLICATE_ROWS'
    FROM (SELECT count(*) AS n, (SELECT count(*) FROM {source}) AS total
          FROM {source} GROUP BY {every}) HAVING sum(n - 1) > 0{duplicates}),
issues AS (SELECT CASE
    WHEN issue_type IN ('EMPTY_COLUMN', 'HIGH_NULL_RATE', 'VALUE_BELOW_RANGE',
                        'VALUE_ABOVE_RANGE', 'DUPLICATE_IDS') THEN 'critical'
    WHEN issue_type = 'LOW_NULL_RATE' THEN 'info' ELSE 'warning' END AS severity,
  issue_type, "column", CAST(affected_rows AS BIGINT) AS affected_rows, n_rows FROM found)"""
