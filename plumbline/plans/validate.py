"""Data-quality validation of one table."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from plumbline.config import QualityConfig
from plumbline.functions.columns import (
    RowKey, col, data_columns, groupable_columns, nan_to_null, number_columns, text_columns,
    with_file_position,
)
from plumbline.functions.counts import distinct_counts, full_texts, value_counts
from plumbline.functions.storage import together
from plumbline.operators import anomalies as anomaly
from plumbline.operators import checks, duplicates, evidence, facts, profile
from plumbline.sources.readers import read_table
from plumbline.sources.writers import write_report
from plumbline.texts import ISSUE_TEXT

EXAMPLE = (
    "struct<row_key:string,value:string,z_score:double,iso_score:double,lof_score:double,"
    "flagged_by:array<string>,values:map<string,double>>"
)
ISSUE_SCHEMA = (
    "position int, severity string, issue_type string, column string, affected_rows bigint, "
    f"fraction double, description string, examples array<{EXAMPLE}>"
)
PROFILE_SCHEMA = (
    "column string, dtype string, null_count bigint, null_fraction double, unique_count bigint, "
    "unique_fraction double, mean double, std double, min_val double, max_val double, "
    "sample_values array<string>, top_categories array<struct<value:string,n:bigint>>"
)


@dataclass(frozen=True)
class ValidationReport:
    """Findings about one table. Every frame is bounded by the number of columns."""

    status: str
    summary: dict[str, Any]
    issues: DataFrame
    profiles: DataFrame
    recommendations: DataFrame
    ml_methods_used: list[str] = field(default_factory=list)
    execution_time_seconds: float = 0.0
    # Row keys of the rows both anomaly methods flag; all of them, for repairs.
    anomalies: DataFrame | None = None

    def write_json(self, path: str, mode: str = "errorifexists") -> None:
        """Write summary, issues, profiles and recommendations as JSON lines."""
        spark = self.issues.sparkSession
        head = {
            "status": self.status,
            **self.summary,
            "ml_methods_used": self.ml_methods_used,
            "execution_time_seconds": self.execution_time_seconds,
        }
        tables = {
            "summary": spark.createDataFrame([Row(**head)], _summary_schema()),
            "issues": self.issues,
            "column_profiles": self.profiles,
            "recommendations": self.recommendations,
        }
        write_report(tables, path, mode=mode)


def _summary_schema() -> str:
    return (
        "status string, total_rows bigint, total_columns int, numeric_columns int, "
        "categorical_columns int, total_missing_values bigint, completeness double, "
        "overall_completeness string, duplicate_rows bigint, critical_issues int, warnings int, "
        "info int, ml_methods_used array<string>, execution_time_seconds double"
    )


def _issue(
    severity: str, kind: str, affected: int, total: int = 0, column: str | None = None,
    limit: Any = None, names: Sequence[str] = (), examples: Sequence[dict] = (),
) -> dict:
    text = ISSUE_TEXT[kind].format(
        column=column, n=affected, limit=limit, names=list(names),
        percent=f"{affected / total:.1%}" if total else "",
    )
    return {
        "severity": severity, "issue_type": kind, "column": column, "affected_rows": affected,
        "fraction": affected / total if total else None, "description": text,
        "examples": list(examples),
    }


def _example(**cells) -> Row:
    fields = (
        "row_key", "value", "z_score", "iso_score", "lof_score", "flagged_by", "values",
    )
    return Row(*fields)(*[cells.get(f) for f in fields])


def _shape_issues(names: Sequence[str], rows: int, config: QualityConfig) -> list:
    """Issues visible from row count and column names alone."""
    found = []
    repeated = checks.repeated_names(names)
    if repeated:
        shown = [_example(value=c) for c in repeated]
        found.append(
            _issue("critical", "DUPLICATE_COLUMNS", rows, rows, names=repeated, examples=shown)
        )
    unnamed = checks.unnamed_columns(names)
    if unnamed:
        shown = [_example(value=c) for c in unnamed]
        issue = _issue("warning", "UNNAMED_COLUMNS", len(unnamed), examples=shown)
        found.append({**issue, "affected_rows": rows})
    if rows < config.min_rows:
        found.append(_issue("warning", "INSUFFICIENT_ROWS", rows, rows, limit=config.min_rows))
    return found


def _repeats(
    df: DataFrame, columns: Sequence[str], row_key: RowKey, config: QualityConfig,
    value: Column | None = None,
) -> tuple[int, list]:
    """Number of repeating rows and the first of them."""
    repeats = duplicates.repeat_count(df, columns).first()["affected_rows"]
    if not repeats:
        return 0, []
    top = duplicates.first_repeats(df, columns, row_key, config.max_examples, value, repeats).collect()
    return repeats, [_example(row_key=r["row_key"], value=r["value"]) for r in top]


def _duplicate_rows(
    df: DataFrame, names: Sequence[str], row_key: RowKey, config: QualityConfig
) -> tuple[int, list]:
    compared = groupable_columns(df, names)
    return _repeats(df, compared, row_key, config) if compared else (0, [])


def _duplicate_ids(
    df: DataFrame, row_key: RowKey, config: QualityConfig
) -> tuple[str | None, int, list]:
    """Repeats of the first identifier column present, the row key itself included."""
    identifier = next((c for c in config.id_columns if c in df.columns), None)
    if identifier is None:
        return None, 0, []
    return identifier, *_repeats(df, [identifier], row_key, config, col(identifier))


def _anomaly_issues(
    df: DataFrame, row_key: RowKey, rows: int, config: QualityConfig
) -> tuple[list, list[str], DataFrame | None]:
    if not config.run_anomaly_checks:
        return [], [], None
    numbers = number_columns(df, data_columns(df, row_key))
    decision = anomaly.gate(rows, len(numbers), config)
    if decision == "small":
        return [], [], None
    found, methods = [], list(anomaly.METHODS)
    if decision == "large":
        # The caller's limit holds back the neighbour search; Isolation Forest runs at any size.
        skipped = _issue(
            "info", "ML_ANOMALY_DETECTION_SKIPPED", rows * len(numbers),
            limit=config.max_data_points_for_ml,
        )
        found, methods = [{**skipped, "affected_rows": 0}], methods[:1]
    scored = anomaly.anomaly_scores(df, row_key, config, lof=decision == "run")
    shown_columns = [c for c in numbers if c in scored.columns]
    both = anomaly.consensus(scored)
    one = scored.filter(F.col("iso_flag") != F.col("lof_flag"))
    tally = scored.agg(
        F.count_if(F.col("iso_flag") & F.col("lof_flag")).alias("both"),
        F.count_if(F.col("iso_flag") != F.col("lof_flag")).alias("one"),
    ).first()

    def examples(found: DataFrame, limit: int, scores: bool) -> list:
        top = anomaly.anomaly_examples(found, row_key, shown_columns, limit)
        return [
            _example(
                row_key=r["row_key"], values=r["values"],
                **(
                    {"iso_score": r["iso_score"], "lof_score": r["lof_score"]}
                    if scores else {"flagged_by": r["flagged_by"]}
                ),
            )
            for r in top.collect()
        ]

    if tally["both"]:
        shown = examples(both, config.max_examples, True)
        found.append(
            _issue("warning", "MULTIVARIATE_ANOMALY", tally["both"], rows, examples=shown)
        )
    most = config.potential_anomaly_max_rows
    if tally["one"] and (most is None or tally["one"] <= most):
        shown = examples(one, config.potential_anomaly_examples, False)
        found.append(_issue("info", "POTENTIAL_ANOMALY", tally["one"], rows, examples=shown))
    return found, methods, both


# Order of the checks that follow completeness.
_STAGE = {
    "TYPE_INCONSISTENCY": 1, "VALUE_BELOW_RANGE": 2, "VALUE_ABOVE_RANGE": 2,
    "STATISTICAL_OUTLIER": 3,
}


def _limit_text(kind: str, column: str, config: QualityConfig) -> Any:
    if kind == "VALUE_BELOW_RANGE":
        return f"{config.ranges[column][0]:g}"
    if kind == "VALUE_ABOVE_RANGE":
        return f"{config.ranges[column][1]:g}"
    return config.outlier_zscore_threshold


def _as_row(position: int, issue: dict) -> tuple:
    return (
        position, issue["severity"], issue["issue_type"], issue["column"],
        issue["affected_rows"], issue["fraction"], issue["description"], issue["examples"],
    )


def _summary(
    df: DataFrame, names: Sequence[str], rows: int, missing: int, repeats: int, issues: Sequence
) -> dict[str, Any]:
    cells = rows * len(names)
    completeness = 1 - missing / cells if cells else None
    kinds = [i["severity"] for i in issues]
    return {
        "total_rows": rows,
        "total_columns": len(names),
        "numeric_columns": len(number_columns(df, names)) if len(set(names)) == len(names) else 0,
        "categorical_columns": len(text_columns(df, names)) if len(set(names)) == len(names) else 0,
        "total_missing_values": missing,
        "completeness": completeness,
        "overall_completeness": f"{completeness:.1%}" if cells else None,
        "duplicate_rows": repeats,
        "critical_issues": kinds.count("critical"),
        "warnings": kinds.count("warning"),
        "info": kinds.count("info"),
    }


def _text_values(
    df: DataFrame, names: Sequence[str], config: QualityConfig
) -> tuple[dict[str, Row], dict[str, list]]:
    """Distinct and unparsable counts, and the most frequent values, of text columns.

    Both come from the same value counts, which the plan shuffles once.
    """
    if not names:
        return {}, {}
    seen = value_counts(df, names, "string")
    facts_part = facts.text_facts(seen).select(
        "column", F.lit(0).alias("rank"), F.lit(None).cast("string").alias("value"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("bigint").alias("n"), "unique_count", "unparsable",
    )
    top_part = profile.most_frequent(seen, config.top_categories).select(
        "*", F.lit(None).cast("bigint").alias("unique_count"),
        F.lit(None).cast("bigint").alias("unparsable"),
    )
    counted: dict[str, Row] = {}
    tops: dict[str, list] = {}
    rows = sorted(facts_part.unionByName(top_part).collect(), key=lambda r: r["rank"])
    whole = full_texts(df, rows)
    for r in rows:
        if r["rank"] == 0:
            counted[r["column"]] = r
        else:
            text = whole.get((r["column"], r["digest"]), r["value"])
            tops.setdefault(r["column"], []).append((text, r["n"]))
    return counted, tops


def _other_distinct(df: DataFrame, names: Sequence[str], config: QualityConfig) -> dict[str, int]:
    if not names:
        return {}
    found = distinct_counts(df, names, config.approximate_distinct).collect()
    return {r["column"]: r["unique_count"] for r in found}


def _samples(
    df: DataFrame, row_key: RowKey, measured: Sequence[Row], config: QualityConfig
) -> dict[str, list]:
    present = {m["column"]: m["n_rows"] - m["null_count"] for m in measured}
    found: dict[str, list] = {}
    rows = profile.sample_values(df, row_key, present, config).collect()
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(r["column"], []).append(r["value"])
    return found


def _column_issues(
    df: DataFrame, row_key: RowKey, measured: Sequence[Row], known: DataFrame,
    config: QualityConfig,
) -> list[dict]:
    """Issues of single columns in report order, with their first offending rows."""
    rows = measured[0]["n_rows"]
    found = checks.column_issues(known, config).collect()
    wanted = {(i["issue_type"], i["column"]) for i in found}
    row_checks = checks.row_checks(df, measured, config, wanted)
    shown: dict[tuple, list] = {}
    if row_checks:
        evidence_rows = evidence.issue_examples(df, row_key, row_checks, config).collect()
        for r in sorted(evidence_rows, key=lambda r: r["rank"]):
            score = None if r["z_score"] is None else round(r["z_score"], 2)
            shown.setdefault((r["issue_type"], r["column"]), []).append(
                _example(row_key=r["row_key"], value=r["value"], z_score=score)
            )
    place = {m["column"]: m["position"] for m in measured}
    found.sort(
        key=lambda i: (
            _STAGE.get(i["issue_type"], 0),
            place[i["column"]],
            i["issue_type"] != "VALUE_BELOW_RANGE",
        )
    )
    return [
        _issue(
            i["severity"], i["issue_type"], i["affected_rows"], rows, i["column"],
            limit=_limit_text(i["issue_type"], i["column"], config),
            examples=shown.get((i["issue_type"], i["column"]), ()),
        )
        for i in found
    ]


def _measure(
    df: DataFrame, names: Sequence[str], row_key: RowKey, config: QualityConfig
) -> tuple | None:
    """Column facts, then what depends on them; None for a table without rows."""
    measured = sorted(
        facts.column_facts(df, names, config).collect(), key=lambda m: m["position"]
    )
    if not measured:
        return None
    outliers, samples, strange = together(
        df.sparkSession,
        lambda: facts.outlier_counts(df, measured, config).collect(),
        lambda: _samples(df, row_key, measured, config),
        lambda: _anomaly_issues(df, row_key, measured[0]["n_rows"], config),
    )
    return measured, {r["column"]: r["outliers"] for r in outliers}, samples, strange


KNOWN_SCHEMA = (
    "column string, n_rows bigint, null_count bigint, below bigint, above bigint, "
    "unique_count bigint, unparsable bigint, outliers bigint"
)


def validate(
    df: DataFrame, row_key: RowKey, config: QualityConfig | None = None
) -> ValidationReport:
    """Check a table and profile its columns. Of the row key only repeats are checked, where it is
    one of the known identifier columns.

    One pass takes all counts, moments and range violations; outliers, first
    values and the anomaly checks follow from it.
    Distinct values, frequent texts, repeated rows and ids need nothing else
    and run beside it. A last scan collects the evidence of the issues found.
    """
    config = config or QualityConfig()
    spark = df.sparkSession
    started = time.time()
    names = data_columns(df, row_key)
    if not names or len(set(names)) < len(names):
        # Without columns, or with columns that cannot be told apart, only their names count.
        rows = df.count()
        if rows == 0:
            first = _issue("critical", "EMPTY_DATASET", 0)
        elif not names:
            first = _issue("critical", "NO_COLUMNS", rows, rows)
        else:
            first = _shape_issues(names, rows, config)[0]
        return _early_report(df, names, rows, first, started)

    clean = nan_to_null(df)
    texts = text_columns(clean, names)
    others = [c for c in groupable_columns(clean, names) if c not in set(texts)]
    numbers, (texts_known, tops), distinct, repeated, ids = together(
        spark,
        lambda: _measure(clean, names, row_key, config),
        lambda: _text_values(clean, texts, config),
        lambda: _other_distinct(clean, others, config),
        lambda: _duplicate_rows(clean, names, row_key, config),
        lambda: _duplicate_ids(clean, row_key, config),
    )
    if numbers is None:
        return _early_report(df, names, 0, _issue("critical", "EMPTY_DATASET", 0), started)
    measured, unusual, samples, (strange, methods, flagged) = numbers
    rows = measured[0]["n_rows"]
    distinct.update({c: r["unique_count"] for c, r in texts_known.items()})
    known = spark.createDataFrame(
        [
            (
                m["column"], rows, m["null_count"], m["below"], m["above"],
                distinct.get(m["column"], 0),
                texts_known[m["column"]]["unparsable"] if m["column"] in texts_known else 0,
                unusual.get(m["column"], 0),
            )
            for m in measured
        ],
        KNOWN_SCHEMA,
    ).coalesce(1)
    column_issues = _column_issues(clean, row_key, measured, known, config)

    issues = _shape_issues(names, rows, config)
    if repeated[0]:
        issues.append(_issue("warning", "DUPLICATE_ROWS", repeated[0], rows, examples=repeated[1]))
    if ids[1]:
        issues.append(_issue("critical", "DUPLICATE_IDS", ids[1], rows, ids[0], examples=ids[2]))
    issues += column_issues + strange

    kinds = dict(clean.dtypes)
    profiles = [
        (
            m["column"], kinds[m["column"]], m["null_count"], m["null_count"] / rows,
            distinct.get(m["column"], 0), distinct.get(m["column"], 0) / rows,
            m["mean"], m["std"], m["min_val"], m["max_val"], samples.get(m["column"], []),
            tops.get(m["column"], []) if m["column"] in set(texts) else None,
        )
        for m in measured
    ]
    elapsed = time.time() - started
    missing = sum(m["null_count"] for m in measured)
    summary = _summary(clean, names, rows, missing, repeated[0], issues)
    return ValidationReport(
        _status(issues), summary, *_report_frames(spark, issues, profiles),
        methods, elapsed, flagged,
    )


def _status(issues: Sequence[dict]) -> str:
    severities = {i["severity"] for i in issues}
    return "FAIL" if "critical" in severities else "WARNING" if "warning" in severities else "PASS"


def _report_frames(
    spark: SparkSession, issues: Sequence[dict], profiles: Sequence[tuple]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    grave = [i["issue_type"] for i in issues if i["severity"] in ("critical", "warning")]
    return (
        spark.createDataFrame([_as_row(n, i) for n, i in enumerate(issues)], ISSUE_SCHEMA).coalesce(1),
        spark.createDataFrame(profiles, PROFILE_SCHEMA).coalesce(1),
        spark.createDataFrame(checks.advice(grave), "rule int, recommendation string").coalesce(1),
    )


def _early_report(
    df: DataFrame, names: Sequence[str], rows: int, issue: dict, started: float
) -> ValidationReport:
    summary = _summary(df, names, rows, 0, 0, [issue])
    frames = _report_frames(df.sparkSession, [issue], [])
    return ValidationReport("FAIL", summary, *frames, [], time.time() - started)


def validate_file(
    spark: SparkSession,
    path: str,
    row_key: RowKey | None = None,
    config: QualityConfig | None = None,
    format: str | None = None,
) -> ValidationReport:
    """Validate a CSV or parquet file; without a row key, rows are named by file and position."""
    config = config or QualityConfig()
    df = read_table(spark, path, format, config.missing_indicators)
    if row_key is None:
        df, row_key = _positioned(df)
    return validate(df, row_key, config)


def _positioned(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """File and row position where the format has one (parquet), else a running number.

    A CSV scan has no row index. The running number follows file and row order
    and is the same in every scan of unchanged files.
    """
    try:
        keyed, key = with_file_position(df)
        keyed.schema  # the metadata column is resolved here
        return keyed, key
    except Exception:  # noqa: BLE001 - AnalysisException differs between session kinds
        return df.withColumn("__row", F.monotonically_increasing_id()), ["__row"]
