"""Repair actions as DataFrame transformations, driven by a declarative plan."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import QualityConfig
from plumbline.functions.columns import (
    RowKey, col, data_columns, groupable_columns, key_columns, numeric_columns, text_columns,
)
from plumbline.functions.counts import modes
from plumbline.functions.quantiles import medians
from plumbline.functions.storage import pin
from plumbline.functions.values import clip, parse_number
from plumbline.operators.checks import unnamed_columns
from plumbline.operators.duplicates import keep_first_per_id, keep_one_per_row
from plumbline.operators.facts import moments, z_score

# Category of each issue type in a repair session.
CATEGORIES = {
    "EMPTY_COLUMN": "Empty Columns",
    "HIGH_NULL_RATE": "Missing Values",
    "MODERATE_NULL_RATE": "Missing Values",
    "LOW_NULL_RATE": "Missing Values",
    "TYPE_INCONSISTENCY": "Type Inconsistencies",
    "VALUE_BELOW_RANGE": "Domain Violations",
    "VALUE_ABOVE_RANGE": "Domain Violations",
    "DUPLICATE_ROWS": "Duplicate Data",
    "DUPLICATE_IDS": "Duplicate Data",
    "UNNAMED_COLUMNS": "Duplicate Data",
    "STATISTICAL_OUTLIER": "Outliers & Anomalies",
    "MULTIVARIATE_ANOMALY": "Outliers & Anomalies",
}
OTHER_CATEGORY = "Other"

# Actions allowed per issue type.
_FILLS = ("fill_median", "fill_mean", "fill_mode", "drop_rows")
_RANGE = ("cap_values", "cap_range", "replace_median", "drop_rows")
ALLOWED = {
    "EMPTY_COLUMN": ("drop_column",),
    "HIGH_NULL_RATE": _FILLS,
    "MODERATE_NULL_RATE": _FILLS,
    "TYPE_INCONSISTENCY": (
        "convert_numeric_fill_median", "convert_numeric_drop", "convert_numeric_nan",
    ),
    "VALUE_BELOW_RANGE": _RANGE,
    "VALUE_ABOVE_RANGE": _RANGE,
    "DUPLICATE_ROWS": ("drop_duplicates",),
    "DUPLICATE_IDS": ("drop_duplicate_ids",),
    "UNNAMED_COLUMNS": ("drop_unnamed_columns",),
    "STATISTICAL_OUTLIER": ("cap_outliers", "replace_outliers_median", "drop_rows"),
    "MULTIVARIATE_ANOMALY": ("export_anomalies", "drop_rows"),
}
# Actions that lose rows beyond recovery and must be confirmed in the plan.
CONFIRMED = {("DUPLICATE_IDS", "drop_duplicate_ids"), ("MULTIVARIATE_ANOMALY", "drop_rows")}


@dataclass(frozen=True)
class Fix:
    """One entry of a repair plan."""

    issue_type: str
    column: str | None
    action: str
    parameters: Mapping[str, Any] = field(default_factory=dict)
    description: str = ""


@dataclass(frozen=True)
class Repaired:
    """Repaired data and one log row per fix: (step, action, column, status, message)."""

    data: DataFrame
    log: DataFrame


def issue_categories(issues: DataFrame) -> DataFrame:
    """(category, n_issues) over critical and warning issues."""
    pairs = [F.lit(x) for pair in CATEGORIES.items() for x in pair]
    known = F.element_at(F.create_map(*pairs), F.col("issue_type"))
    return (
        issues.filter(F.col("severity").isin("critical", "warning"))
        .groupBy(F.coalesce(known, F.lit(OTHER_CATEGORY)).alias("category"))
        .agg(F.count(F.lit(1)).alias("n_issues"))
    )


def check_fix(fix: Fix) -> None:
    """Reject actions the issue type does not offer and unconfirmed losses."""
    allowed = ALLOWED.get(fix.issue_type, ())
    if fix.action not in allowed:
        raise ValueError(f"{fix.issue_type} offers {allowed or 'no repair'}, not {fix.action!r}")
    if (fix.issue_type, fix.action) in CONFIRMED and fix.parameters.get("confirm") is not True:
        raise ValueError(f"{fix.action} for {fix.issue_type} deletes data: pass confirm=True")


# --- which rows an issue is about -------------------------------------------


def _flagged(fix: Fix, config: QualityConfig, spread: Mapping) -> Column | None:
    """Predicate of the offending rows on the original values; None if not row-based."""
    name = fix.column
    if fix.issue_type in ("VALUE_BELOW_RANGE", "VALUE_ABOVE_RANGE"):
        low, high = config.ranges[name]
        # NaN is missing; Spark takes it for greater than any number.
        number = F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))
        return number < low if fix.issue_type == "VALUE_BELOW_RANGE" else number > high
    if fix.issue_type == "STATISTICAL_OUTLIER":
        mean, std, present = spread[name]
        if not std or not math.isfinite(std) or present < config.outlier_min_values:
            return F.lit(False)
        distance = F.nanvl(F.abs(z_score(name, mean, std)), F.lit(None).cast("double"))
        return distance > config.outlier_zscore_threshold
    return None


ROW_ACTIONS = {"drop_rows", "replace_median", "replace_outliers_median"}


def _flag_predicates(df: DataFrame, plan: Sequence[Fix], config: QualityConfig) -> dict[int, Column]:
    """Which rows offend, by position of the fix; only fixes of offending rows have an entry."""
    numeric = set(numeric_columns(df, df.columns))
    concerned = [
        (i, f) for i, f in enumerate(plan)
        if f.action in ROW_ACTIONS and f.column in numeric
        and (f.issue_type == "STATISTICAL_OUTLIER" or f.column in config.ranges)
    ]
    scored = [f.column for _, f in concerned if f.issue_type == "STATISTICAL_OUTLIER"]
    scored = list(dict.fromkeys(scored))
    spread = {}
    if scored:
        # As in the checks, columns with too few values have no outliers.
        counts = df.agg(*[F.count(F.nanvl(col(c).cast("double"), F.lit(None))) for c in scored]).first()
        spread = {c: (*pair, n) for (c, pair), n in zip(moments(df, scored).items(), counts)}
    found = {i: _flagged(fix, config, spread) for i, fix in concerned}
    return {i: F.coalesce(p, F.lit(False)) for i, p in found.items() if p is not None}


def _add_flags(
    df: DataFrame, plan: Sequence[Fix], config: QualityConfig
) -> tuple[DataFrame, dict[int, str]]:
    """Mark the offending rows before any fix changes values, like row lists taken at check time."""
    predicates = _flag_predicates(df, plan, config)
    names = {i: f"__flag_{i}" for i in predicates}
    if names:
        df = df.withColumns({names[i]: p for i, p in predicates.items()})
    return df, names


def row_marks(df: DataFrame, plan: Sequence[Fix], config: QualityConfig) -> list[Column]:
    """For each dropping fix of column values, whether it alone would drop a row of this table."""
    predicates = _flag_predicates(df, plan, config)
    marks = []
    for i, fix in enumerate(plan):
        if i in predicates:
            marks.append(predicates[i])
        elif fix.action == "convert_numeric_drop":
            marks.append(_convert(df, fix.column).isNull())
        else:
            marks.append(~_present(df, fix.column))
    return marks


# --- statistics of a batch ---------------------------------------------------

NEEDS_MEDIAN = {
    "fill_median", "convert_numeric_fill_median", "replace_median", "replace_outliers_median",
}
NEEDS_MOMENTS = {"fill_mean", "cap_values", "cap_outliers"}
NEEDS_MODE = {"fill_mode"}
MEASURED = NEEDS_MEDIAN | NEEDS_MOMENTS | NEEDS_MODE
COLUMN_ACTIONS = MEASURED | {"convert_numeric_nan", "cap_range"}
SHUFFLING = {"drop_duplicates", "drop_duplicate_ids"}


@dataclass
class _Statistics:
    median: dict[str, float | None]
    moments: dict[str, tuple[float | None, float | None]]
    mode: dict[str, str]


def _measure(df: DataFrame, batch: Sequence[tuple[int, Fix]]) -> _Statistics:
    """Everything the fixes of one batch need, one scan per kind of statistic."""
    present = set(df.columns)
    fixes = [f for _, f in batch if f.column in present]
    numeric = set(numeric_columns(df, df.columns))
    text = set(text_columns(df, df.columns))
    converts = [f.column for f in fixes if f.action == "convert_numeric_fill_median"]
    parsed = df.withColumns({c: parse_number(col(c)) for c in converts if c in text})
    middle = [f.column for f in fixes if f.action in NEEDS_MEDIAN]
    spread = [f.column for f in fixes if f.action in NEEDS_MOMENTS and f.column in numeric]
    common = [f.column for f in fixes if f.action in NEEDS_MODE]
    found = modes(df, common).collect() if common else []
    return _Statistics(
        medians(parsed, [c for c in middle if c in numeric or c in converts]),
        moments(df, spread),
        {r["column"]: r["mode"] for r in found},
    )


# --- the actions -------------------------------------------------------------


def _set(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select(*[value.alias(c) if c == name else col(c) for c in df.columns])


def _need_number(df: DataFrame, name: str) -> Column:
    if name not in numeric_columns(df, [name]):
        raise ValueError(f"column {name!r} is not numeric")
    return col(name).cast("double")


def _present(df: DataFrame, name: str) -> Column:
    kept = col(name).isNotNull()
    return kept & ~F.isnan(col(name)) if dict(df.dtypes)[name] in ("float", "double") else kept


def _fill(df: DataFrame, fix: Fix, value: float | None) -> DataFrame:
    number = F.nanvl(_need_number(df, fix.column), F.lit(None).cast("double"))
    return df if value is None else _set(df, fix.column, F.coalesce(number, F.lit(value)))


def _cap(df: DataFrame, fix: Fix, stats: _Statistics, threshold: float) -> DataFrame:
    number = _need_number(df, fix.column)
    mean, std = stats.moments[fix.column]
    if std is None or not math.isfinite(std):
        return df
    reach = threshold * std
    return _set(df, fix.column, clip(number, mean - reach, mean + reach))


def _convert(df: DataFrame, name: str) -> Column:
    return parse_number(col(name)) if name in text_columns(df, [name]) else col(name).cast("double")


def _column_fix(
    df: DataFrame, fix: Fix, flag: str | None, stats: _Statistics, config: QualityConfig
) -> DataFrame:
    name, action = fix.column, fix.action
    if action == "fill_median":
        return _fill(df, fix, stats.median.get(name))
    if action == "fill_mean":
        return _fill(df, fix, stats.moments.get(name, (None,))[0])
    if action == "fill_mode":
        if name not in stats.mode:
            return df
        kind = df.schema[name].dataType
        return _set(df, name, F.coalesce(col(name), F.lit(stats.mode[name]).cast(kind)))
    if action == "convert_numeric_nan":
        return _set(df, name, _convert(df, name))
    if action == "convert_numeric_fill_median":
        middle = stats.median.get(name)
        return _set(df, name, F.coalesce(_convert(df, name), F.lit(middle).cast("double")))
    if action == "cap_values":
        return _cap(df, fix, stats, 3.0)
    if action == "cap_outliers":
        return _cap(df, fix, stats, float(fix.parameters.get("threshold", 3.0)))
    if action == "cap_range":
        low, high = config.ranges[name]
        return _set(df, name, clip(_need_number(df, name), low, high))
    # replace_median, replace_outliers_median
    number = _need_number(df, name)
    middle = F.lit(stats.median[name]).cast("double")
    return df if flag is None else _set(df, name, F.when(col(flag), middle).otherwise(number))


def _row_fix(
    df: DataFrame, fix: Fix, flag: str | None, row_key: RowKey, flags: Sequence[str],
    anomalies: DataFrame | None,
) -> DataFrame:
    name, action = fix.column, fix.action
    if action == "drop_column":
        return df.drop(col(name))
    if action == "drop_unnamed_columns":
        gone = set(fix.parameters.get("columns") or unnamed_columns(df.columns))
        return df.select(*[col(c) for c in df.columns if c not in gone])
    if action == "convert_numeric_drop":
        return df.filter(_convert(df, name).isNotNull())
    if action == "drop_rows":
        if fix.issue_type == "MULTIVARIATE_ANOMALY":
            return df.join(_need_anomalies(anomalies, row_key), key_columns(row_key), "left_anti")
        if flag is not None:
            return df.filter(~col(flag))
        if fix.issue_type in ("VALUE_BELOW_RANGE", "VALUE_ABOVE_RANGE", "STATISTICAL_OUTLIER"):
            raise ValueError(f"column {name!r} is not numeric")
        return df.filter(_present(df, name))
    if action == "drop_duplicates":
        compared = [c for c in data_columns(df, row_key) if c not in flags]
        compared = groupable_columns(df, compared)
        return keep_one_per_row(df, compared, row_key, fix.parameters.get("keep", "first"))
    if action == "drop_duplicate_ids":
        return keep_first_per_id(df, fix.parameters.get("id_column", name), row_key)
    raise ValueError(f"unknown action {action!r}")


def _need_anomalies(anomalies: DataFrame | None, row_key: RowKey) -> DataFrame:
    if anomalies is None:
        raise ValueError("pass the anomalous rows as `anomalies`")
    return anomalies.select(*[col(k) for k in key_columns(row_key)])


def _batches(plan: Sequence[Fix]) -> list[list[tuple[int, Fix]]]:
    """Runs of column-local fixes on different columns; every other fix stands alone."""
    groups: list[list[tuple[int, Fix]]] = []
    for i, fix in enumerate(plan):
        last = groups[-1] if groups else []
        joins = (
            last
            and fix.action in COLUMN_ACTIONS
            and all(f.action in COLUMN_ACTIONS and f.column != fix.column for _, f in last)
        )
        if joins:
            last.append((i, fix))
        else:
            groups.append([(i, fix)])
    return groups


def apply_fixes(
    df: DataFrame,
    plan: Sequence[Fix],
    row_key: RowKey,
    config: QualityConfig | None = None,
    anomalies: DataFrame | None = None,
    export: Callable[[DataFrame], None] | None = None,
) -> Repaired:
    """Apply the fixes in order; a fix that fails for any reason is logged and skipped.

    Statistics are taken after the fixes before them. ``anomalies`` holds the
    row keys for the anomaly actions and ``export`` writes the exported rows.
    """
    config = config or QualityConfig()
    for fix in plan:
        check_fix(fix)
    current, flag_of = _add_flags(df, plan, config)
    log: list[tuple] = []
    batches = _batches(plan)
    for number, batch in enumerate(batches):
        measured = [(i, f) for i, f in batch if f.action in MEASURED]
        stats = None
        if len(measured) > 1:
            try:
                stats = _measure(current, batch)
            except Exception:  # noqa: BLE001 - each fix of the batch is then measured alone
                stats = None
        for i, fix in batch:
            try:
                before = current
                own = stats
                if own is None and fix.action in MEASURED:
                    own = _measure(current, [(i, fix)])
                if fix.column is not None and fix.column not in current.columns:
                    raise ValueError(f"column {fix.column!r} does not exist any more")
                if fix.action == "export_anomalies":
                    rows = _need_anomalies(anomalies, row_key)
                    if export is None:
                        raise ValueError("pass `export` to write the anomalous rows")
                    plain = current.drop(*flag_of.values())
                    export(plain.join(rows, key_columns(row_key), "left_semi"))
                elif fix.action in COLUMN_ACTIONS:
                    current = _column_fix(current, fix, flag_of.get(i), own, config)
                else:
                    current = _row_fix(
                        current, fix, flag_of.get(i), row_key, list(flag_of.values()), anomalies
                    )
                current.schema  # analysed here, so that a fix that cannot be planned fails here
                log.append((i, fix.action, fix.column, "applied", None))
            except Exception as problem:  # noqa: BLE001 - whatever fails, the other fixes go on
                current = before
                log.append((i, fix.action, fix.column, "skipped", str(problem)))
        later = [f for group in batches[number + 1 :] for _, f in group]
        if batch[0][1].action in SHUFFLING and any(f.action in MEASURED for f in later):
            # Later statistics scan the data again; keep the shuffled result for them.
            current = pin(current)
    schema = "step int, action string, column string, status string, message string"
    spark = df.sparkSession
    return Repaired(current.drop(*flag_of.values()), spark.createDataFrame(log, schema))
