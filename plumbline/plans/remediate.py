"""From findings to a repair plan, to repaired data, and back to validation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from plumbline.config import QualityConfig
from plumbline.functions.columns import RowKey
from plumbline.operators.checks import unnamed_columns
from plumbline.operators.repair import (
    CATEGORIES, OTHER_CATEGORY, Fix, Repaired, apply_fixes, check_fix,
)
from plumbline.plans.validate import ValidationReport, validate

Choice = str | tuple[str, Mapping[str, Any]]

# Order in which categories are worked through.
_ORDER = list(dict.fromkeys(CATEGORIES.values())) + [OTHER_CATEGORY]


def propose_plan(
    issues: DataFrame,
    choices: Mapping[str | tuple[str, str | None], Choice],
    columns: Sequence[str] = (),
) -> list[Fix]:
    """Turn critical and warning issues into fixes.

    ``choices`` maps an issue type, or an (issue type, column) pair, to an
    action or an (action, parameters) pair. Issues without a choice are left
    alone; an action the issue does not offer, or a loss of rows that is not
    confirmed, is refused. Issues are one row per column and type.
    """
    found = issues.filter("severity in ('critical', 'warning')").collect()
    if "position" in issues.columns:
        found.sort(key=lambda i: i["position"])
    found.sort(key=lambda i: _ORDER.index(CATEGORIES.get(i["issue_type"], OTHER_CATEGORY)))
    plan = []
    for issue in found:
        kind, column = issue["issue_type"], issue["column"]
        choice = choices.get((kind, column), choices.get(kind))
        if choice is None:
            continue
        action, parameters = (choice, {}) if isinstance(choice, str) else choice
        parameters = dict(parameters)
        if action == "drop_unnamed_columns":
            parameters.setdefault("columns", unnamed_columns(columns) or None)
        if action == "drop_duplicate_ids":
            parameters.setdefault("id_column", column)
        about = f" on '{column}'" if column else ""
        fix = Fix(kind, column, action, parameters, f"{action}{about} for {kind}")
        check_fix(fix)
        plan.append(fix)
    return plan


def remediate(
    df: DataFrame,
    report: ValidationReport,
    choices: Mapping[str | tuple[str, str | None], Choice],
    row_key: RowKey,
    config: QualityConfig | None = None,
    export: Callable[[DataFrame], None] | None = None,
) -> Repaired:
    """Plan and apply the chosen fixes for a validated table."""
    plan = propose_plan(report.issues, choices, df.columns)
    return apply_fixes(df, plan, row_key, config, report.anomalies, export)


def revalidate(
    df: DataFrame, plan: Sequence[Fix], row_key: RowKey, config: QualityConfig | None = None
) -> ValidationReport:
    """Validate what the fixes leave."""
    return validate(apply_fixes(df, plan, row_key, config).data, row_key, config)
