"""Fairness audit of binary predictions."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from plumbline.config import FairnessConfig
from plumbline.functions.columns import RowKey
from plumbline.functions.storage import pin
from plumbline.operators import groups, lattice
from plumbline.operators.scoring import score_proxy
from plumbline.operators.sensitive import detect_sensitive, prepare_sensitive
from plumbline.sources.writers import write_report
from plumbline.texts import (
    FAIRNESS_ADVICE_DATA, FAIRNESS_ADVICE_GROUP, FAIRNESS_ADVICE_HIGH, FAIRNESS_ADVICE_LAST,
    FAIRNESS_ADVICE_METRIC, FAIRNESS_ADVICE_NONE,
)


@dataclass(frozen=True)
class AuditReport:
    """Outcome of an audit. Group tables have one row per group and are never collected."""

    timestamp: str
    dataset_info: dict[str, Any]
    overall_status: str
    attribute_metrics: DataFrame
    group_metrics: DataFrame
    violations: DataFrame
    violation_groups: DataFrame
    diagnostics: DataFrame
    recommendations: list[str] = field(default_factory=list)
    execution_time_seconds: float = 0.0

    def write_json(self, path: str, mode: str = "errorifexists") -> None:
        """Write every table as JSON lines, figures rounded to four digits."""
        spark = self.violations.sparkSession
        head = Row(
            timestamp=self.timestamp,
            overall_status=self.overall_status,
            execution_time_seconds=self.execution_time_seconds,
            **self.dataset_info,
        )
        lines = [(n, text) for n, text in enumerate(self.recommendations, 1)]
        tables = {
            "summary": spark.createDataFrame([head]),
            "attribute_metrics": self.attribute_metrics,
            "group_metrics": self.group_metrics,
            "violations": self.violations,
            "violation_groups": self.violation_groups,
            "diagnostics": self.diagnostics,
            "recommendations": spark.createDataFrame(lines, "rule int, recommendation string"),
        }
        write_report(tables, path, digits=4, mode=mode)


def fairness_advice(violations: Sequence[Row]) -> list[str]:
    """Recommendation lines; attributes in order of their first violation.

    ``violations`` is bounded by four metrics per attribute combination.
    """
    if not violations:
        return [FAIRNESS_ADVICE_NONE]
    lines = []
    if any(v["severity"] == "HIGH" for v in violations):
        lines.append(FAIRNESS_ADVICE_HIGH)
    for attribute in dict.fromkeys(v["attribute"] for v in violations):
        lines.append(FAIRNESS_ADVICE_DATA.format(attribute=attribute))
        for v in violations:
            if v["attribute"] != attribute or v["metric"] == "equalized_odds_difference":
                continue
            by_rate = v["metric"] != "equal_opportunity_difference"
            group = v["lowest_rate_group"] if by_rate else v["lowest_tpr_group"]
            lines.append(FAIRNESS_ADVICE_GROUP.format(group=group))
            break
    metrics = {v["metric"] for v in violations}
    lines += [text for metric, text in FAIRNESS_ADVICE_METRIC if metric in metrics]
    return [*lines, FAIRNESS_ADVICE_LAST]


def audit(
    df: DataFrame,
    y_true: str,
    y_pred: str,
    attributes: Sequence[str],
    config: FairnessConfig | None = None,
    custom_metrics: Mapping[str, Column] | None = None,
    diagnostics: DataFrame | None = None,
) -> AuditReport:
    """Audit predictions over every attribute and their intersections; reads the data once."""
    config = config or FairnessConfig()
    started = time.time()
    attributes = list(attributes)
    if not attributes:
        raise ValueError("name at least one attribute")
    counts = pin(groups.additive_counts(df, y_true, y_pred, attributes))
    invalid = counts.agg(F.sum("invalid").alias("n")).first()["n"]
    if invalid:
        raise ValueError(f"{y_true!r} and {y_pred!r} must be binary (0/1): {invalid} rows are not")
    info = groups.dataset_info(counts).first().asDict()

    depth = config.max_intersection_depth
    names = [groups.JOIN_NAMES.join(m) for m in groups.attribute_sets(attributes, depth)]
    if config.intersection_tolerance is None:
        grouped = groups.group_counts(counts, attributes, depth)
    else:
        grouped, facts = lattice.pruned_counts(counts, attributes, config)
        names = [f.attribute for f in facts if f.kept]
    every = groups.group_metrics(grouped, custom_metrics)
    retained = groups.retained_groups(every, config)
    summary = pin(groups.attribute_summary(every, config))
    metrics = groups.attribute_metrics(summary, config)
    broken = groups.violations(metrics, config)
    found = broken.orderBy("set_number", "metric_number").collect()
    notes = groups.small_groups(every, config).select(
        "attribute", F.lit("small_group").alias("kind"), "n", F.lit(None).cast("double").alias("pct")
    )
    if diagnostics is not None:
        notes = notes.unionByName(diagnostics)
    return AuditReport(
        timestamp=datetime.now().isoformat(),
        dataset_info={**info, "groups_analyzed": names},
        overall_status="BIAS_DETECTED" if found else "PASS",
        attribute_metrics=metrics.select(
            "attribute", "is_intersection", "metric", "value", "threshold", "status"
        ),
        group_metrics=retained.drop("is_intersection", "set_number"),
        violations=broken.orderBy("set_number", "metric_number").select(
            "metric", "attribute", "value", "threshold", "severity", "interpretation"
        ),
        violation_groups=groups.violation_groups(broken, retained),
        diagnostics=notes,
        recommendations=fairness_advice(found),
        execution_time_seconds=time.time() - started,
    )


def audit_table(
    df: DataFrame,
    target: str,
    row_key: RowKey,
    config: FairnessConfig | None = None,
    detected: Mapping[str, str] | None = None,
) -> AuditReport | None:
    """Model the target, find sensitive columns among the test rows and audit the predictions.

    None where no sensitive column is found.
    """
    scored = score_proxy(df, target, row_key)
    rows = pin(scored.data)
    keys = {row_key} if isinstance(row_key, str) else set(row_key)
    hidden = [target, "y_true", "y_pred", *keys]
    detected = detected or detect_sensitive(rows, exclude=hidden)
    if not detected:
        return None
    prepared = prepare_sensitive(rows, detected)
    return audit(
        prepared.data, "y_true", "y_pred", prepared.attributes, config,
        diagnostics=prepared.diagnostics,
    )
