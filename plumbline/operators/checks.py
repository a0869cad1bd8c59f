"""Issue rows derived from column facts. Every function returns the issue columns of ISSUE_FIELDS."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import QualityConfig
from plumbline.functions.columns import col, text_columns
from plumbline.functions.values import not_a_number
from plumbline.operators.facts import scorable, z_score
from plumbline.texts import QUALITY_ADVICE, QUALITY_ADVICE_NONE

ISSUE_FIELDS = ("severity", "issue_type", "column", "affected_rows", "fraction")

# Header of a column that had none: pandas writes "Unnamed: 3", Spark "_c3".
_NO_HEADER = re.compile(r"Unnamed|^_c\d+$")


def repeated_names(columns: Sequence[str]) -> list[str]:
    """Column names beyond their first use, in order."""
    seen: Counter = Counter()
    again = []
    for name in columns:
        if seen[name]:
            again.append(name)
        seen[name] += 1
    return again


def unnamed_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if _NO_HEADER.search(c)]


def too_few_rows(df: DataFrame, config: QualityConfig) -> DataFrame:
    """INSUFFICIENT_ROWS where the table is smaller than the minimum."""
    size = df.agg(F.count(F.lit(1)).alias("affected_rows"))
    return size.filter(F.col("affected_rows") < config.min_rows).select(
        F.lit("warning").alias("severity"),
        F.lit("INSUFFICIENT_ROWS").alias("issue_type"),
        "affected_rows",
    )


Kind = tuple[Column, Column, Column]


def _missing(config: QualityConfig) -> list[Kind]:
    share = F.col("null_count") / F.col("n_rows")
    grade = (
        F.when(F.col("null_count") == F.col("n_rows"), "EMPTY_COLUMN")
        .when(share >= config.null_threshold_critical, "HIGH_NULL_RATE")
        .when(share >= config.null_threshold_warning, "MODERATE_NULL_RATE")
        .when(F.col("null_count") > 0, "LOW_NULL_RATE")
    )
    severity = (
        F.when(grade.isin("EMPTY_COLUMN", "HIGH_NULL_RATE"), "critical")
        .when(grade == "MODERATE_NULL_RATE", "warning")
        .otherwise("info")
    )
    return [(grade, severity, F.col("null_count"))]


def _out_of_range() -> list[Kind]:
    return [
        (F.lit("VALUE_BELOW_RANGE"), F.lit("critical"), F.col("below")),
        (F.lit("VALUE_ABOVE_RANGE"), F.lit("critical"), F.col("above")),
    ]


def _mixed_types(config: QualityConfig) -> list[Kind]:
    many = F.col("unique_count") / F.col("n_rows") >= config.type_check_min_unique_fraction
    return [(F.lit("TYPE_INCONSISTENCY"), F.lit("warning"), F.when(many, F.col("unparsable")))]


def _outliers() -> list[Kind]:
    return [(F.lit("STATISTICAL_OUTLIER"), F.lit("warning"), F.col("outliers"))]


def _issues(facts: DataFrame, kinds: Sequence[Kind]) -> DataFrame:
    cells = [cell for kind in kinds for cell in kind]
    long = facts.select(
        "column",
        "n_rows",
        F.stack(F.lit(len(kinds)), *cells).alias("issue_type", "severity", "affected_rows"),
    )
    return long.filter("affected_rows > 0").select(
        "severity",
        "issue_type",
        "column",
        "affected_rows",
        F.try_divide("affected_rows", "n_rows").alias("fraction"),
    )


def completeness_issues(facts: DataFrame, config: QualityConfig) -> DataFrame:
    """Missing-value issues, graded by the share of missing cells."""
    return _issues(facts, _missing(config))


def range_issues(facts: DataFrame) -> DataFrame:
    """Values outside the configured range of their column."""
    return _issues(facts, _out_of_range())


def type_issues(facts: DataFrame, config: QualityConfig) -> DataFrame:
    """Text columns with many distinct values, some of which are not numbers.

    Needs the columns of ``text_facts`` besides ``n_rows``.
    """
    return _issues(facts, _mixed_types(config))


def outlier_issues(facts: DataFrame) -> DataFrame:
    """Needs the column ``outliers`` besides ``n_rows``."""
    return _issues(facts, _outliers())


def column_issues(facts: DataFrame, config: QualityConfig) -> DataFrame:
    """All issues of single columns from one frame of facts."""
    kinds = [*_missing(config), *_mixed_types(config), *_out_of_range(), *_outliers()]
    return _issues(facts, kinds)


def status_of(issues: DataFrame) -> DataFrame:
    """One row: FAIL on any critical issue, else WARNING on any warning, else PASS."""
    worst = F.max(
        F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1)
    )
    return issues.agg(
        F.when(worst == 2, "FAIL").when(worst == 1, "WARNING").otherwise("PASS").alias("status")
    )


def advice(issue_types: Iterable[str]) -> list[tuple[int, str]]:
    """(rule, recommendation) in rule order for the critical and warning issue types."""
    present = set(issue_types)
    fired = [
        (rule, text)
        for rule, (kinds, text) in enumerate(QUALITY_ADVICE, 1)
        if present.intersection(kinds)
    ]
    return fired or [(len(QUALITY_ADVICE) + 1, QUALITY_ADVICE_NONE)]


@dataclass(frozen=True)
class RowCheck:
    """An issue that single rows either have or have not."""

    issue_type: str
    column: str
    predicate: Column
    z_score: Column | None = None


def row_checks(
    df: DataFrame,
    facts: Sequence,
    config: QualityConfig,
    wanted: set[tuple[str, str]] | None = None,
) -> list[RowCheck]:
    """Predicates of the row-level issues; ``wanted`` keeps only found (type, column) pairs."""
    text = set(text_columns(df, [f["column"] for f in facts]))
    limit = config.outlier_zscore_threshold
    ranged, typed = [], []
    for fact in facts:
        name = fact["column"]
        if name in text:
            typed.append(RowCheck("TYPE_INCONSISTENCY", name, not_a_number(col(name))))
        elif name in config.ranges and fact["mean"] is not None:
            low, high = config.ranges[name]
            number = col(name).cast("double")
            ranged.append(RowCheck("VALUE_BELOW_RANGE", name, number < low))
            ranged.append(RowCheck("VALUE_ABOVE_RANGE", name, number > high))
    scored = []
    for name, mean, std in scorable(facts, config):
        z = z_score(name, mean, std)
        scored.append(RowCheck("STATISTICAL_OUTLIER", name, F.abs(z) > limit, z))
    found = chain(typed, ranged, scored)
    return [c for c in found if wanted is None or (c.issue_type, c.column) in wanted]
