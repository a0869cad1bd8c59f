"""A repair plan chosen without asking: what each finding loses is counted first.

Every finding can be repaired in place (fill, cap, convert) or by dropping its rows. One pass
groups the rows by the set of findings they carry; from those counts alone follow the rows lost,
the values invented and the gaps left under any choice, so the search never reads the table again.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.config import QualityConfig
from plumbline.functions.columns import (
    RowKey, col, data_columns, groupable_columns, numeric_columns, quoted, text_columns,
)
from plumbline.functions.storage import pin
from plumbline.functions.values import parse_number
from plumbline.operators.checks import unnamed_columns
from plumbline.operators.duplicates import repeat_candidates
from plumbline.operators.repair import Fix, row_marks

#: Findings whose rows may go; rows with statistical outliers are only capped unless asked for.
DROPPABLE = (
    "HIGH_NULL_RATE", "MODERATE_NULL_RATE", "TYPE_INCONSISTENCY", "VALUE_BELOW_RANGE",
    "VALUE_ABOVE_RANGE",
)
#: A text column with fewer numbers than this share of its values stays text.
LEAST_NUMBERS = 0.5
_GAPS = ("HIGH_NULL_RATE", "MODERATE_NULL_RATE")
_RANGES = ("VALUE_BELOW_RANGE", "VALUE_ABOVE_RANGE")
# Findings of a row are bits of long columns.
_WORD = 62
_FILLED_BY_MODE = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Finding:
    """An issue of single rows, and both ways to repair it."""

    issue_type: str
    column: str
    in_place: str | None
    dropping: str


@dataclass(frozen=True)
class SafePlan:
    """The fixes in order, and what they will leave."""

    fixes: list[Fix]
    rows_before: int
    rows_after: int
    gaps_left: int
    repaired: int

    @property
    def rows_lost(self) -> int:
        return self.rows_before - self.rows_after


def _word(bit: int) -> str:
    return f"__w{bit // _WORD}"


def _selected(bits: Iterable[int]) -> list[Column]:
    masks: dict[str, int] = {}
    for bit in bits:
        masks[_word(bit)] = masks.get(_word(bit), 0) | 1 << bit % _WORD
    return [F.col(word).bitwiseAND(F.lit(mask).cast("bigint")) for word, mask in masks.items()]


def _any(bits: Iterable[int]) -> Column:
    """Does a row carry one of these findings?"""
    return reduce(lambda a, b: a | b, [cell != 0 for cell in _selected(bits)], F.lit(False))


def _number(bits: Iterable[int]) -> Column:
    """How many of these findings a row carries."""
    return reduce(lambda a, b: a + b, [F.bit_count(cell) for cell in _selected(bits)], F.lit(0))


def _missing(df: DataFrame, name: str) -> str:
    gone = f"{quoted(name)} is null"
    floating = isinstance(df.schema[name].dataType, T.FloatType | T.DoubleType)
    return f"({gone} or isnan({quoted(name)}))" if floating else f"({gone})"


def _findings(df: DataFrame, issues: Sequence, row_key: RowKey, config: QualityConfig) -> list[Finding]:
    """Issues of rows, in the order of the report."""
    usable = set(groupable_columns(df, data_columns(df, row_key)))
    numeric, text = set(numeric_columns(df, df.columns)), set(text_columns(df, df.columns))
    mixed = [i["column"] for i in issues if i["issue_type"] == "TYPE_INCONSISTENCY" and i["column"] in text & usable]
    if mixed:
        counts = df.agg(
            *[F.count(col(c)) for c in mixed], *[F.count(parse_number(col(c))) for c in mixed]
        ).first()
        mixed = [
            c for c, present, numbers in zip(mixed, counts, counts[len(mixed) :])
            if numbers >= LEAST_NUMBERS * present
        ]
    found = []
    for issue in issues:
        kind, name = issue["issue_type"], issue["column"]
        if name not in usable:
            continue
        if kind == "TYPE_INCONSISTENCY" and name in mixed:
            found.append(Finding(kind, name, "convert_numeric_fill_median", "convert_numeric_drop"))
        elif kind in _GAPS and name not in mixed:
            cell = df.schema[name].dataType
            fill = "fill_mode" if isinstance(cell, _FILLED_BY_MODE) else "fill_median" if name in numeric else None
            found.append(Finding(kind, name, fill, "drop_rows"))
        elif kind in _RANGES and name in numeric and name in config.ranges:
            found.append(Finding(kind, name, "cap_range", "drop_rows"))
        elif kind == "STATISTICAL_OUTLIER" and name in numeric:
            found.append(Finding(kind, name, "cap_outliers", "drop_rows"))
    return list(dict.fromkeys(found))


def _counted(
    df: DataFrame, findings: Sequence[Finding], untouched: Sequence[str], row_key: RowKey, config: QualityConfig,
    repeats: bool,
) -> DataFrame:
    """One row for each set of findings: rows, repeating rows, and gaps of untouched columns in both."""
    fixes = [Fix(f.issue_type, f.column, f.dropping) for f in findings]
    marks = row_marks(df, fixes, config)
    words = {_word(bit): F.lit(0).cast("bigint") for bit in range(len(marks) or 1)}
    for bit, mark in enumerate(marks):
        words[_word(bit)] = words[_word(bit)].bitwiseOR(F.shiftleft(mark.cast("bigint"), bit % _WORD))
    gaps = F.expr(" + ".join(["0L", *[f"cast({_missing(df, c)} as bigint)" for c in untouched]]))
    marked = df.withColumns({**words, "__gaps": gaps})
    names = list(words)
    groups = marked.groupBy(*names).agg(F.count(F.lit(1)).alias("rows"), F.sum("__gaps").alias("gaps"))
    if not repeats:
        return groups.withColumns({"again": F.lit(0).cast("bigint"), "gaps_again": F.lit(0).cast("bigint")})
    compared = groupable_columns(df, data_columns(df, row_key))
    # Equal rows carry equal findings.
    again = (
        repeat_candidates(marked, compared)
        .groupBy(*[col(c) for c in compared], *names, "__gaps")
        .agg((F.count(F.lit(1)) - 1).alias("n"))
        .groupBy(*names)
        .agg(F.sum("n").alias("again"), F.sum(F.col("n") * F.col("__gaps")).alias("gaps_again"))
    )
    return groups.join(again, names, "left").fillna(0, ["again", "gaps_again"])


def _choose(groups: DataFrame, candidates: Sequence[int], repairable: Sequence[int], allowed: int) -> list[int]:
    """Findings whose rows go: most repairs saved for a lost row first, as long as rows may be lost."""
    chosen: list[int] = []
    open_ = list(candidates)
    while open_ and allowed > 0:
        left = groups.filter(~_any(chosen))
        saved = F.col("kept") * (1 + _number([b for b in repairable if b not in chosen]))
        cells = []
        for bit in open_:
            here = _any([bit])
            cells += [F.sum(F.when(here, F.col("kept"))), F.sum(F.when(here, saved))]
        counts = [n or 0 for n in left.agg(*cells).first()]
        ranked = [
            (-gain / lost, bit, lost)
            for bit, lost, gain in zip(open_, counts[::2], counts[1::2])
            if 0 < lost <= allowed
        ]
        if not ranked:
            break
        _, best, lost = min(ranked)
        chosen.append(best)
        allowed -= lost
        open_ = [bit for _, bit, _ in ranked if bit != best]
    return chosen


def propose_safe_plan(
    df: DataFrame,
    issues: DataFrame,
    row_key: RowKey,
    config: QualityConfig | None = None,
    max_lost_share: float = 0.05,
    droppable: Collection[str] = DROPPABLE,
) -> SafePlan:
    """Fixes for the critical and warning issues of a validated table, and what they leave.

    At most ``max_lost_share`` of the rows go: repeated rows first, if all of them fit, then the
    rows of ``droppable`` findings, greedily by the values a lost row saves from being made up;
    ties go to the earlier issue. All other findings are repaired in place: gaps by the median or,
    outside numbers, the mode; values out of range and outliers by capping; mixed columns become
    numbers if at least half of their values are. Empty and unnamed columns go. Left alone are
    repeated identifiers and multivariate anomalies (their repairs lose data and must be
    confirmed), text columns with other words in them, gaps in arrays and structs that do not fit the bound, and columns that
    cannot be compared, such as maps; the latter's gaps and the row key's are not counted either.

    ``rows_after`` and ``gaps_left`` equal what ``apply_fixes`` leaves. ``repaired`` counts the
    findings that are repaired in place. An empty table gives a plan without row fixes.
    """
    config = config or QualityConfig()
    found = issues.filter("severity in ('critical', 'warning')").collect()
    if "position" in issues.columns:
        found.sort(key=lambda i: i["position"])
    kinds = {i["issue_type"] for i in found}
    empty = [i["column"] for i in found if i["issue_type"] == "EMPTY_COLUMN" and i["column"] in df.columns]
    unnamed = [c for c in unnamed_columns(df.columns) if "UNNAMED_COLUMNS" in kinds]
    gone = {*empty, *unnamed}
    findings = _findings(df, [i for i in found if i["column"] not in gone], row_key, config)
    counted = groupable_columns(df, data_columns(df, row_key))
    closing = {f.column: bit for bit, f in enumerate(findings) if f.issue_type in (*_GAPS, "TYPE_INCONSISTENCY")}
    untouched = [c for c in counted if c not in gone and c not in closing]
    groups = pin(_counted(df, findings, untouched, row_key, config, "DUPLICATE_ROWS" in kinds))

    total, again = (n or 0 for n in groups.agg(F.sum("rows"), F.sum("again")).first())
    allowed = int(max_lost_share * total)
    once = 0 < again <= allowed
    kept = F.col("rows") - F.col("again") if once else F.col("rows")
    gaps = F.col("gaps") - F.col("gaps_again") if once else F.col("gaps")
    groups = groups.withColumns({"kept": kept, "open": gaps})
    repairable = [bit for bit, f in enumerate(findings) if f.in_place]
    candidates = [bit for bit, f in enumerate(findings) if f.issue_type in droppable]
    chosen = _choose(groups, candidates, repairable, allowed - (again if once else 0))

    # A column is filled only if a row that stays has a value.
    bits = list(closing.values())
    left = groups.filter(~_any(chosen))
    in_place = [bit for bit in repairable if bit not in chosen]
    figures = left.agg(
        F.sum("kept"), F.sum("open"), F.sum(F.col("kept") * _number(in_place)),
        *[F.sum(F.when(_any([bit]), F.col("kept"))) for bit in bits],
    ).first()
    rows, open_gaps, repaired, *missing = (n or 0 for n in figures)
    for bit, n in zip(bits, missing):
        if bit not in chosen and (findings[bit].in_place is None or n == rows):
            open_gaps += n
    return SafePlan(_in_order(findings, chosen, once, empty, unnamed), total, rows, open_gaps, repaired)


def _in_order(
    findings: Sequence[Finding], chosen: Sequence[int], once: bool, empty: Sequence[str], unnamed: Sequence[str]
) -> list[Fix]:
    """Rows go first, so that later statistics see only those that stay; gaps are filled last."""
    plan = []
    for bit in sorted(chosen):
        of = findings[bit]
        plan.append(Fix(of.issue_type, of.column, of.dropping))
    if once:
        plan.append(Fix("DUPLICATE_ROWS", None, "drop_duplicates"))
    plan += [Fix("EMPTY_COLUMN", c, "drop_column") for c in empty if c not in unnamed]
    if unnamed:
        plan.append(Fix("UNNAMED_COLUMNS", None, "drop_unnamed_columns", {"columns": list(unnamed)}))
    # What is left of a mixed column whose other rows are gone parses as a whole.
    plan += [
        Fix(findings[b].issue_type, findings[b].column, "convert_numeric_nan")
        for b in sorted(chosen) if findings[b].issue_type == "TYPE_INCONSISTENCY"
    ]
    rest = [f for b, f in enumerate(findings) if b not in chosen and f.in_place]
    for action in ("convert_numeric_fill_median", "cap_range", "cap_outliers", "fill_median", "fill_mode"):
        one = {f.column: f for f in reversed(rest) if f.in_place == action}
        plan += [Fix(f.issue_type, f.column, action) for f in reversed(one.values())]
    return plan
