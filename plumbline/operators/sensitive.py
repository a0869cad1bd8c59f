"""Find demographic columns and prepare them as group labels."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col, numeric_columns
from plumbline.functions.counts import modes
from plumbline.functions.longform import stack
from plumbline.functions.values import bands

# Column-name patterns per attribute, matched from the start of the
# lower-cased name; attributes and patterns are tried in this order.
NAME_PATTERNS = {
    "sex": [
        r"^riagendr$",
        r"^sex$", r"^gender$", r"^male$", r"^female$", r"^m/f$", r"^sex_.*", r"^gender_.*",
        r".*sex.*", r".*gender.*",
    ],
    "age": [
        r"^ridageyr$", r"^ridagemn$",
        r"^age$", r"^age_.*", r".*_age$", r"^patient_age$", r"^years$", r"^age_group$",
        r".*age.*",
    ],
    "race": [
        r"^ridreth.*",
        r"^race$", r"^ethnicity$", r"^ethnic.*", r"^race_.*", r"^racial.*",
        r".*race.*", r".*ethnic.*",
    ],
    "nationality": [
        r"^nation.*", r"^country.*", r"^origin$", r"^birth_country$", r"^foreign.*",
    ],
    "marital": [r"^marital.*", r"^married$", r"^marriage.*", r"^spouse.*"],
    "religion": [r"^religion$", r"^religious.*", r"^faith$"],
    "disability": [r"^disab.*", r"^handicap.*", r"^impair.*"],
    "insurance": [
        r"^insurance.*", r"^insured$", r"^coverage.*", r"^medicaid$", r"^medicare$",
    ],
}

# A column holding both values of a pair is taken as sex.
SEX_VALUE_PAIRS = (("male", "female"), ("m", "f"), ("man", "woman"), ("0", "1"))

# Labels that stand for "not known".
INVALID_LABELS = ("nan", "None", "NaN", "unknown", "Unknown", "Unknown/Invalid", "?", "")

# Default age bands.
AGE_EDGES = (0, 40, 60, 100)
AGE_LABELS = ("<40", "40-60", ">60")


def sex_value_hits(
    df: DataFrame, names: Sequence[str], max_distinct: int | None = None
) -> DataFrame:
    """(position, column, hit): does a column hold both values of a known pair?

    One scan with boolean aggregates; distinct values are never gathered.
    ``max_distinct`` refuses columns with (approximately) more distinct values,
    such as row numbers, which otherwise match the pair 0/1.
    """
    entries = [
        [F.lit(i), F.lit(c), F.lower(col(c).cast("string"))] for i, c in enumerate(names)
    ]
    value = F.col("value")
    tokens = [token for pair in SEX_VALUE_PAIRS for token in pair]
    seen = stack(df, entries, ["position", "column", "value"]).groupBy("position", "column").agg(
        *[F.coalesce(F.bool_or(value == t), F.lit(False)).alias(f"has_{t}") for t in tokens],
        *([] if max_distinct is None else [F.approx_count_distinct("value").alias("distinct")]),
    )
    hit = F.lit(False)
    for first, second in SEX_VALUE_PAIRS:
        hit = hit | (F.col(f"has_{first}") & F.col(f"has_{second}"))
    if max_distinct is not None:
        hit = hit & (F.col("distinct") <= max_distinct)
    return seen.select("position", "column", hit.alias("hit"))


def detect_sensitive(
    df: DataFrame,
    custom_patterns: Mapping[str, Sequence[str]] | None = None,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    max_distinct: int | None = None,
) -> dict[str, str]:
    """Map attribute to column, by column name and, for sex, also by values.

    A column takes at most one attribute by name and an attribute keeps its
    first column. Values are only looked at in columns up to the one whose
    name says sex, in a single scan.
    """
    patterns = {kind: list(p) for kind, p in NAME_PATTERNS.items()}
    for kind, extra in (custom_patterns or {}).items():
        patterns.setdefault(kind, []).extend(extra)
    names = [c for c in (include or df.columns) if c not in set(exclude or ())]

    by_name = _claim(names, patterns)
    stop = names.index(by_name["sex"]) if "sex" in by_name else len(names)
    value_hit = None
    if stop:
        hits = sex_value_hits(df, names[:stop], max_distinct).filter("hit")
        first = hits.agg(F.min_by("column", "position")).first()
        value_hit = first[0]
    if value_hit is None:
        return by_name
    # The values claimed sex before its name came up; the column with that name
    # is then free for a later attribute.
    return _claim(names, patterns, value_hit)


def _claim(
    names: Sequence[str], patterns: Mapping, sex_column: str | None = None
) -> dict[str, str]:
    claimed: dict[str, str] = {}
    for name in names:
        text = name.lower().strip()
        for kind, tests in patterns.items():
            if kind not in claimed and any(re.match(t, text, re.IGNORECASE) for t in tests):
                claimed[kind] = name
                break
        if name == sex_column and "sex" not in claimed:
            claimed["sex"] = name
    return claimed


@dataclass(frozen=True)
class Prepared:
    """Labels ready for an audit: data with one text column per attribute, and notes."""

    data: DataFrame
    attributes: list[str]
    diagnostics: DataFrame


def prepared_name(kind: str, create_age_groups: bool = True) -> str:
    return "age_group" if kind == "age" and create_age_groups else kind


def raw_labels(
    df: DataFrame,
    detected: Mapping[str, str],
    create_age_groups: bool = True,
    age_edges: Sequence[float] = AGE_EDGES,
    age_labels: Sequence[str] = AGE_LABELS,
) -> tuple[DataFrame, list[str]]:
    """Add one text column per attribute; numeric ages become bands."""
    numeric = set(numeric_columns(df, list(detected.values())))
    labels = {}
    for kind, column in detected.items():
        label = col(column).cast("string")
        if kind == "age" and create_age_groups and column in numeric:
            label = bands(col(column), age_edges, age_labels)
        labels[prepared_name(kind, create_age_groups)] = label
    kept = [col(c) for c in df.columns if c not in labels]
    return df.select(*kept, *[v.alias(k) for k, v in labels.items()]), list(labels)


def is_invalid(attribute: str):
    return col(attribute).isNull() | col(attribute).isin(*INVALID_LABELS)


def invalid_counts(labelled: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(attribute, kind, n, pct) of labels that stand for "not known"."""
    entries = [[F.lit(a), is_invalid(a)] for a in attributes]
    return (
        stack(labelled, entries, ["attribute", "invalid"])
        .groupBy("attribute")
        .agg(F.count_if("invalid").alias("n"), F.count(F.lit(1)).alias("total"))
        .filter("n > 0")
        .select(
            "attribute",
            F.lit("imputed_with_mode").alias("kind"),
            "n",
            (F.col("n") / F.col("total") * 100).alias("pct"),
        )
    )


def valid_modes(labelled: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(column, mode, n): most frequent valid label per attribute."""
    valid = labelled.select(*[F.when(~is_invalid(a), col(a)).alias(a) for a in attributes])
    return modes(valid, attributes)


def fill_invalid(labelled: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Replace invalid labels by the most frequent valid one; unchanged if there is none."""
    found = {r["column"]: r["mode"] for r in valid_modes(labelled, attributes).collect()}
    filled = {
        a: F.when(is_invalid(a), F.lit(found[a])).otherwise(col(a)) for a in attributes if a in found
    }
    return labelled.select(*[filled.get(c, col(c)).alias(c) for c in labelled.columns])


def prepare_sensitive(
    df: DataFrame,
    detected: Mapping[str, str],
    create_age_groups: bool = True,
    age_edges: Sequence[float] = AGE_EDGES,
    age_labels: Sequence[str] = AGE_LABELS,
) -> Prepared:
    """Bands for numeric ages, text labels, invalid labels replaced by the mode."""
    labelled, attributes = raw_labels(df, detected, create_age_groups, age_edges, age_labels)
    notes = invalid_counts(labelled, attributes)
    age = detected.get("age")
    if age is not None and create_age_groups and age not in numeric_columns(df, [age]):
        note = [("age_group", "age_already_banded", None, None)]
        notes = notes.unionByName(
            df.sparkSession.createDataFrame(note, "attribute string, kind string, n bigint, pct double")
        )
    return Prepared(fill_invalid(labelled, attributes), attributes, notes)
