"""Audit of predictions with more than two classes: each class against the rest.

The data is read once, into counts by attribute values, true and predicted class; groups,
intersections and all figures come from those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators.groups import JOIN_NAMES, JOIN_VALUES, attribute_sets


def confusion_counts(df: DataFrame, y_true: str, y_pred: str, attributes: Sequence[str]) -> DataFrame:
    """(a0.., truth, guess, n); rows without a true or a predicted class are left out."""
    keys = [F.coalesce(col(a).cast("string"), F.lit("nan")).alias(f"a{i}") for i, a in enumerate(attributes)]
    rows = df.select(*keys, col(y_true).cast("string").alias("truth"), col(y_pred).cast("string").alias("guess"))
    kept = rows.filter("truth IS NOT NULL AND guess IS NOT NULL")
    return kept.groupBy(*[f"a{i}" for i in range(len(attributes))], "truth", "guess").agg(
        F.count(F.lit(1)).alias("n")
    )


def group_confusion(counts: DataFrame, attributes: Sequence[str], depth: int = 1) -> DataFrame:
    """(attribute, grp, truth, guess, n) for every attribute and intersection up to ``depth``."""
    sets = attribute_sets(attributes, depth)
    number = {a: f"a{i}" for i, a in enumerate(attributes)}
    parts = F.array(*[
        F.struct(
            F.lit(JOIN_NAMES.join(members)).alias("attribute"),
            F.array(*[F.col(number[a]) for a in members]).alias("members"),
        )
        for members in sets
    ])
    # The counts are few; the values stay apart, so that labels holding the separator do too.
    each = counts.select(F.explode(parts).alias("g"), "truth", "guess", "n").select("g.*", "truth", "guess", "n")
    summed = each.groupBy("attribute", "members", "truth", "guess").agg(F.sum("n").alias("n"))
    return summed.select("attribute", "members", F.array_join("members", JOIN_VALUES).alias("grp"), "truth", "guess", "n")


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def class_metrics(confusion: DataFrame) -> DataFrame:
    """One row a group and class: n, support, predicted, hits and one-vs-rest figures.

    A class is listed in the groups where it occurs, as truth or as guess. Empty denominators give 0.
    """
    sides = F.explode(F.array(
        F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("hits"),
                 F.col("n").alias("rows")),
        F.struct(F.col("guess").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("rows")),
    ))
    group = ["attribute", "members", "grp"]
    by_class = (
        confusion.select(*group, sides.alias("s")).select(*group, "s.*")
        .groupBy(*group, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    total = confusion.groupBy("attribute", "members").agg(F.sum("n").alias("n"))
    joined = by_class.join(total, ["attribute", "members"])
    n, support, predicted, hits = (F.col(c) for c in ("n", "support", "predicted", "hits"))
    return joined.select(
        *group, "class", "n", "support", "predicted", "hits",
        _rate(predicted, n).alias("selection_rate"), _rate(hits, predicted).alias("precision"),
        _rate(hits, support).alias("tpr"), _rate(predicted - hits, n - support).alias("fpr"),
        _rate(hits + n - support - predicted + hits, n).alias("accuracy"),
    )


def macro_metrics(metrics: DataFrame) -> DataFrame:
    """One row a group: share of right predictions, and means over its classes."""
    return metrics.groupBy("attribute", "members", "grp").agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("n_classes"),
        (F.sum("hits") / F.max("n")).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "tpr", "fpr")],
    )


def class_gaps(metrics: DataFrame, min_group_size: int = 30) -> DataFrame:
    """(attribute, class, n_groups, parity_difference, odds_difference, opportunity_difference).

    Differences between the groups of an attribute, for each class against the rest; groups of fewer
    than ``min_group_size`` rows are left out.
    """
    large = metrics.filter(F.col("n") >= min_group_size)

    def spread(name: str) -> Column:
        return F.max(name) - F.min(name)

    return large.groupBy("attribute", "class").agg(
        F.count(F.lit(1)).alias("n_groups"), spread("selection_rate").alias("parity_difference"),
        F.greatest(spread("tpr"), spread("fpr")).alias("odds_difference"), spread("tpr").alias("opportunity_difference"),
    )
