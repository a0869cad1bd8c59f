"""Fairness of binary predictions across single and intersecting groups.

The data is read once, into additive counts per combination of attribute
values. Every group, intersection and metric is computed from those counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import FairnessConfig
from plumbline.functions.columns import col

JOIN_NAMES = "_&_"
JOIN_VALUES = "_"
COUNTS = ("n", "predicted", "hits", "false_alarms", "positives")
METRICS = (
    "demographic_parity_ratio",
    "demographic_parity_difference",
    "equalized_odds_difference",
    "equal_opportunity_difference",
)


def attribute_sets(attributes: Sequence[str], depth: int) -> list[tuple[str, ...]]:
    """Single attributes first, then all combinations up to ``depth``."""
    return [
        members
        for size in range(1, min(len(attributes), max(depth, 1)) + 1)
        for members in combinations(attributes, size)
    ]


def additive_counts(
    df: DataFrame, y_true: str, y_pred: str, attributes: Sequence[str]
) -> DataFrame:
    """Counts per combination of attribute values; ``invalid`` counts non-binary labels."""
    truth, guess = col(y_true).cast("int"), col(y_pred).cast("int")
    binary = F.coalesce(col(y_true).isin(0, 1) & col(y_pred).isin(0, 1), F.lit(False))
    keys = [
        F.coalesce(col(a).cast("string"), F.lit("nan")).alias(f"a{i}")
        for i, a in enumerate(attributes)
    ]
    return (
        df.select(*keys, truth.alias("t"), guess.alias("p"), binary.alias("ok"))
        .groupBy(*[f"a{i}" for i in range(len(attributes))])
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("p") == 1).alias("predicted"),
            F.count_if((F.col("p") == 1) & (F.col("t") == 1)).alias("hits"),
            F.count_if((F.col("p") == 1) & (F.col("t") == 0)).alias("false_alarms"),
            F.count_if(F.col("t") == 1).alias("positives"),
            F.count_if(~F.col("ok")).alias("invalid"),
        )
    )


def dataset_info(counts: DataFrame) -> DataFrame:
    """One row describing the audited predictions."""
    total, positive = F.sum("n"), F.sum("positives")
    return counts.agg(
        total.alias("total_samples"),
        positive.alias("positive_count"),
        (total - positive).alias("negative_count"),
        F.try_divide(positive, total).alias("positive_rate"),
        F.try_divide(F.sum("predicted"), total).alias("prediction_positive_rate"),
    )


def group_counts(counts: DataFrame, attributes: Sequence[str], depth: int) -> DataFrame:
    """Roll additive counts up to every attribute and intersection.

    Rows are grouped by the separate values; the joined text is for display,
    so ("a_b", "c") and ("a", "b_c") stay different groups.
    """
    sets = dict(enumerate(attribute_sets(attributes, depth)))
    return counts_of_sets(counts, attributes, sets).select("attribute", "set_number", "grp", *COUNTS)


def counts_of_sets(
    counts: DataFrame, attributes: Sequence[str], sets: Mapping[int, Sequence[str]]
) -> DataFrame:
    """The same for chosen attribute sets by number; keeps the values a0.., null outside the set."""
    keys = {a: f"a{i}" for i, a in enumerate(attributes)}
    width = len(attributes)
    label, order = [], []
    for number, members in sets.items():
        # Bit i (from the left) of grouping_id() is set when column i is rolled up.
        bits = sum(1 << (width - 1 - i) for i, a in enumerate(attributes) if a not in members)
        label += [F.lit(bits).cast("bigint"), F.lit(JOIN_NAMES.join(members))]
        order += [F.lit(bits).cast("bigint"), F.lit(number)]
    rolled = counts.groupingSets(
        [[F.col(keys[a]) for a in members] for members in sets.values()],
        *[F.col(keys[a]) for a in attributes],
    ).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping_id().alias("set_bits"))
    grouped = F.col("set_bits").cast("bigint")
    return rolled.select(
        F.element_at(F.create_map(*label), grouped).alias("attribute"),
        F.element_at(F.create_map(*order), grouped).alias("set_number"),
        F.concat_ws(JOIN_VALUES, *[F.col(keys[a]) for a in attributes]).alias("grp"),
        *keys.values(),
        *COUNTS,
    )


def group_metrics(groups: DataFrame, custom: Mapping[str, Column] | None = None) -> DataFrame:
    """Rates of each group; an empty denominator gives 0.

    ``custom`` maps further metric names to expressions over the counts
    ``n, predicted, hits, false_alarms, positives``. These determine any metric of
    two unweighted binary vectors.
    """
    n, predicted, hits = F.col("n"), F.col("predicted"), F.col("hits")
    false_alarms, positives = F.col("false_alarms"), F.col("positives")
    negatives = n - positives

    def rate(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return groups.select(
        "attribute",
        F.contains("attribute", F.lit(JOIN_NAMES)).alias("is_intersection"),
        "set_number",
        "grp",
        "n",
        rate(predicted, n).alias("selection_rate"),
        rate(hits + negatives - false_alarms, n).alias("accuracy"),
        rate(hits, predicted).alias("precision"),
        rate(hits, positives).alias("recall"),
        rate(hits, positives).alias("tpr"),
        rate(false_alarms, negatives).alias("fpr"),
        *[expression.alias(name) for name, expression in (custom or {}).items()],
    )


def small_groups(metrics: DataFrame, config: FairnessConfig) -> DataFrame:
    """Groups too small to be listed."""
    return metrics.filter(F.col("n") < config.min_group_size).select("attribute", "grp", "n")


def retained_groups(metrics: DataFrame, config: FairnessConfig) -> DataFrame:
    """Groups large enough to be listed, of attributes with at least two of them.

    Attributes are few (all combinations up to the depth), so the set of
    attributes to keep is small whatever the number of groups.
    """
    large = metrics.filter(F.col("n") >= config.min_group_size)
    kept = large.groupBy("attribute").count().filter("count >= 2").select("attribute")
    return large.join(kept, "attribute", "left_semi")


def attribute_summary(metrics: DataFrame, config: FairnessConfig) -> DataFrame:
    """One row per attribute with the four fairness figures and the extreme groups.

    Parity and odds cover all groups, small ones included, unless the config
    says "strict"; equal opportunity covers the retained groups only.
    """
    if config.small_groups not in ("as_coded", "strict"):
        raise ValueError(f"small_groups must be 'as_coded' or 'strict', not {config.small_groups!r}")
    large = F.col("n") >= config.min_group_size
    counted = large if config.small_groups == "strict" else F.lit(True)

    def over(condition: Column, name: str) -> Column:
        return F.when(condition, F.col(name))

    def spread(condition: Column, name: str) -> Column:
        return F.max(over(condition, name)) - F.min(over(condition, name))

    # Listed rates carry four decimals; extremes and the threshold test use those.
    rate, tpr = F.bround("selection_rate", 4), F.bround("tpr", 4)
    listed_tpr = F.when(large, tpr)

    def first_group(ordering: Column) -> Column:
        return F.min_by(over(large, "grp"), F.when(large, F.struct(ordering, F.col("grp"))))

    return (
        metrics.groupBy("attribute", "is_intersection", "set_number")
        .agg(
            F.count(F.lit(1)).alias("n_groups"),
            F.count_if(large).alias("n_retained"),
            F.try_divide(
                F.min(over(counted, "selection_rate")), F.max(over(counted, "selection_rate"))
            ).alias("demographic_parity_ratio"),
            spread(counted, "selection_rate").alias("demographic_parity_difference"),
            F.greatest(spread(counted, "tpr"), spread(counted, "fpr")).alias(
                "equalized_odds_difference"
            ),
            spread(large, "tpr").alias("equal_opportunity_difference"),
            F.bround(F.max(listed_tpr) - F.min(listed_tpr), 4).alias("listed_opportunity"),
            first_group(rate).alias("lowest_rate_group"),
            first_group(-rate).alias("highest_rate_group"),
            first_group(tpr).alias("lowest_tpr_group"),
        )
        .filter("n_retained >= 2")
    )


def attribute_metrics(summary: DataFrame, config: FairnessConfig) -> DataFrame:
    """Long form: one row per attribute and metric, with its threshold and pass/fail."""
    low, high = config.demographic_parity_ratio_min, config.demographic_parity_ratio_max
    ratio = F.col("demographic_parity_ratio")
    tested = {
        "demographic_parity_ratio": ratio,
        "demographic_parity_difference": F.abs("demographic_parity_difference"),
        "equalized_odds_difference": F.col("equalized_odds_difference"),
        "equal_opportunity_difference": F.col("listed_opportunity"),
    }
    limit = {
        "demographic_parity_ratio": F.when(ratio > high, high).otherwise(low),
        "demographic_parity_difference": F.lit(config.demographic_parity_diff_threshold),
        "equalized_odds_difference": F.lit(config.equalized_odds_threshold),
        "equal_opportunity_difference": F.lit(config.equal_opportunity_threshold),
    }
    cells = []
    for number, metric in enumerate(METRICS):
        broken = (
            (ratio < low) | (ratio > high)
            if metric == "demographic_parity_ratio"
            else tested[metric] > limit[metric]
        )
        status = F.when(F.coalesce(broken, F.lit(False)), "fail").otherwise("pass")
        cells += [F.lit(number), F.lit(metric), F.col(metric), limit[metric], status]
    return summary.select(
        "attribute",
        "is_intersection",
        "set_number",
        "lowest_rate_group",
        "highest_rate_group",
        "lowest_tpr_group",
        F.stack(F.lit(len(METRICS)), *cells).alias(
            "metric_number", "metric", "value", "threshold", "status"
        ),
    )


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def interpretation(config: FairnessConfig) -> Column:
    """One sentence per violation. The wording of the sentences."""
    label = config.positive_outcome_label.replace("%", "%%")
    value = F.col("value")
    return (
        F.when(
            F.col("metric") == "demographic_parity_ratio",
            F.format_string(
                f"%s patients flagged as {label} %.0f%% less often than %s patients",
                title_case(F.col("lowest_rate_group")), (1 - value) * 100,
                F.col("highest_rate_group"),
            ),
        )
        .when(
            F.col("metric") == "demographic_parity_difference",
            F.format_string(
                "Prediction rate differs by %.1f%% across %s groups; "
                "%s patients may be under-identified",
                F.abs(value) * 100, F.col("attribute"), F.col("lowest_rate_group"),
            ),
        )
        .when(
            F.col("metric") == "equalized_odds_difference",
            F.format_string(
                "Model accuracy differs by %.1f%% across %s groups; TPR and/or FPR are unequal",
                value * 100, F.col("attribute"),
            ),
        )
        .otherwise(
            F.format_string(
                f"Model misses %.0f%% more actual {label} cases in %s patients "
                "(lower sensitivity)",
                value * 100, F.col("lowest_tpr_group"),
            )
        )
    )


def violations(metrics: DataFrame, config: FairnessConfig) -> DataFrame:
    """Failed metrics with severity and interpretation."""
    size = F.when(
        F.col("metric") == "demographic_parity_ratio", F.abs(F.col("value") - F.col("threshold"))
    ).otherwise(F.abs(F.col("value")))
    severity = (
        F.when(size > config.severity_high, "HIGH")
        .when(size > config.severity_medium, "MEDIUM")
        .otherwise("LOW")
    )
    return metrics.filter("status = 'fail'").select(
        "metric",
        "attribute",
        "value",
        "threshold",
        severity.alias("severity"),
        interpretation(config).alias("interpretation"),
        "is_intersection",
        "set_number",
        "metric_number",
        "lowest_rate_group",
        "lowest_tpr_group",
    )


def violation_groups(broken: DataFrame, retained: DataFrame) -> DataFrame:
    """The group values behind each violation, one row per group; any number of groups."""
    return broken.select("metric", "attribute").join(
        retained.select(
            "attribute", "grp", "n", F.col("selection_rate").alias("rate"), "tpr", "fpr"
        ),
        "attribute",
    )
