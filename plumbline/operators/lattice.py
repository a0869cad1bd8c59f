"""Intersections level by level, without those that show nothing new.

Attribute sets form a lattice. A set is looked at only if all its subsets of one attribute less were
kept. It is kept if one of its groups is large enough and has a rate outside the range of the rates
of that group's parents (the same values with one attribute left out), by more than a tolerance.
Groups only shrink from level to level, so a set without a large group has none below it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import FairnessConfig
from plumbline.functions.storage import pin
from plumbline.operators.groups import (
    COUNTS, JOIN_NAMES, attribute_sets, counts_of_sets, group_metrics,
)

RATES = ("selection_rate", "tpr", "fpr")


@dataclass(frozen=True)
class SetFacts:
    """What an attribute set looked at has shown."""

    number: int
    attribute: str
    n_groups: int
    n_retained: int
    n_changed: int
    kept: bool


def _with_rates(level: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of groups with their rates."""
    measured = group_metrics(level, {k: F.col(k) for k in (*keys, *COUNTS[1:])})
    return measured.select("set_number", "attribute", "grp", *keys, *COUNTS, *RATES)


def _surprising(
    level: DataFrame, above: DataFrame, sets: Mapping[int, tuple[str, ...]],
    numbers: Mapping[tuple[str, ...], int], keys: Mapping[str, str], config: FairnessConfig,
) -> DataFrame:
    """(set_number, n_changed): large groups with a rate beyond those of their parents."""
    links = [
        (number, numbers[tuple(m for m in members if m != out)], keys[out])
        for number, members in sets.items()
        for out in members
    ]
    parents = level.sparkSession.createDataFrame(links, "set_number bigint, parent bigint, dropped string")
    wide = {k: F.when(F.col("dropped") == k, None).otherwise(F.col(k)).alias(f"p_{k}") for k in keys.values()}
    large = level.filter(F.col("n") >= config.min_group_size)
    asked = large.join(parents, "set_number").select("set_number", "parent", *keys.values(), *wide.values(), *RATES)
    given = above.select(
        F.col("set_number").alias("g_set"), *[F.col(k).alias(f"g_{k}") for k in keys.values()],
        *[F.col(r).alias(f"g_{r}") for r in RATES],
    )
    same: Column = reduce(
        lambda a, b: a & b,
        [F.col(f"p_{k}").eqNullSafe(F.col(f"g_{k}")) for k in keys.values()],
        F.col("parent") == F.col("g_set"),
    )
    ranges = asked.join(given, same).groupBy("set_number", *keys.values(), *RATES).agg(
        *[F.min(f"g_{r}").alias(f"lo_{r}") for r in RATES], *[F.max(f"g_{r}").alias(f"hi_{r}") for r in RATES]
    )
    slack = config.intersection_tolerance or 0.0
    outside = reduce(
        lambda a, b: a | b,
        [(F.col(r) < F.col(f"lo_{r}") - slack) | (F.col(r) > F.col(f"hi_{r}") + slack) for r in RATES],
    )
    return ranges.groupBy("set_number").agg(F.count_if(outside).alias("n_changed"))


def pruned_counts(
    counts: DataFrame, attributes: Sequence[str], config: FairnessConfig
) -> tuple[DataFrame, list[SetFacts]]:
    """Groups of the kept sets, as ``groups.group_counts`` returns them, and the facts of all looked at.

    Each level is one roll-up of the additive counts over its candidates only. The facts, a row an
    attribute set, decide on the driver.
    """
    keys = {a: f"a{i}" for i, a in enumerate(attributes)}
    every = attribute_sets(attributes, config.max_intersection_depth)
    numbers = {members: number for number, members in enumerate(every)}
    open_sets: set[tuple[str, ...]] = set()
    above, kept_levels, facts = None, [], []
    for size in range(1, max(map(len, every)) + 1):
        sets = {
            number: members
            for number, members in enumerate(every)
            if len(members) == size
            and (size == 1 or all(parent in open_sets for parent in combinations(members, size - 1)))
        }
        if not sets:
            break
        level = pin(_with_rates(counts_of_sets(counts, attributes, sets), list(keys.values())))
        shown = level.groupBy("set_number").agg(
            F.count(F.lit(1)).alias("n_groups"),
            F.count_if(F.col("n") >= config.min_group_size).alias("n_retained"),
        )
        if size > 1:
            shown = shown.join(_surprising(level, above, sets, numbers, keys, config), "set_number", "left")
        else:
            shown = shown.withColumn("n_changed", F.col("n_retained"))
        kept = []
        for row in shown.orderBy("set_number").collect():
            changed = row["n_changed"] or 0
            keeps = size == 1 or changed > 0
            members = sets[row["set_number"]]
            facts.append(SetFacts(row["set_number"], JOIN_NAMES.join(members), row["n_groups"], row["n_retained"], changed, keeps))
            if keeps:
                kept.append(row["set_number"])
            if keeps and row["n_retained"]:
                open_sets.add(members)
        kept_levels.append(level.filter(F.col("set_number").isin(kept)))
        above = level
    together = reduce(DataFrame.unionByName, kept_levels)
    return together.select("attribute", "set_number", "grp", *COUNTS), facts
