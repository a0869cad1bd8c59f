"""The first offending rows of each issue, in row order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import QualityConfig
from plumbline.functions.columns import RowKey, col, key_struct, key_text
from plumbline.functions.longform import STACK_WIDTH, stack
from plumbline.operators.checks import RowCheck

EVIDENCE_SCHEMA = (
    "issue_type string, column string, rank int, row_key string, value string, z_score double"
)


def issue_examples(
    df: DataFrame, row_key: RowKey, checks: Sequence[RowCheck], config: QualityConfig
) -> DataFrame:
    """EVIDENCE_SCHEMA rows: up to ``max_examples`` per issue.

    Rows without any issue are filtered out first. The rank limit is known to
    the optimizer and applied in each map task, so an issue that hits every
    row still sends only a few rows per task to the task that ranks it.
    """
    if not checks:
        return df.sparkSession.createDataFrame([], EVIDENCE_SCHEMA)
    no_score = F.lit(None).cast("double")
    parts = []
    for start in range(0, len(checks), STACK_WIDTH):
        batch = checks[start : start + STACK_WIDTH]
        entries = [
            [
                F.lit(c.issue_type),
                F.lit(c.column),
                F.coalesce(c.predicate, F.lit(False)),
                col(c.column).cast("string"),
                no_score if c.z_score is None else c.z_score,
            ]
            for c in batch
        ]
        keep = [key_struct(row_key).alias("__key"), key_text(row_key).alias("row_key")]
        hits = df.filter(reduce(or_, [c.predicate for c in batch]))
        parts.append(
            stack(hits, entries, ["issue_type", "column", "hit", "value", "z_score"], keep)
        )
    rank = F.row_number().over(Window.partitionBy("issue_type", "column").orderBy("__key"))
    fewer = (F.col("issue_type") != "TYPE_INCONSISTENCY") | (
        F.col("rank") <= config.type_check_examples
    )
    return (
        reduce(DataFrame.unionByName, parts)
        .filter("hit")
        .withColumn("rank", rank)
        .filter(F.col("rank") <= config.max_examples)
        .filter(fewer)
        .select(
            "issue_type", "column", F.col("rank").cast("int").alias("rank"),
            "row_key", "value", "z_score",
        )
    )
