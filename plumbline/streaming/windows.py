"""Fairness and completeness of a stream of decisions, counted by event time.

The state of a window and group is a handful of counts that add up, so the stream keeps one row for
each until the watermark has passed the window. Every micro-batch writes the rows it has changed
under its own number; a batch that is run again after a failure replaces what it wrote before, and
the newest version of a row is the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col, quoted
from plumbline.operators.groups import COUNTS


@dataclass(frozen=True)
class WindowPlan:
    """What is counted by window: predictions by the values of ``attributes``, gaps by column.

    A row is late, and dropped, if its window ended at or before the watermark: the latest time seen
    less ``lateness``, as it stood one micro-batch ago. Rows within ``lateness`` always count, so what
    is late by more than a micro-batch is dropped however the files fall into micro-batches.
    """

    time: str
    y_true: str
    y_pred: str
    attributes: tuple[str, ...]
    columns: tuple[str, ...] = ()
    width: str = "1 day"
    lateness: str = "1 day"

    @property
    def keys(self) -> list[str]:
        return ["window_start", "attribute", "grp"]

    @property
    def gaps(self) -> list[str]:
        return [f"missing_{c}" for c in self.columns]


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _instant(time: str) -> Column:
    """Wall-clock time as the instant that shows it in UTC, whatever the session's zone."""
    since = f"CAST(CAST({quoted(time)} - {_EPOCH} AS INTERVAL SECOND) AS DECIMAL(20, 6))"
    return F.expr(f"timestamp_micros(CAST({since} * 1000000 AS BIGINT))")


def _wall_clock(instant: str) -> Column:
    return F.expr(f"{_EPOCH} + make_dt_interval(0, 0, 0, CAST(unix_micros({instant}) AS DECIMAL(20, 0)) / 1000000)")


def window_counts(events: DataFrame, plan: WindowPlan) -> DataFrame:
    """(window_start, attribute, grp, counts): additive counts, of a stream or of a table.

    Every attribute has rows of its own; a missing value is the group "nan". Rows without a time are
    in no window; labels other than 0 and 1 count in ``n`` only. Windows start at multiples of their
    width in UTC; times without a zone count as they are written.
    """
    zoneless = isinstance(events.schema[plan.time].dataType, T.TimestampNTZType)
    # Watermarks need an instant.
    events = events.withColumn(plan.time, _instant(plan.time)) if zoneless else events
    truth, guess = col(plan.y_true).cast("int"), col(plan.y_pred).cast("int")
    values = [
        F.struct(F.lit(a).alias("attribute"), F.coalesce(col(a).cast("string"), F.lit("nan")).alias("grp"))
        for a in plan.attributes
    ]
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    gaps = []
    for c, name in zip(plan.columns, plan.gaps):
        empty = col(c).isNull()
        if kinds[c] in ("double", "float"):
            empty = empty | F.isnan(col(c))
        gaps.append(empty.cast("long").alias(name))
    rows = (
        events.withWatermark(plan.time, plan.lateness)
        .select(col(plan.time).alias("at"), truth.alias("t"), guess.alias("p"), *gaps,
                F.explode(F.array(*values)).alias("g"))
        .select("at", "t", "p", *plan.gaps, "g.*")
    )
    start = _wall_clock("window.start") if zoneless else F.col("window.start")
    counted = rows.groupBy(F.window("at", plan.width).alias("window"), "attribute", "grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("p") == 1).alias("predicted"),
        F.count_if((F.col("p") == 1) & (F.col("t") == 1)).alias("hits"),
        F.count_if((F.col("p") == 1) & (F.col("t") == 0)).alias("false_alarms"),
        F.count_if(F.col("t") == 1).alias("positives"),
        *[F.sum(g).alias(g) for g in plan.gaps],
    )
    return counted.select(start.alias("window_start"), "attribute", "grp", *COUNTS, *plan.gaps)


def run_windows(events: DataFrame, plan: WindowPlan, folder: str) -> None:
    """Work off what the stream holds now and stop; a later call goes on where this one ended.

    ``folder`` takes the checkpoint and the versions of the changed rows, one folder a micro-batch.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/versions/batch={batch}")

    query = (
        window_counts(events, plan).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def windows_so_far(spark: SparkSession, plan: WindowPlan, folder: str) -> DataFrame:
    """The newest counts of every window and group, closed or still open."""
    counts = [*COUNTS, *plan.gaps]
    versions = spark.read.option("basePath", f"{folder}/versions").parquet(f"{folder}/versions")
    # The newest version is the only one of its batch, so the greatest struct is that row.
    newest = F.max_by(F.struct(*counts), "batch")
    return versions.groupBy(*plan.keys).agg(newest.alias("counts")).select(*plan.keys, "counts.*")


def stream_of(spark: SparkSession, path: str, like: DataFrame, files_at_once: int | None = None) -> DataFrame:
    """A Parquet folder, or what a pattern matches, as a stream with the columns of ``like``."""
    reader = spark.readStream.schema(like.schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(path)


def rates(counts: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """Selection rate, true and false positive rate, and missing rate of each of ``names``; 0 over 0 is 0."""

    def rate(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    n, positives = F.col("n"), F.col("positives")
    return counts.select(
        "window_start", "attribute", "grp", "n",
        rate(F.col("predicted"), n).alias("selection_rate"),
        rate(F.col("hits"), positives).alias("tpr"),
        rate(F.col("false_alarms"), n - positives).alias("fpr"),
        *[rate(F.col(f"missing_{c}"), n).alias(f"missing_{c}_rate") for c in names],
    )
