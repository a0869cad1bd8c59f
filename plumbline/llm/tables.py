"""Tables the queries read, and the plumbing all operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_name(key: str, results: str) -> str:
    """Name of the key column in a result; one named like a column of the schema ``results`` gets ``key_`` before it."""
    taken = {c.split()[0].lower() for c in results.split(", ")}
    return f"key_{key}" if key.lower() in taken else key


def by_batch(
    df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Map Arrow batches one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)
