"""Sharding by histogram sort.

The sort keys are byte strings of one width. Splitters are found without moving rows: every round
counts the exact sizes below a set of probe keys, partition by partition, and narrows the interval
around each wanted boundary, until the boundary meets the tolerance or no key lies between. Then
the rows move once, to the part their key falls in, and take their place there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.storage import pin
from plumbline.llm.tables import read

#: A boundary may miss its place by this share of a part.
TOLERANCE = 0.001
#: Probes for each boundary and round.
PROBES = 16
#: Parts of a shard are sorted on their own and hold about so many rows.
PART_ROWS = 200_000


def byte_key(*columns: tuple[Column, int]) -> Column:
    """Byte string that sorts as the given whole numbers do, nulls first; with each its bytes."""
    cells = []
    for column, width in columns:
        wide = F.hex(column.cast("long").bitwiseXOR(F.lit(-(1 << 63)))) if width == 8 else F.hex(column.cast("long"))
        number = F.lpad(wide, 2 * width, "0")
        cells.append(F.when(column.isNull(), F.lit("00" * (width + 1))).otherwise(F.concat(F.lit("01"), number)))
    return F.unhex(F.concat(*cells))


def _keys(column: pa.Array, width: int) -> np.ndarray:
    fixed = column.cast(pa.binary()).cast(pa.binary(width))
    data = fixed.buffers()[1]
    return np.frombuffer(data, f"S{width}", len(fixed), fixed.offset * width)


def _packed(numbers: Sequence[int], width: int) -> np.ndarray:
    return np.array([n.to_bytes(width, "big") for n in numbers], f"S{width}")


def counts_below(keyed: DataFrame, probes: Sequence[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and rows below each probe and, last, of all; ``keyed`` has sort_key and weight."""
    bounds = _packed(probes, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, rows = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            place = np.searchsorted(bounds, _keys(batch.column(0), width), "right")
            np.add.at(sizes, place, np.asarray(batch.column(1)))
            rows += np.bincount(place, minlength=len(rows))
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full), pa.array(sizes[full]), pa.array(rows[full])], ["place", "size", "rows"]
        )

    found = (
        keyed.select("sort_key", "weight")
        .mapInArrow(run, "place long, size long, rows long")
        .groupBy("place")
        .agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"))
        .collect()
    )
    size, count = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
    for place, a, b in found:
        size[place], count[place] = a, b
    return np.cumsum(size), np.cumsum(count)


@dataclass
class Boundary:
    """Interval of keys around a wanted boundary, with what lies below its ends."""

    wanted: float
    low: int
    high: int
    below_low: tuple[int, int]
    below_high: tuple[int, int]

    def best(self) -> tuple[int, int]:
        """Key nearest to the wanted place, and the rows below it."""
        if self.wanted - self.below_low[0] <= self.below_high[0] - self.wanted:
            return self.low, self.below_low[1]
        return self.high, self.below_high[1]

    def settled(self, tolerance: float) -> bool:
        miss = min(self.wanted - self.below_low[0], self.below_high[0] - self.wanted)
        return miss <= tolerance or self.high - self.low <= 1 or self.below_high[1] - self.below_low[1] <= 1


def splitters(keyed: DataFrame, parts: int, width: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Keys that cut the rows into parts of equal weight, each with the rows below it."""
    top = 1 << (8 * width)
    sizes, rows = counts_below(keyed, [0], width)
    total, count = int(sizes[-1]), int(rows[-1])
    wanted = [Boundary(total * i / parts, 0, top - 1, (0, 0), (total, count)) for i in range(1, parts)]
    allowed = tolerance * total / parts
    while open_ := [b for b in wanted if not b.settled(allowed)]:
        probes = sorted({b.low + (b.high - b.low) * i // (PROBES + 1) for b in open_ for i in range(1, PROBES + 1)})
        sizes, rows = counts_below(keyed, probes, width)
        for b in open_:
            for place in range(
                int(np.searchsorted(_packed(probes, width), _packed([b.low], width)[0], "right")), len(probes)
            ):
                probe, below = probes[place], (int(sizes[place]), int(rows[place]))
                if probe >= b.high:
                    break
                if below[0] <= b.wanted:
                    b.low, b.below_low = probe, below
                else:
                    b.high, b.below_high = probe, below
                    break
    return [b.best() for b in wanted]


def histogram_shards(
    df: DataFrame, sort_key: Column, width: int, size: Column, shards: int = 8, law: str = "bytes",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """All columns of df with ``shard`` (int) and ``slot`` (long, gapless from 0 in key order).

    ``sort_key`` is a byte string of ``width`` bytes; rows of equal keys are told apart by a number
    given when the rows are written out, so that any group can be cut. ``law`` is ``bytes`` (sizes
    of the shards as near as whole rows allow) or ``rows`` (as many rows, at most one apart).
    ``df`` is written out once to the shared checkpoint folder. Columns of df named shard or slot are
    replaced, all others come back, whatever their names. Empty tables give empty results.
    """
    if law not in ("bytes", "rows"):
        raise ValueError("law is bytes or rows")
    weight = F.coalesce(size.cast("long"), F.lit(0)) if law == "bytes" else F.lit(1).cast("long")
    # Carried under numbers, so that no name of df meets a helper's.
    payload = {f"o{i}": c for i, c in enumerate(c for c in df.columns if c.lower() not in ("shard", "slot"))}
    keyed = df.select(
        *[F.col(f"`{c}`").alias(o) for o, c in payload.items()], sort_key.alias("own_key"), weight.alias("weight")
    )
    keyed = pin(keyed.withColumn("tie", F.monotonically_increasing_id()))
    keyed = keyed.select(
        *payload, "weight",
        F.concat(F.col("own_key"), F.unhex(F.lpad(F.hex("tie"), 16, "0"))).alias("sort_key"),
    )
    width += 8
    rows = keyed.count()
    each = max(1, -(-rows // (shards * part_rows)))
    found = splitters(keyed, shards * each, width, TOLERANCE if law == "bytes" else 0)
    starts = [0, *(below for _, below in found)]
    bounds = _packed([key for key, _ in found], width)
    shard = np.arange(shards * each) // each
    before = np.array(starts, np.int64) - np.array(starts, np.int64)[shard * each]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        place = np.searchsorted(bounds, _keys(batch.column(batch.num_columns - 1), width), "right")
        extra = [pa.array(place.astype(np.int32)), pa.array(shard[place].astype(np.int32)), pa.array(before[place])]
        return pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "part", "shard", "before"])

    dealt = keyed.mapInArrow(
        lambda batches: (deal(b) for b in batches if b.num_rows), f"{kinds}, part int, shard int, before long"
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy("sort_key"))
    slot = (F.col("before") + place - 1).alias("slot")
    return dealt.select(*[F.col(o).alias(c) for o, c in payload.items()], "shard", slot)


def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes, equal texts next to each other."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
    )
    key = byte_key((F.col("text_crc32"), 4), (F.col("doc_id"), 8))
    return histogram_shards(docs, key, 14, F.col("size")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op10_histogram_shards": (op10_histogram_shards, None)}
