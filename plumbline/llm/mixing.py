"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents all get the same fractional number of copies, its target over its size. Pairs
of fractional documents exchange mass at random, words for words, until one of them is a whole
number; what is left over of each bucket meets the others' in the next level of a reduction tree.
Every draw is a hash of the document, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.storage import pin
from plumbline.llm.tables import by_batch, read
from plumbline.llm.texts import chunks, word_counts

#: Documents, and later left-overs, that one bucket of the reduction tree combines.
FAN_IN = 4096
MOST_COPIES = 2
WEIGHTS = (3, 1, 2)
SHARE = 1.5


def sizes_in_words(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``size``, the words ``[^\\x20\\x09-\\x0D]+`` of the text (null: 0)."""
    kinds = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, end, offsets, data in chunks(batch):
            kept = [batch.column(i).slice(first, end - first) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(word_counts(offsets, data))], [*(f"c{i}" for i in range(len(keep))), "size"]
            )

    frame = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(keep)], df[text].cast("string").alias("text"))
    return by_batch(frame, run, f"{kinds}, size long").toDF(*keep, "size")


def targets(sizes: Mapping[str | None, int]) -> dict[str | None, float]:
    """Words wanted of each source.

    Sources by code point, null last, weigh 3, 1, 2, repeating, and share 1.5 times all sizes; a
    target stops at twice its source's size, the excess is shared again until none is above.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {name: WEIGHTS[i % len(WEIGHTS)] for i, name in enumerate(names)}
    left, open_, out = SHARE * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[n] for n in open_)
        full = [n for n in open_ if left * weight[n] / total >= MOST_COPIES * sizes[n]]
        if not full:
            return out | {n: left * weight[n] / total for n in open_}
        out |= {n: float(MOST_COPIES * sizes[n]) for n in full}
        left -= sum(MOST_COPIES * sizes[n] for n in full)
        open_ = [n for n in open_ if n not in out]
    return out


def _spread(number: int) -> int:
    """64 bits that all depend on all of the number's."""
    number &= 0xFFFFFFFFFFFFFFFF
    number = ((number ^ (number >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    number = ((number ^ (number >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return number ^ (number >> 31)


def _uniform(draw: int) -> float:
    """A number in [0, 1) from 64 random bits."""
    return draw / 2.0**64


def exchange(x: float, size: int, y: float, other: int, luck: float) -> tuple[float, float]:
    """Move words between two fractional documents until one is 0 or 1; expectations stay."""
    up = min(1 - x, y * other / size)
    down = min(x, (1 - y) * other / size)
    if luck * (up + down) < down:
        return (1.0, y - up * size / other) if up == 1 - x else (x + up, 0.0)
    return (0.0, y + down * size / other) if down == x else (x - down, 1.0)


COLUMNS = "name {name}, draw long, source int, bucket int, size long, part double"


def _settle(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Walk buckets in order, carrying one fractional document; a bucket's last keeps its fraction."""
    group, carry = None, None

    def close(row: list) -> list:
        return [*row[:5], float(round(row[5]))] if last else row

    for batch in batches:
        out = []
        for row in map(list, zip(*(column.to_pylist() for column in batch.columns))):
            if (row[2], row[3]) != group:
                if carry is not None:
                    out.append(close(carry))
                group, carry = (row[2], row[3]), None
            if row[5] in (0.0, 1.0) or row[4] == 0:
                out.append([*row[:5], float(round(row[5]))])
            elif carry is None:
                carry = row
            else:
                luck = _uniform(_spread(row[1] * 31 + carry[1]))
                carry[5], row[5] = exchange(carry[5], carry[4], row[5], row[4], luck)
                if carry[5] in (0.0, 1.0):
                    carry, row = row, carry
                out.append(row)
                if carry[5] in (0.0, 1.0):
                    out.append(carry)
                    carry = None
        yield _batch(out, batch.schema)
        schema = batch.schema
    if carry is not None:
        yield _batch([close(carry)], schema)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema.names
    )


def _level(df: DataFrame, last: bool, schema: str) -> DataFrame:
    # Large documents first: they settle against many small ones, and what is left over is small.
    order = [F.col("source"), F.col("bucket"), F.desc("size"), F.col("draw"), F.col("name")]
    return (
        df.repartition("source", "bucket")
        .sortWithinPartitions(*order)
        .mapInArrow(lambda batches: _settle(batches, last), schema)
    )


def copies(sized: DataFrame, wanted: DataFrame, rows: int, name: str, seed: int = 17) -> DataFrame:
    """Each row's ``part``: 1.0 if it gets one copy more than its source gives to all, else 0.0.

    ``sized`` has doc_id, source, size and the column ``name`` that rows are known by; ``wanted``
    has one row a source with number, source, source_size, target. ``rows`` is the number of rows.
    """
    schema = COLUMNS.format(name=sized.schema[name].dataType.simpleString())
    buckets = max(1, -(-rows // FAN_IN))
    asked = sized.alias("d").join(wanted.alias("w"), F.col("d.source").eqNullSafe(F.col("w.source")))
    share = F.when(F.col("w.source_size") > 0, F.col("target") / F.col("w.source_size")).otherwise(0.0)
    level = asked.select(
        F.col(f"d.{name}").alias("name"), F.xxhash64("d.doc_id", "d.size", F.lit(seed)).alias("draw"),
        F.col("number").alias("source"), F.col("d.size").alias("size"), share.alias("share"),
    ).selectExpr(
        "name", "draw", "source", f"cast(pmod(draw, {buckets}) as int) as bucket", "size",
        "share - floor(share) as part",
    )
    done = None
    while True:
        settled = _level(level, buckets == 1, schema)
        if buckets > 1:
            settled = pin(settled)
        whole = settled.where("part in (0.0, 1.0)")
        done = whole if done is None else done.union(whole)
        if buckets == 1:
            return done
        level = settled.where("part not in (0.0, 1.0)").withColumn("bucket", (F.col("bucket") / FAN_IN).cast("int"))
        buckets = -(-buckets // FAN_IN)


def mix(
    df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", others: tuple[str, ...] = ()
) -> DataFrame:
    """Words taken of every document so that sources come near their target weights.

    Returns doc_id, source, size (words; null text: 0), source_size, target, copies, taken and the
    columns ``others``. A document is taken 0 to 2 times as a whole, never in part; a source's total
    misses its target by at most half the words of one document. Documents without words take part
    with 0. Rows are taken each on their own, so repeated rows may differ in copies; keys may be
    null; a null source is a source of its own; an empty table gives an empty result. One row a
    source, which has its target weight, passes the driver. With ``others`` the rows are written
    out once to number them.
    """
    spark = df.sparkSession
    carried = [c for c in others if c != text]
    named = df.select(
        df[key].alias("doc_id"), df[source].cast("string").alias("source"), df[text].alias("text"),
        *[df[c].alias(f"o{i}") for i, c in enumerate(carried)],
    )
    name = "doc_id"
    if others:
        named, name = pin(named.withColumn("row", F.monotonically_increasing_id())), "row"
    sized = pin(sizes_in_words(named, list(dict.fromkeys(["doc_id", "source", name]))))
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    size = {t["source"]: t["size"] for t in totals}
    rows = [(i, label, size[label], target) for i, (label, target) in enumerate(targets(size).items())]
    wanted = spark.createDataFrame(rows, "number int, source string, source_size long, target double")
    settled = copies(sized, wanted, sum(t["rows"] for t in totals), name)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    taken = (whole + F.col("d.part")).cast("int")
    mixed = (
        settled.alias("d")
        .join(wanted.alias("w"), F.col("d.source") == F.col("w.number"))
        .select(
            F.col("d.name").alias(name), F.col("w.source").alias("source"), F.col("d.size").alias("size"),
            "source_size", "target", taken.alias("copies"), (taken * F.col("d.size")).cast("long").alias("taken"),
        )
    )
    if others:
        mixed = named.drop("source").join(mixed.hint("shuffle_hash"), "row")
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken",
        *[F.col("text") if c == text else F.col(f"o{carried.index(c)}").alias(c) for c in others],
    )


def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


QUERIES = {"op4_pivotal_mix": (op4_pivotal_mix, None)}
