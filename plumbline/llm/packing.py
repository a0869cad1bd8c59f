"""Best-fit packing of tokenized documents with large-item matching.

Only the lengths of pieces decide how sequences are filled, and there are no more lengths than the
capacity. The plan is therefore made from a count by length: items above a third of the capacity
lie at most two to a sequence and are matched greedily, largest first with its largest partner;
smaller items then go to the tightest gap that holds them. The plan says, for each length, which
numbers of that length go where; pieces are numbered within their length by buckets, as many as
their number asks for, and look up their place. Texts and ids never move.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.storage import pin
from plumbline.llm.bpe import encoder
from plumbline.llm.tables import by_batch, read

CAPACITY = 2048
END_ID = 0
#: Pieces of one length are numbered in buckets of about so many, however many there are.
BUCKET_PIECES = 50_000


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first number, pieces, sequence, offset, run).

    Piece number i of a row (from 0) lies in sequence ``sequence + i // run`` at
    ``offset + (i % run) * length``. The rows are as many as there are kinds of filling, which does
    not grow with the pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    kinds: list[tuple[int, list[tuple[int, int]]]] = []  # sequences alike, and their (length, run)

    def largest_up_to(limit: int) -> int | None:
        at = bisect.bisect_right(large, limit) - 1
        return large[at] if at >= 0 else None

    def take(length: int, number: int) -> None:
        left[length] -= number
        if not left[length]:
            large.pop(bisect.bisect_left(large, length))

    while large:
        first = large[-1]
        other = largest_up_to(capacity - first)
        if other is None:
            number = left[first]
            kinds.append((number, [(first, 1)]))
        elif other == first:
            number = left[first] // 2
            if number:
                kinds.append((number, [(first, 2)]))
            if left[first] % 2:  # one without a twin: the largest other partner
                take(first, 2 * number) if number else None
                number = 1
                other = largest_up_to(min(capacity - first, first - 1))
                kinds.append((1, [(first, 1)] + ([(other, 1)] if other is not None else [])))
                if other is not None:
                    take(other, 1)
            else:
                number *= 2
        else:
            number = min(left[first], left[other])
            kinds.append((number, [(first, 1), (other, 1)]))
            take(other, number)
        take(first, number)

    # Gaps by size; each holds kinds of sequences that are filled alike.
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    sizes: list[int] = []

    def add(gap: int, kind: tuple[int, list[tuple[int, int]]]) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(sizes, gap)
        gaps[gap].append(kind)

    for number, items in kinds:
        add(capacity - sum(n * run for n, run in items), (number, items))
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        pieces = counts[length]
        while pieces:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                run = min(capacity // length, pieces)
                number = pieces // run
                add(capacity - run * length, (number, [(length, run)]))
                pieces -= number * run
                continue
            gap = sizes[at]
            number, items = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            run = min(gap // length, pieces)
            used = min(number, pieces // run)
            if used < number:
                add(gap, (number - used, items))
            add(gap - run * length, (used, [*items, (length, run)]))
            pieces -= used * run

    rows, numbered, sequence = [], dict.fromkeys(counts, 0), 0
    for gap in sizes:
        for number, items in gaps[gap]:
            offset = 0
            for length, run in items:
                rows.append((length, numbered[length], number * run, sequence, offset, run))
                numbered[length] += number * run
                offset += length * run
            sequence += number
    return sorted(rows)


def token_pieces(
    df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None,
    capacity: int = CAPACITY,
) -> DataFrame:
    """Tokenized documents, each with an end id, cut where they are longer than the capacity.

    Columns: doc_id, piece, start, length, ids_crc32. The first piece is the shorter one.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).text
        rows, piece, start, length, check = [], [], [], [], []
        for row, cell in enumerate(batch.column(1)):
            ids = encode(cell.as_py() or "") + END_ID.to_bytes(4, "little")
            size = len(ids) // 4
            begin, end = 0, size % capacity or capacity
            while begin < size:
                rows.append(row)
                piece.append(0 if not begin else piece[-1] + 1)
                start.append(begin)
                length.append(end - begin)
                check.append(zlib.crc32(ids[4 * begin : 4 * end]))
                begin, end = end, end + capacity
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
             *(pa.array(c, pa.int64()) for c in (start, length, check))],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    frame = df.select(df[key].alias("doc_id"), df[text].cast("string").alias("text"))
    return by_batch(frame, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length`` of 1 to ``capacity``.

    Every piece is placed; sequences are gapless from offset 0. Equal rows are placed each on their
    own, and no column but ``length`` decides a place, so keys may be null or repeat. The input is
    written out once to the shared checkpoint folder. Columns named sequence_id or offset are
    replaced, all others come back, whatever their names; an empty table gives an empty result. What
    passes the driver is one count a length and the plan made of it, both bounded by the capacity.
    """
    # Carried under numbers, so that no name of the input meets a helper's.
    payload = {
        f"o{i}": c for i, c in enumerate(c for c in pieces.columns if c.lower() not in ("sequence_id", "offset"))
    }
    held = pin(
        pieces.select(
            *[F.col(f"`{c}`").alias(o) for o, c in payload.items()], F.col("length").cast("long").alias("length"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    buckets = max(1, -(-held.count() // bucket_pieces))
    numbered = held.withColumn("bucket", F.expr(f"pmod(xxhash64(row), {buckets}L)"))
    by_bucket = numbered.groupBy("length", "bucket").agg(F.count("*").alias("pieces"))
    by_length = {r["length"]: r["pieces"] for r in by_bucket.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()}
    places = plan(by_length, capacity)
    lengths = np.array([p[0] for p in places], np.int64)
    firsts = np.array([p[1] for p in places], np.int64)
    target = np.array([p[3:] for p in places], np.int64).reshape(-1, 3)
    most = max(by_length.values(), default=0) + 1
    order = Window.partitionBy("length").orderBy("bucket")
    before = by_bucket.withColumn("before", F.sum("pieces").over(order) - F.col("pieces")).drop("pieces")
    inside = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = (
        numbered.withColumn("number", F.row_number().over(inside) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("number", F.col("number") + F.col("before"))
        .select(*payload, "length", "number")
    )
    keys = lengths.astype(object) * most + firsts if most * (capacity + 1) >= 1 << 63 else lengths * most + firsts
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    at_length, at_number = len(payload), len(payload) + 1

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        length = np.asarray(batch.column(at_length)).astype(np.int64)
        number = np.asarray(batch.column(at_number)).astype(np.int64)
        row = np.searchsorted(keys, length * most + number, "right") - 1
        sequence, offset, run = target[row].T if len(row) else np.zeros((3, 0), np.int64)
        number = number - firsts[row]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(sequence + number // np.maximum(run, 1)),
             pa.array(offset + number % np.maximum(run, 1) * length)],
            [*batch.schema.names, "sequence_id", "offset"],
        )

    placed = by_batch(ranked, place, f"{kinds}, sequence_id long, offset long")
    return placed.select(*[F.col(o).alias(c) for o, c in payload.items()], "sequence_id", "offset")


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Documents as pieces of at most 2048 tokens, packed into as few sequences as best fit finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are
    one piece that holds the end id alone. Repeated rows are packed each; keys may be null; other
    columns are not read; an empty table gives an empty result.
    """
    return pack(token_pieces(df, key, text, vocabulary))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op3_best_fit_packing": (op3_best_fit_packing, None)}
