"""Windows that repeat somewhere in a corpus: what both kinds of substring removal share.

A text is a sequence of letters (bytes or words) and a window is a fixed number of them. The least
gram hash inside a window names it, and neighbouring windows of one name form a segment, so equal
windows always lie in segments of one name, wherever they stand. That gives

1. fingerprints: one row a segment, with its name and a hash of its content;
2. candidates: segments whose name occurs twice or more; all other windows are unique;
3. contents: equal segments become one row before any text moves, with two of the places they
   stand at, so that what a search knows to repeat it has seen twice; neighbours that are alone
   under their names and have both places in the same two documents move and are searched as one
   stretch, which spares the text in which their windows overlap;
4. search: the segments of a name meet in a task, which finds their equal windows exactly; a name
   with more text than a task should hold is dealt out by content, and windows still open are
   compared between its shares by hash;
5. marks: found windows return to every place their segment stands.

Step 4 is the operators' own; they pass a function for it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.storage import pin
from plumbline.llm.tables import by_batch
from plumbline.llm.texts import CHUNK_BYTES, Words, bytes_prefix, chunks, ranges, windows

#: Text that one search works on at once, and that a name may have before it is dealt out.
SEARCH_BYTES = 2 << 20
#: Text of a search task, which works on it piece by piece.
TASK_BYTES = 8 << 20
#: Windows of neighbouring segments that are searched as one stretch.
STRETCH = 1 << 13
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Kind:
    """What a letter is and how many make a window; the gram that names windows is shorter."""

    words: bool
    window: int
    gram: int


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` neighbours."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    filled = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    filled[: len(values)] = values
    blocks = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def segments(offsets: np.ndarray, data: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """Document, start, windows, name, content hash and weight of each segment of a chunk."""
    if kind.words:
        words = Words(offsets, data)
        sums, first, doc = words.chain(), words.first, words.doc
    else:
        sums, first = bytes_prefix(data), offsets
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    grams = windows(sums, kind.gram)
    # Ordered by the upper half of the hash, then from the left: what is least depends on content only.
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    at = (least_in_windows(keys, kind.window - kind.gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    count = len(at)
    if not count:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    name = grams[at]
    doc = doc[:count]
    inside = np.arange(count) + kind.window <= first[doc + 1]
    cut = np.ones(count, bool)
    cut[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(cut & inside)
    stops = np.flatnonzero(np.append(cut | ~inside, True))
    end = stops[np.searchsorted(stops, start, "right")]
    content = ranges(sums, start, end + kind.window - 1)
    owner = doc[start]
    # A segment in which the least gram stands twice may repeat itself.
    moves = np.concatenate(([0], np.cumsum(at[1:] != at[:-1])))
    weight = 1 + (moves[end - 1] > moves[start])
    return owner, start - first[owner], end - start, name[start].view(np.int64), content.view(np.int64), weight


def _fingerprints(docs: DataFrame, kind: Kind) -> DataFrame:
    """One row a segment; docs has doc_id, text_hash, text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, end, offsets, data in chunks(batch):
            doc, start, count, name, content, weight = segments(offsets, data, kind)
            owner = pa.array(doc + first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(start.astype(np.int32)),
                 pa.array(count.astype(np.int32)), pa.array(name), pa.array(content),
                 pa.array(weight.astype(np.int32))],
                ["doc_id", "text_hash", "start", "n", "name", "content", "weight"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs, run, f"doc_id {key}, text_hash long, start int, n int, name long, content long, weight int")


def stretches(parts: list[dict]) -> list[list[dict]]:
    """Wanted segments of one document; those of one chain and copy that follow each other stand together.

    Both copies of a chain lie at one distance in all segments, so they are cut alike.
    """
    out = [[part] for part in parts if part["chain"] is None]
    chained = [part for part in parts if part["chain"] is not None]
    last: list[dict] = []
    for part in sorted(chained, key=lambda p: (p["chain"], p["copy"], p["start"])):
        end = part["start"] + part["n"]
        if (
            last
            and (last[-1]["chain"], last[-1]["copy"]) == (part["chain"], part["copy"])
            and last[-1]["start"] + last[-1]["n"] == part["start"]
            and end - last[0]["start"] <= STRETCH
        ):
            last.append(part)
        else:
            last = [part]
            out.append(last)
    return out


def _cut_out(docs: DataFrame, wanted: DataFrame, kind: Kind) -> DataFrame:
    """Text of the wanted standing places of each content, a row a stretch of them."""
    lists = wanted.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("start", "n", "name", "share", "content", "copy", "first", "chain")).alias("parts")
    )
    held = docs.alias("d").join(
        lists.hint("shuffle_hash").alias("w"),
        F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash")),
    )

    names = ["name", "share", "copy", "first", "names", "contents", "counts", "letters"]

    def cut(batch: pa.RecordBatch, done: set[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        size = 0

        def give() -> pa.RecordBatch:
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), longs, longs, ints, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

        for cell, parts in zip(batch.column(0), batch.column(1)):
            # A place is wanted from one document; rows equal to one that is done would give it again.
            mark = tuple(parts[0][c].as_py() for c in ("name", "content", "copy"))
            if mark in done:
                continue
            done.add(mark)
            data = (cell.as_py() or "").encode()
            if kind.words:
                data = data.split()
            for stretch in stretches(parts.as_py()):
                head, tail = stretch[0], stretch[-1]
                letters = data[head["start"] : tail["start"] + tail["n"] + kind.window - 1]
                letters = b" ".join(letters) if kind.words else letters
                members = ([part[c] for part in stretch] for c in ("name", "content", "n"))
                for column, value in zip(out, (*(head[c] for c in names[:4]), *members, letters)):
                    column.append(value)
                size += len(letters)
            if size > CHUNK_BYTES:
                yield give()
                out, size = [[] for _ in names], 0
        if out[0]:
            yield give()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int, int]] = set()
        for batch in batches:
            yield from cut(batch, done)

    schema = (
        "name long, share int, copy int, first long, names array<long>, contents array<long>, counts array<int>, "
        "letters binary"
    )
    return held.select("d.text", "w.parts").mapInArrow(run, schema)


@dataclass
class Found:
    """Result of a search: marks by window over all segments, and windows to compare elsewhere."""

    marked: np.ndarray
    open_hash: np.ndarray  # two hashes of each window in ``open_at``
    open_at: np.ndarray


Search = Callable[[list[bytes], np.ndarray, np.ndarray], Found]


def _search_all(texts: DataFrame, tasks: int, search: Search) -> DataFrame:
    """Runs of marked windows of each content's copies, and open windows of dealt-out names."""
    schema = (
        "name long, share int, content long, copy int, first long, starts array<int>, lengths array<int>, "
        "open_at array<int>, open_1 array<long>, open_2 array<long>"
    )

    def work(rows: list[tuple]) -> pa.RecordBatch | None:
        if not rows:
            return None
        _, shares, copies, firsts, names, contents, counts, letters = zip(*rows)
        totals = np.array([sum(c) for c in counts], np.int64)
        found = search(list(letters), totals, np.array(firsts, np.int64))
        # From here on by segment: those of a stretch lie side by side, as their windows do.
        members = [len(c) for c in counts]
        shares, copies, firsts = (np.repeat(np.array(c, np.int64), members) for c in (shares, copies, firsts))
        names, contents, counts = (np.fromiter(itertools.chain.from_iterable(c), np.int64) for c in (names, contents, counts))
        base = np.concatenate(([0], np.cumsum(counts)))
        owner = np.repeat(np.arange(len(counts)), counts)
        marked = found.marked
        begin = marked.copy()
        begin[1:] &= ~(marked[:-1] & (owner[1:] == owner[:-1]))
        stop = marked.copy()
        stop[:-1] &= ~(marked[1:] & (owner[1:] == owner[:-1]))
        begin, stop = np.flatnonzero(begin), np.flatnonzero(stop)
        of = owner[begin]
        runs = np.searchsorted(of, np.arange(len(counts) + 1))
        dealt = shares > 0
        keep = dealt[owner[found.open_at]]
        at, hashes = found.open_at[keep], found.open_hash[:, keep]
        opened = np.searchsorted(owner[at], np.arange(len(counts) + 1))
        lists = lambda ends, values, to: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(to)))
        return pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array(shares.astype(np.int32)), pa.array(contents),
             pa.array(copies.astype(np.int32)), pa.array(firsts), lists(runs, begin - base[of], np.int32),
             lists(runs, stop - begin + 1, np.int32), lists(opened, at - base[owner[at]], np.int32),
             lists(opened, hashes[0], np.int64), lists(opened, hashes[1], np.int64)],
            [c.split()[0] for c in schema.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = {}, 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if size > SEARCH_BYTES and row[:2] != last:
                    yield work(list(rows.values()))
                    rows, size = {}, 0
                last = row[:2]
                # Equal rows in several tasks hand in their parts once each.
                if rows.setdefault((*row[:3], row[5][0]), row) is row:
                    size += len(row[7])
        if rows:
            yield work(list(rows.values()))

    return texts.repartition(tasks, "name", "share").sortWithinPartitions("name", "share").mapInArrow(run, schema)


def marked_runs(
    docs: DataFrame, kind: Kind, search: Search, ordered: bool, share_bytes: int = SEARCH_BYTES
) -> DataFrame:
    """Runs of repeated windows by document: doc_id, text_hash, runs (array of start and length).

    ``docs`` has doc_id, text_hash, text. With ``ordered`` a window counts only where a document of
    smaller doc_id holds it too, else wherever it stands twice. Documents without such windows have
    no row. Rows equal in doc_id and text are one document here; without ``ordered`` all windows of
    such a document count as repeated.
    """
    stands = pin(_fingerprints(docs, kind))
    often = stands.groupBy("name").agg(F.sum("weight").alias("times")).where("times > 1").select("name")
    # Stored on its own, so that adaptive execution can split the rows of a frequent name.
    stands = pin(stands.join(pin(often), "name", "left_semi"))

    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) if ordered else F.lit(0).cast("long")
    letter = 8 if kind.words else 1
    place = F.struct("doc_id", "text_hash", "start")
    contents = pin(
        stands.withColumn("own", order)
        .groupBy("name", "content")
        .agg(
            F.count("*").alias("times"), F.min("own").alias("first"), F.max("own").alias("last"), F.first("n").alias("n"),
            F.min(place).alias("one"), F.max(place).alias("two"),
        )
    )
    # Copy 0 stands for the smallest document that holds a content, copy 1 for all later ones.
    twice = F.col("last") > F.col("first") if ordered else F.col("times") > 1
    copies = [
        F.struct(F.lit(i).alias("copy"), F.col(own).alias("first"), f"{at}.doc_id", f"{at}.text_hash", f"{at}.start")
        for i, own, at in ((0, "first", "one"), (1, "last", "two"))
    ]
    names = contents.groupBy("name").agg(
        F.sum((F.col("n") + kind.window) * F.when(twice, 2).otherwise(1)).alias("letters"), F.count("*").alias("kinds")
    )
    # Share 0 is a name that one task searches whole; others are dealt out as shares 1, 2, ...
    shares = F.expr(f"ceil(letters * {letter} / {share_bytes})")
    alone = F.col("kinds") == 1
    dealt = F.when(alone | (shares <= 1), 0).otherwise(F.pmod(F.xxhash64("content"), shares) + 1)
    # No other segment holds a window of a content that is alone: it needs only its own second place.
    chain = F.xxhash64(
        "one.doc_id", "one.text_hash", "two.doc_id", "two.text_hash", F.expr("two.start - one.start"), "first", "last"
    )
    wanted = (
        contents.join(names, "name")
        .select(
            "name", "content", "n", dealt.cast("int").alias("share"), F.when(alone & twice, chain).alias("chain"),
            F.explode(F.when(twice, F.array(*copies)).otherwise(F.array(copies[0]))).alias("c"),
        )
        .select("name", "content", "n", "share", "chain", "c.*")
    )
    total = names.agg(F.sum("letters")).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total * letter // TASK_BYTES))
    found = pin(_search_all(_cut_out(docs, wanted, kind), int(tasks), search))

    # Between the shares of a dealt-out name.
    opened = found.where("share > 0").select(
        "name", "content", "copy", "first", F.explode(F.arrays_zip("open_at", "open_1", "open_2")).alias("o")
    ).select("name", "content", "copy", "first", "o.*")
    met = opened.groupBy("name", "open_1", "open_2").agg(
        F.count("*").alias("times"), F.min("first").alias("least")
    )
    repeated = F.col("least") < F.col("first") if ordered else F.col("times") > 1
    across = opened.join(met, ["name", "open_1", "open_2"]).where(repeated).select(
        "name", "content", "copy", F.array(F.struct(F.col("open_at").alias("start"), F.lit(1).alias("length"))).alias("runs")
    )
    inside = found.select(
        "name", "content", "copy",
        F.expr("transform(arrays_zip(starts, lengths), x -> struct(x.starts as start, x.lengths as length))").alias("runs"),
    ).where("size(runs) > 0")
    # One row a content: the runs of either copy.
    by_copy = [
        F.flatten(F.collect_list(F.when(F.col("copy") == i, F.col("runs")))).alias(f"runs_{i}") for i in (0, 1)
    ]
    known = pin(
        inside.union(across)
        .groupBy("name", "content")
        .agg(*by_copy)
        .join(contents.select("name", "content", "first"), ["name", "content"])
    )
    later: Column = F.col("own") > F.col("first") if ordered else F.lit(False)
    marks = (
        stands.withColumn("own", order)
        .join(known, ["name", "content"])
        .withColumn("runs", F.when(later, F.col("runs_1")).otherwise(F.col("runs_0")))
        .where("size(runs) > 0")
        .select(
            "doc_id", "text_hash",
            F.expr("transform(runs, x -> struct(cast(x.start + start as int) as start, x.length as length))").alias("runs"),
        )
    )
    # A set: rows equal in key and text give the same runs, which tasks merge before they send them.
    return marks.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("runs")).alias("runs"))


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """All columns of docs, and the runs found in each (null: none)."""
    joined = docs.alias("d").join(
        runs.hint("shuffle_hash").alias("r"),
        F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.text_hash") == F.col("r.text_hash")),
        "left",
    )
    return joined.select("d.*", "r.runs")


def identified(df: DataFrame, key: str, text: str, *others: str) -> DataFrame:
    """doc_id, text_hash, text and other columns as o0, o1, ...; a null text is empty."""
    cells = F.coalesce(df[text].cast("string"), F.lit(""))
    return df.select(
        df[key].alias("doc_id"), F.xxhash64(cells).alias("text_hash"), cells.alias("text"),
        *[df[c].alias(f"o{i}") for i, c in enumerate(others)],
    )


def joined_spans(runs: list[dict] | None, window: int) -> list[tuple[int, int]]:
    """Stretches of letters that the windows of a document's runs cover."""
    spans: list[tuple[int, int]] = []
    for start, end in sorted((r["start"], r["start"] + r["length"] + window - 1) for r in runs or []):
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((start, end))
    return spans
