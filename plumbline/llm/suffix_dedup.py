"""Suffix-array dedup: remove bytes covered by long strings that stand twice or more.

Segments that may hold equal strings meet in one task (see ``repeats``). The task joins them to one
text, sorts its suffixes by induced sorting, and computes permuted common prefixes; a string
repeats exactly where the common prefix with a neighbour in the suffix array is long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.repeats import Found, Kind, identified, joined_spans, marked_runs, with_runs
from plumbline.llm.suffixes import permuted_common_prefixes, suffix_array
from plumbline.llm.tables import by_batch, read
from plumbline.llm.texts import bytes_prefix, windows

LENGTH = 400
#: Names of windows come from strings of this part of their length.
GRAM_SHARE = 0.32
#: Byte between segments; it occurs in no UTF-8 text.
BETWEEN = 0xFF


def search(length: int, letters: list[bytes], counts: np.ndarray, firsts: np.ndarray) -> Found:
    """Windows that stand twice in the segments; one of each kind stays open."""
    text = np.frombuffer(bytes([BETWEEN]).join(letters), np.uint8)
    order = suffix_array(text)
    before, shared = permuted_common_prefixes(text, order)
    again = shared >= length
    repeated = again.copy()
    repeated[before[again]] = True
    start = np.concatenate(([0], np.cumsum([len(x) + 1 for x in letters])))[:-1]
    place = np.repeat(start - np.concatenate(([0], np.cumsum(counts)))[:-1], counts) + np.arange(counts.sum())
    # Of equal windows, all but the first in the suffix array follow one they share enough with.
    single = np.flatnonzero(~again[place])
    sums = bytes_prefix(text)
    hashes = np.stack((windows(sums, length)[place[single]], windows(sums, length // 2)[place[single]]))
    return Found(repeated[place], hashes.view(np.int64), single)


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, share_bytes: int | None = None) -> DataFrame:
    """Every row's text without the bytes of strings of ``length`` bytes that stand elsewhere too.

    Strings lie within one text, are judged on the input and may overlap; the text counts as UTF-8
    (null: empty), so cuts may fall inside a character. Returns doc_id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept (binary), spans (array of start and end). Rows equal in key and
    text stand for each other, so all their strings of that length go. Keys may be null and may
    repeat; other columns are not read; an empty table gives an empty result.
    """
    docs = identified(df, key, text)
    kind = Kind(words=False, window=length, gram=max(1, int(length * GRAM_SHARE)))
    extra = {} if share_bytes is None else {"share_bytes": share_bytes}
    runs = marked_runs(docs, kind, lambda *segments: search(length, *segments), ordered=False, **extra)
    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, "
        "kept binary, spans array<struct<start:int,end:int>>"
    )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size, removed, number, kept, spans = [], [], [], [], []
        for cell, found in zip(batch.column(1), batch.column(2)):
            data = cell.as_py().encode()
            cut = joined_spans(found.as_py(), length)
            parts, at = [], 0
            for start, end in cut:
                parts.append(data[at:start])
                at = end
            parts.append(data[at:])
            kept.append(b"".join(parts))
            size.append(len(data))
            removed.append(len(data) - len(kept[-1]))
            number.append(len(cut))
            spans.append([{"start": a, "end": b} for a, b in cut])
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in (size, removed, number)),
             pa.array(kept, pa.binary()), pa.array(spans, kinds)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
        )

    return by_batch(with_runs(docs, runs).select("doc_id", "text", "runs"), run, schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document without its repeated strings of 400 bytes."""
    return dedup(read(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) as kept_sha256"
    )


QUERIES = {"op1_suffix_dedup": (op1_suffix_dedup, None)}
