"""Substring dedup with fixed-block anchors: remove passages that an earlier document holds too.

Segments that may hold equal windows meet in one task (see ``repeats``). There the non-overlapping
blocks of every segment are indexed as references, every rolling window of the block's length
probes the index, and hits are widened to the windows around them. Of equal ones the smallest
document's is the reference, and neighbouring windows with neighbouring references form the maximal
repeats, which are compared letter by letter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.repeats import Found, Kind, identified, joined_spans, marked_runs, with_runs
from plumbline.llm.tables import by_batch, read
from plumbline.llm.texts import Words, covered, windows

#: Words of a window; a block is half of it, so every window holds one block of any grid whole.
WINDOW = 50
#: Words of the grams that name windows.
GRAM = 8

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def search(window: int, letters: list[bytes], counts: np.ndarray, firsts: np.ndarray) -> Found:
    """Windows that a segment of smaller ``firsts`` holds too; all others stay open."""
    data = np.frombuffer(b"".join(letters), np.uint8)
    words = Words(np.concatenate(([0], np.cumsum([len(x) for x in letters]))).astype(np.int64), data)
    chain = words.chain()
    block = max(1, window // 2)
    order = firsts[words.doc]

    # Index the blocks of the grid, with the smallest document that holds each.
    place, hashes = words.grams(block)
    grid = (place - words.first[words.doc[place]]) % block == 0
    by_hash = np.lexsort((order[place[grid]], hashes[grid]))
    held, least = hashes[grid][by_hash], order[place[grid]][by_hash]
    new = np.ones(len(held), bool)
    new[1:] = held[1:] != held[:-1]
    held, least = held[new], least[new]

    # Probe with every rolling window; keep what a smaller document's block answers.
    at = np.minimum(np.searchsorted(held, hashes), max(len(held) - 1, 0))
    known = held[at] == hashes if len(held) else np.zeros(len(hashes), bool)
    answered = np.zeros(len(held), bool)
    answered[at[known & (order[place] > least[at])]] = True
    anchors = place[known & answered[at]] if len(held) else place[:0]

    # Windows around anchors, on either side, and the smallest document of equal ones.
    start = np.concatenate([np.arange(n) + words.first[i] for i, n in enumerate(counts)]) if len(counts) else place[:0]
    near = covered(len(words.start), np.maximum(anchors - (window - block), 0), window - block + 1)[start]
    wide = windows(chain, window)
    asked = start[near]
    ranked = asked[np.lexsort((asked, order[asked], wide[asked]))]
    leads = np.ones(len(ranked), bool)
    leads[1:] = wide[ranked[1:]] != wide[ranked[:-1]]
    lead = ranked[np.maximum.accumulate(np.where(leads, np.arange(len(ranked)), 0))]
    later = order[ranked] > order[lead]
    reference = np.full(len(words.start), -1, np.int64)
    reference[ranked[later]] = lead[later]
    _confirm(words, reference, window)

    marked = reference[start] >= 0
    opened = np.flatnonzero(~marked)
    half = windows(chain, block)
    return Found(marked, np.stack((wide[start[opened]], half[start[opened]])).view(np.int64), opened)


def _confirm(words: Words, reference: np.ndarray, window: int) -> None:
    """Compare each maximal repeat letter by letter; drop windows whose hash alone was equal."""
    hit = np.flatnonzero(reference >= 0)
    if not len(hit):
        return
    same = np.zeros(len(hit), bool)
    one, two = hit[1:], hit[:-1]
    same[1:] = (one == two + 1) & (reference[one] == reference[two] + 1) & (words.doc[one] == words.doc[two])
    same[1:] &= words.doc[reference[one]] == words.doc[reference[two]]
    first = np.flatnonzero(~same)
    last = np.append(first[1:], len(hit)) - 1
    data = words.data.tobytes()

    def equal(a: int, b: int, n: int) -> bool:
        return data[words.start[a] : words.end[a + n]] == data[words.start[b] : words.end[b + n]]

    for i, j in zip(hit[first].tolist(), hit[last].tolist()):
        if not equal(i, int(reference[i]), j - i + window - 1):
            for k in range(i, j + 1):
                if not equal(k, int(reference[k]), window - 1):
                    reference[k] = -1


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Text without the words of the spans and the white space after them."""
    starts = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    parts, at = [], 0
    for start, end in spans:
        parts.append(data[at : starts[start]])
        at = starts[end]
    return b"".join([*parts, data[at:]])


def dedup(
    df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
    share_bytes: int | None = None, others: tuple[str, ...] = (),
) -> DataFrame:
    """Every row's text without words in windows that a row of smaller key holds too.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows are judged on the input. Returns doc_id,
    n_words, n_removed, kept_sha256 (kept words joined by one blank, UTF-8), text (the rest of the
    text with its own white space, as given where nothing was removed) and the columns ``others``.
    The key is a whole number; null counts as larger than all, so rows without a key lose what any
    row with one holds and take nothing from others. Rows of equal keys take nothing from each
    other. Null and empty texts have no words; an empty table gives an empty result.
    """
    docs = identified(df, key, text, *others)
    kind = Kind(words=True, window=window, gram=min(gram, window))
    extra = {} if share_bytes is None else {"share_bytes": share_bytes}
    plain = docs.select("doc_id", "text_hash", "text")
    runs = marked_runs(plain, kind, lambda *segments: search(window, *segments), ordered=True, **extra)
    fields = ", ".join(f"o{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, "
        f"kept_sha256 string, text string{', ' if fields else ''}{fields}"
    )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        total, removed, digest, kept = [], [], [], []
        for cell, found in zip(batch.column(1), batch.column(2)):
            data = cell.as_py().encode()
            spans = joined_spans(found.as_py(), window)
            words = data.split()
            total.append(len(words))
            removed.append(sum(b - a for a, b in spans))
            if spans:
                data = _without(data, spans)
                words = data.split()
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            kept.append(data.decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(digest, pa.string()), pa.array(kept, pa.string()), *batch.columns[3:]],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "text", *(f"o{i}" for i in range(len(others)))],
        )

    joined = with_runs(docs, runs).select(
        "doc_id", "text", "runs", *[f"o{i}" for i in range(len(others))]
    )
    return by_batch(joined, run, schema).toDF("doc_id", "n_words", "n_removed", "kept_sha256", "text", *others)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document without passages of 50 words that an earlier one holds."""
    return dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
m AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
r AS (SELECT DISTINCT doc_id, j FROM (
  SELECT g.doc_id, unnest(range(g.i, g.i + 50)) AS j FROM g JOIN m ON g.h = m.h WHERE g.doc_id > m.first)),
k AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.j) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) p
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = p.doc_id AND r.j = p.j) GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

QUERIES = {"op5_substring_dedup": (op5_substring_dedup, SQL)}
