"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths show which words lie in n-grams that a document holds
more than once; the characters of those words and of repeated lines are measured against all
characters in words. One pass, no shuffle, every document on its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.tables import by_batch, key_name, read
from plumbline.llm.texts import (
    Words, chunks, covered, in_document, per_document, ranges, seen_twice,
)

#: Largest share of a document's word characters in repeated n-grams, by n-gram length.
GRAM_SHARES = {5: 0.30, 6: 0.29, 7: 0.28, 8: 0.27, 9: 0.26, 10: 0.25}
#: Largest share of word characters in lines that equal an earlier line.
LINE_SHARE = 0.20
MIN_WORDS = 10

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars long, dup_gram_share double, base_failed boolean, kept boolean"
)


def _lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each line that holds a word."""
    edges = np.union1d(np.flatnonzero(words.data == 10), words.offsets[1:] - 1)
    edges = edges[edges >= 0]  # texts without a byte have no last one
    # A line ends before its newline or after the last byte of its document.
    end = np.where(words.data[edges] == 10, edges, edges + 1) if len(edges) else edges
    cut = np.union1d(end, words.offsets)
    start, end = cut[:-1], cut[1:]
    start = start[start < len(words.data)]
    end = end[: len(start)]
    start = start + ((words.data[start] == 10) if len(start) else 0)
    full = start < end
    start, end = start[full], end[full]
    holds = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[holds], end[holds]
    return start, end, np.searchsorted(words.offsets, start, "right") - 1


def measure(offsets: np.ndarray, data: np.ndarray, shares: Mapping[int, float]) -> dict[str, np.ndarray]:
    """Counts of a chunk's documents."""
    words = Words(offsets, data)
    docs = words.docs
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = points[words.end] - points[words.start]
    out = {"n_words": words.count.astype(np.int64), "word_chars": per_document(words.doc, docs, chars)}
    symbols = np.concatenate(([0], np.cumsum(_SYMBOLS[data])))
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]

    start, end, doc = _lines(words)
    keys = in_document(ranges(words.sums, start, end), doc)
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    out["n_dup_lines"] = per_document(doc[again], docs)
    inside = np.concatenate(([0], np.cumsum(chars)))
    held = inside[np.searchsorted(words.start, end)] - inside[np.searchsorted(words.start, start)]
    out["dup_line_chars"] = per_document(doc[again], docs, held[again])

    total = np.maximum(out["word_chars"], 1)
    worst = np.zeros(docs)
    passed = out["dup_line_chars"] <= LINE_SHARE * total
    repeats = np.zeros(docs, np.int64)
    for n in sorted({5, *shares}):
        place, hashes = words.grams(n)
        twice = seen_twice(in_document(hashes, words.doc[place]))
        if not twice.any():
            break  # longer n-grams repeat only where shorter ones do
        inside = covered(len(words.start), place[twice], n)
        if n == 5:
            repeats = per_document(words.doc[inside], docs)
        if n in shares:
            share = per_document(words.doc[inside], docs, chars[inside]) / total
            worst = np.maximum(worst, share)
            passed &= share <= shares[n]
    out["n_repeat_words"] = repeats
    out["dup_gram_share"] = worst
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * repeats > 20 * out["n_words"])
    out["kept"] = passed & ~out["base_failed"]
    return out


def judge(
    df: DataFrame, key: str = "doc_id", text: str = "text", shares: Mapping[int, float] = GRAM_SHARES
) -> DataFrame:
    """Repetition counts and a verdict for every row.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word counts as repeated if it lies in a 5-word window
    found twice or more in its text; a line counts if it holds a word and equals an earlier line.
    Rows fail with fewer than 10 words, with over 20 % repeated words, with a larger share of
    characters in repeated n-grams than ``shares`` allows, or in repeated lines than LINE_SHARE.
    A null or empty text has counts of 0 and fails. Repeated rows are judged each on its own; the
    key may be null and is only passed on (as ``key_`` and its name, if a result column has that
    name); other columns are not read. An empty table gives an empty result. Memory is about 40 times a chunk of 2 MB, or the longest text if that is longer.
    """
    shares = dict(shares)
    kind, name = df.schema[key].dataType.simpleString(), key_name(key, SCHEMA)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, end, offsets, data in chunks(batch):
            out = measure(offsets, data, shares)
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first), *(pa.array(out[c]) for c in names)],
                [name, *names],
            )

    frame = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    return by_batch(frame, run, f"`{name}` {kind}, {SCHEMA}")


def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's repetition counts and verdict."""
    return judge(read(spark, sf_dir, "documents"))


QUERIES = {"op9_repetition_rules": (op9_repetition_rules, None)}
