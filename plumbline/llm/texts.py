"""Whole texts as numpy arrays inside Arrow tasks: chunks of documents, words, lines, hashes.

Everything here works on the rows of one Arrow batch. Hashes are polynomial over the ring of 64-bit
integers with a random value per byte; the hash of any range is a difference of two prefix values,
so all windows of one length cost one subtraction each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21

_BASE = 0x9E6C63D0876A9A47 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER_VALUES = _VALUES.copy()
_LOWER_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64; kept between calls."""
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, CHUNK_BYTES + 2)
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix hashes of a sequence of 64-bit values: one entry more than values."""
    power, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=out[1:])
    return out


def bytes_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix hashes over bytes."""
    return prefix(_VALUES[data])


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end), independent of where they lie; lengths count."""
    _, inverse = powers(len(sums))
    plain = (sums[end] - sums[start]) * inverse[start]
    return mix(plain + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(sums: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of one length."""
    count = len(sums) - length
    if count <= 0:
        return np.zeros(0, np.uint64)
    _, inverse = powers(len(sums))
    return mix((sums[length:] - sums[:-length]) * inverse[:count])


def texts_of(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; null counts as empty."""
    cells = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_null(cells.type):
        cells = cells.cast(pa.string())
    if cells.null_count:
        cells = cells.fill_null("" if not pa.types.is_binary(cells.type) else b"")
    cells = cells.cast(pa.large_string()).cast(pa.large_binary())
    _, offsets, data = cells.buffers()
    places = np.frombuffer(offsets, np.int64)[cells.offset : cells.offset + len(cells) + 1]
    return places, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Cut a batch into runs of whole documents of about ``limit`` bytes.

    Yields (first row, end row, offsets from 0, bytes). A longer document is a chunk of its own.
    """
    if not batch.num_rows:
        return
    offsets, data = texts_of(batch, column)
    first = 0
    while first < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), batch.num_rows)
        yield first, end, offsets[first : end + 1] - offsets[first], data[offsets[first] : offsets[end]]
        first = end


def word_counts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Number of words of each document of a chunk."""
    starts = ~_SPACES[data]
    inside = starts.copy()
    starts[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    starts[edge] = inside[edge]
    return np.diff(np.concatenate(([0], np.cumsum(starts)))[offsets])


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk: where they start and end, their document, their hash."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lower: bool = False):
        self.offsets, self.data, self.docs = offsets, data, len(offsets) - 1
        inside = ~_SPACES[data]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        starts[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.sums = prefix((_LOWER_VALUES if lower else _VALUES)[data])
        self.hash = ranges(self.sums, self.start, self.end)
        #: place of each document's first word; one entry more than documents
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.docs), self.count)

    def chain(self) -> np.ndarray:
        """Prefix hashes over the words."""
        return prefix(self.hash)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the n-word windows inside documents."""
        hashes = windows(self.chain(), n)
        if not len(hashes):
            return np.zeros(0, np.int64), hashes
        place = np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(hashes)])
        return place, hashes[place]


def seen_twice(keys: np.ndarray) -> np.ndarray:
    """Marks keys that occur more than once."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def in_document(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal keys of one document."""
    return mix(keys + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))


def covered(length: int, place: np.ndarray, width: int) -> np.ndarray:
    """Marks positions inside one of the windows that start at ``place``."""
    steps = np.bincount(place, minlength=length + 1).astype(np.int64)
    steps = steps[: length + 1]
    steps -= np.bincount(np.minimum(place + width, length), minlength=length + 1)[: length + 1]
    return np.cumsum(steps[:length]) > 0


def per_document(doc: np.ndarray, docs: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sums by document as integers."""
    return np.bincount(doc, weights, minlength=docs).astype(np.int64)
