"""Runs of periodic text, found on a grammar of the words.

A run is a stretch of consecutive words that repeats with a period and that no neighbouring word
extends. Word ids are compressed by Re-Pair: pairs that a document holds most often become one
symbol, until none is left twice. Every stretch lies across the boundary between the two halves of
some symbol, so each symbol is searched once, however often it is derived: equal words at distance
q on the boundary are extended both ways. What is found moves to all places that derive the symbol,
and stretches of one period that overlap by a period or more are one run.

Documents are independent: one pass over the table, no shuffle. All documents of a chunk are
compressed side by side, with symbols of their own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.tables import by_batch, read
from plumbline.llm.texts import Words, chunks, covered, in_document, mix, prefix, seen_twice, windows

LEAST_WORDS = 24
LEAST_TIMES = 3
#: Boundary and period pairs looked at in one go.
BLOCK = 1 << 21

SCHEMA = (
    "n_words long, n_dropped long, n_runs long, start long, length long, period long, "
    "exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"
)


@dataclass
class Grammar:
    """Symbols of two halves; ids below ``terminals`` are words."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    #: words a symbol stands for
    size: np.ndarray
    #: symbol and first place of each segment
    roots: np.ndarray
    places: np.ndarray


def _every_other(seq: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Marks every second place of a row of equal symbols, so that pairs of them do not overlap."""
    at = np.arange(len(seq))
    new = np.ones(len(seq), bool)
    new[1:] = (seq[1:] != seq[:-1]) | (seg[1:] != seg[:-1])
    return (at - np.maximum.accumulate(np.where(new, at, 0))) % 2 == 0


def compress(ids: np.ndarray, seg: np.ndarray, owner: np.ndarray) -> Grammar:
    """Re-Pair over words ``ids`` (dense, of one document each) in segments.

    ``owner`` is the document of each id. A round replaces each document's most frequent pairs side
    by side: those at least half as frequent as its most frequent one, and of pairs that could
    overlap the more frequent, equal ones by a hash, which keeps the grammar shallow. What is left
    of a segment is joined two by two.
    """
    terminals, total = len(owner), len(owner)
    lefts, rights, sizes = [], [], [np.ones(terminals, np.int64)]
    owners, docs = [owner], int(owner.max()) + 1 if len(owner) else 0
    _, first = np.unique(seg, return_index=True)
    seq, places = ids.astype(np.int64), first
    done: list[tuple[np.ndarray, np.ndarray]] = []

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        nonlocal total
        lefts.append(a)
        rights.append(b)
        new = total + np.arange(len(a))
        total += len(a)
        return new

    symbol_owner = owner
    while len(seq):
        at = np.flatnonzero(seg[1:] == seg[:-1])
        at = at[(seq[at] != seq[at + 1]) | _every_other(seq, seg)[at]]
        kind, which, count = np.unique(seq[at] * total + seq[at + 1], return_inverse=True, return_counts=True)
        a, b = kind // total, kind % total
        most = np.ones(docs, np.int64)
        np.maximum.at(most, symbol_owner[a], count)
        wanted = (count > 1) & (2 * count >= most[symbol_owner[a]])
        rank = np.zeros(len(kind), np.int64)
        order = np.lexsort((mix(kind.astype(np.uint64)), count))
        rank[order] = np.arange(1, len(kind) + 1)
        rank[~wanted] = 0
        as_left, as_right = np.zeros(total, np.int64), np.zeros(total, np.int64)
        np.maximum.at(as_left, a, rank)
        np.maximum.at(as_right, b, rank)
        taken = wanted & (rank >= as_right[a]) & (rank >= as_left[b])

        symbol = np.full(len(kind), -1, np.int64)
        symbol[taken] = join(a[taken], b[taken])
        owners.append(symbol_owner[a[taken]])
        symbol_owner = np.concatenate(owners)
        owners = [symbol_owner]
        hit = taken[which]
        keep = np.ones(len(seq), bool)
        seq[at[hit]] = symbol[which[hit]]
        keep[at[hit] + 1] = False
        seq, seg = seq[keep], seg[keep]

        open_docs = most > 1
        busy = open_docs[symbol_owner[seq]]
        done.append((seq[~busy], seg[~busy]))
        seq, seg = seq[busy], seg[busy]

    seq = np.concatenate([d[0] for d in done]) if done else seq
    seg = np.concatenate([d[1] for d in done]) if done else seg
    order = np.argsort(seg, kind="stable")
    seq, seg = seq[order], seg[order]
    while len(seq) > len(places):
        at = np.arange(len(seq))
        new = np.ones(len(seq), bool)
        new[1:] = seg[1:] != seg[:-1]
        even = (at - np.maximum.accumulate(np.where(new, at, 0))) % 2 == 0
        pair = np.flatnonzero(even[:-1] & ~new[1:])
        seq[pair] = join(seq[pair], seq[pair + 1])
        keep = np.ones(len(seq), bool)
        keep[pair + 1] = False
        seq, seg = seq[keep], seg[keep]

    left = np.concatenate(lefts) if lefts else np.zeros(0, np.int64)
    right = np.concatenate(rights) if rights else np.zeros(0, np.int64)
    size = np.concatenate([sizes[0], np.zeros(len(left), np.int64)])
    at = 0
    for part in lefts:  # halves of a symbol are older than the symbol's round
        end = at + len(part)
        size[terminals + at : terminals + end] = size[left[at:end]] + size[right[at:end]]
        at = end
    return Grammar(terminals, left, right, size, seq, places)


def derivations(grammar: Grammar, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and place of every derived symbol of at least ``least`` words that has halves."""
    symbols, places = [], []
    symbol, place = grammar.roots, grammar.places
    while len(symbol):
        big = (symbol >= grammar.terminals) & (grammar.size[symbol] >= least)
        symbol, place = symbol[big], place[big]
        symbols.append(symbol)
        places.append(place)
        left, right = grammar.left[symbol - grammar.terminals], grammar.right[symbol - grammar.terminals]
        symbol, place = np.concatenate((left, right)), np.concatenate((place, place + grammar.size[left]))
    return np.concatenate(symbols), np.concatenate(places)


class Names:
    """Exact names of all windows whose length is a power of two: equal names, equal words."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.levels = [ids.astype(np.int32)]
        width = 1
        while 2 * width <= longest:
            last = self.levels[-1]
            pair = last[:-width].astype(np.int64) * (int(last.max()) + 1) + last[width:]
            self.levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
            width *= 2

    def ahead(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words from i and j on are equal, at most ``limit``."""
        found = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            found += self._step(k, i + found, j + found, limit - found) << k
        return found

    def back(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words before i and j are equal, at most ``limit``."""
        found = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            wide = 1 << k
            found += self._step(k, i - found - wide, j - found - wide, limit - found) << k
        return found

    def _step(self, k: int, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        names = self.levels[k]
        fits = limit >= 1 << k
        out = np.zeros(len(i), np.int64)
        out[fits] = names[i[fits]] == names[j[fits]]
        return out


def _across(
    names: Names, start: np.ndarray, middle: np.ndarray, end: np.ndarray, least: int, times: int
) -> Iterator[tuple[np.ndarray, ...]]:
    """Stretches across each boundary, as long as they reach inside [start, end).

    Yields (number of the boundary, first place, end, period).
    """
    half = -(-(least * (times - 1)) // times) // 2
    level = max(half, 1).bit_length() - 1
    wide = 1 << level
    name = names.levels[min(level, len(names.levels) - 1)]
    wide = 1 << min(level, len(names.levels) - 1)
    most = (end - start) // times
    cuts = np.concatenate(([0], np.cumsum(most)))
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + BLOCK, "right")) - 1)
        number = np.repeat(np.arange(first, last), most[first:last])
        period = np.arange(len(number)) - (cuts[number] - cuts[first]) + 1
        s, m, e = start[number], middle[number], end[number]
        for anchor in (m - period, m - 1):
            # Of the anchor's equal words, half of what a run needs lies before it or behind it.
            inside = (anchor >= s) & (anchor + period < e)
            near = np.zeros(len(number), bool)
            for shift in (0, -wide):
                i = anchor + shift
                fits = inside & (i >= s) & (i + period + wide <= e)
                near[fits] |= name[i[fits]] == name[i[fits] + period[fits]]
            near[near] &= names.levels[0][anchor[near]] == names.levels[0][anchor[near] + period[near]]
            if not near.any():
                continue
            i, q, lo, hi, n = anchor[near], period[near], s[near], e[near], number[near]
            ahead = names.ahead(i, i + q, hi - i - q)
            back = names.back(i, i + q, i - lo)
            long = q + ahead + back >= np.maximum(least, times * q)
            yield n[long], (i - back)[long], (i + q + ahead)[long], q[long]
        first = last


def _shortest_period(
    number: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Of stretches that are equal but for the period the one of smallest period."""
    order = np.lexsort((period, end, start, number))
    number, start, end, period = number[order], start[order], end[order], period[order]
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return number[new], start[new], end[new], period[new]


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal intervals: those of one period that overlap by a period or more are one."""
    if not len(start):
        return start, end, period
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    room = int(end.max()) + 1
    reach = np.maximum.accumulate(end + period * room) - period * room
    new = np.ones(len(start), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] > reach[:-1] - period[1:])
    at = np.flatnonzero(new)
    start, period = start[at], period[at]
    end = reach[np.append(at[1:], len(new)) - 1]
    none = np.zeros(len(start), np.int64)
    return _shortest_period(none, start, end, period)[1:]


def find_runs(
    words: np.ndarray, doc: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of all runs of the words of several documents.

    A run of at least ``least`` words and ``times`` periods equals itself a period further on in
    at least ``least * (times - 1) / times`` words. Words outside such repeated windows are in no
    run, so only stretches of the others are compressed.
    """
    none = np.zeros(0, np.int64)
    width = -(-(least * (times - 1)) // times)
    grams = windows(prefix(words), width)
    place = np.flatnonzero(doc[width - 1 :] == doc[: len(grams)]) if len(grams) else none
    twice = seen_twice(in_document(grams[place], doc[place]))
    inside = np.flatnonzero(covered(len(words), place[twice], width)) if twice.any() else none
    if not len(inside):
        return none, none, none
    new = np.ones(len(inside), bool)
    new[1:] = (inside[1:] != inside[:-1] + 1) | (doc[inside[1:]] != doc[inside[:-1]])
    seg = np.cumsum(new) - 1
    keys, sample, ids = np.unique(
        in_document(words[inside], doc[inside]), return_index=True, return_inverse=True
    )
    _, owner = np.unique(doc[inside[sample]], return_inverse=True)
    grammar = compress(ids, seg, owner)
    symbol, at = derivations(grammar, least)
    if not len(symbol):
        return none, none, none

    # Each symbol is searched at one of its places.
    order = np.argsort(symbol, kind="stable")
    symbol, at = symbol[order], at[order]
    kinds, where, often = np.unique(symbol, return_index=True, return_counts=True)
    begin = at[where]
    middle = begin + grammar.size[grammar.left[kinds - grammar.terminals]]
    names = Names(ids, int(np.bincount(seg).max()))
    found = list(_across(names, begin, middle, begin + grammar.size[kinds], least, times))
    if not found:
        return none, none, none
    number, start, end, period = _shortest_period(*(np.concatenate(part) for part in zip(*found)))

    # And what it holds moves to all places that derive it.
    copies = often[number]
    source = np.repeat(np.arange(len(number)), copies)
    step = np.arange(len(source)) - np.repeat(np.cumsum(copies) - copies, copies)
    moved = at[where[number[source]] + step] - begin[number[source]]
    start, end, period = merged(start[source] + moved, end[source] + moved, period[source])
    order = np.lexsort((period, inside[start]))
    return inside[start][order], (end - start)[order], period[order]


def measure(
    offsets: np.ndarray, data: np.ndarray, keys: list, order: Callable | None, least: int, times: int
) -> dict[str, list]:
    """Runs and collapsed text of a chunk's documents."""
    words = Words(offsets, data)
    docs = words.docs
    source = np.arange(len(words.start))
    changed = np.zeros(docs, bool)
    if order is not None:
        for d in np.flatnonzero(words.count).tolist():
            places = order(keys[d], int(words.count[d]))
            if places is not None:
                source[words.first[d] : words.first[d + 1]] = words.first[d] + places
                changed[d] = True
    start, length, period = find_runs(words.hash[source], words.doc, least, times)
    held = np.searchsorted(words.first, start, "right") - 1 if len(start) else start
    # Documents without words share their first place with the next one; a run belongs to the last.
    steps = np.bincount(start + period, minlength=len(source) + 1) - np.bincount(
        start + length, minlength=len(source) + 1
    )
    dropped = np.cumsum(steps[:-1]) > 0
    raw = data.tobytes()
    bounds = np.searchsorted(held, np.arange(docs + 1))
    out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
    for d in range(docs):
        lo, hi = int(words.first[d]), int(words.first[d + 1])
        a, b = int(bounds[d]), int(bounds[d + 1])
        runs = list(zip((start[a:b] - lo).tolist(), length[a:b].tolist(), period[a:b].tolist()))
        gone = dropped[lo:hi]
        if changed[d] or runs:
            kept = source[lo:hi][~gone]
            text = b" ".join(
                raw[i:j] for i, j in zip(words.start[kept].tolist(), words.end[kept].tolist())
            )
        else:
            text = b" ".join(raw[offsets[d] : offsets[d + 1]].split())
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        out["n_words"].append(hi - lo)
        out["n_dropped"].append(int(gone.sum()))
        out["n_runs"].append(len(runs))
        out["start"].append(best[0] if best else None)
        out["length"].append(best[1] if best else None)
        out["period"].append(best[2] if best else None)
        out["exponent_milli"].append(1000 * best[1] // best[2] if best else None)
        out["runs_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
        out["collapsed_sha256"].append(hashlib.sha256(text).hexdigest())
        out["collapsed"].append(text.decode())
    return out


def collapse(
    df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS,
    times: int = LEAST_TIMES, order: Callable[[int | None, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """Every row's runs, and its text with each run cut down to its first period.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run has a smallest period q, at least
    ``least`` words and ``times`` periods, and no neighbouring word extends it. Returns the key,
    n_words, n_dropped (words in a run behind its first period), n_runs, the run of most periods
    (ties: smallest start, then period; null without runs) as start, length, period and
    exponent_milli, runs_sha256 (lines ``start,length,period``), collapsed_sha256 and collapsed
    (kept words joined by one blank). ``order`` may name other words to read in a row: given the
    key and the number of words it returns their numbers, or None.

    Words are told apart by 64-bit hashes, stretches of words exactly. Null and empty texts have no
    words and no runs. Repeated rows and rows of equal or null keys count each on its own; other
    columns are not read, whatever their names. An empty table gives an empty result. Memory grows
    with a chunk of 2 MB, or with the longest text if that is longer, and its logarithm.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, end, offsets, data in chunks(batch):
            keys = batch.column(0).slice(first, end - first)
            out = measure(offsets, data, keys.to_pylist(), order, least, times)
            texts = {"runs_sha256", "collapsed_sha256", "collapsed"}
            yield pa.RecordBatch.from_arrays(
                [keys, *(pa.array(out[c], pa.string() if c in texts else pa.int64()) for c in names)],
                ["key", *names],
            )

    frame = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    found = by_batch(frame, run, f"key {kind}, {SCHEMA}")
    return found.toDF(key if key not in names else "key", *names)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's own damage: one document in ten repeats some of its words to the end."""
    if doc_id is None or n == 0:
        return None
    code = zlib.crc32(str(doc_id).encode())
    if code % 10:
        return None
    group = code // 10
    first = group % n
    period = 1 + (n - first) // (3 + group % 8)
    places = np.arange(n)
    places[first:] = first + (places[first:] - first) % period
    return places


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, some of them planted, and what is left of it without them."""
    return collapse(read(spark, sf_dir, "documents"), order=planted).drop("n_words", "n_dropped", "collapsed")


QUERIES = {"op13_periodic_runs": (op13_periodic_runs, None)}
