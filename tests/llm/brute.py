"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AFTER_ALL = 1 << 63


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(repr(x) for x in r))


def suffix_dedup(rows, length):
    where = collections.Counter()
    for _, text in rows:
        data = (text or "").encode()
        where.update(data[p : p + length] for p in range(len(data) - length + 1))
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if where[data[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, y in zip(data, gone) if not y)
        yield key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def substring_dedup(rows, window):
    split = [(key, (text or "").encode().split()) for key, text in rows]
    least: dict = {}
    for key, words in split:
        own = AFTER_ALL if key is None else key
        for p in range(len(words) - window + 1):
            gram = tuple(words[p : p + window])
            least[gram] = min(least.get(gram, AFTER_ALL), own)
    for key, words in split:
        own = AFTER_ALL if key is None else key
        gone = bytearray(len(words))
        for p in range(len(words) - window + 1):
            if least[tuple(words[p : p + window])] < own:
                gone[p : p + window] = b"\1" * window
        kept = b" ".join(x for x, y in zip(words, gone) if not y)
        yield key, len(words), sum(gone), hashlib.sha256(kept).hexdigest()


def shingle_sets(rows):
    for _, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = WORD.findall(lower)
        if len(words) >= 3:
            yield {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
        else:
            yield {tuple(words)} if words else set()


def jaccard_components(rows):
    sets = list(shingle_sets(rows))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            both = len(one & sets[j])
            if both and 100 * both >= 90 * (len(one) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least: dict = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    for i, (key, _) in enumerate(rows):
        yield key, len(sets[i]), least.get(root(i))


def repetition(text):
    text = text or ""
    words = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marks = [False] * len(words)
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            marks[i : i + 5] = [True] * 5
    repeats = sum(marks)
    failed = len(words) < 10 or 100 * repeats > 20 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, lines, repeats, failed
