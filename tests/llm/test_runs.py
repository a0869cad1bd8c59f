"""Runs found on a grammar against all periods of all words."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from plumbline.llm import periodic_runs
from plumbline.llm.texts import mix
from tests.llm import brute

SCHEMA = "doc_id long, text string"
COLUMNS = (
    "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
)


def plain_runs(words, least, times):
    """(start, length, period) by looking at every period from every word."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((start, end - start, q) for (start, end), q in found.items())


def plain(key, text, least=24, times=3, planted=False):
    words = brute.WORD.findall(text or "")
    n, code = len(words), zlib.crc32(str(key).encode())
    if planted and key is not None and n and code % 10 == 0:
        group = code // 10
        a = group % n
        p = 1 + (n - a) // (3 + group % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, least, times)
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (key, len(runs), *top, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


def fibonacci(n):
    one, two = [1], [1, 2]
    while len(two) < n:
        one, two = two, two + one
    return two[:n]


def texts():
    draw = random.Random(3)
    rows = []
    for _ in range(150):
        n, kinds = draw.choice([0, 3, 24, 25, 60, 200]), draw.choice([1, 2, 3, 40])
        words = [draw.randrange(kinds) for _ in range(n)]
        if n and draw.random() < 0.6:
            a = draw.randrange(n)
            p = 1 + (n - a) // draw.randrange(3, 9)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        rows.append(words)
    doubled = [bin(i).count("1") & 1 for i in range(500)]
    rows += [fibonacci(400), doubled, [1] * 700, fibonacci(200) * 3, doubled[:64] * 5 + [9] + doubled[:64] * 4]
    return rows


@pytest.mark.parametrize("least, times", [(24, 3), (6, 3), (24, 2), (4, 2), (1, 2)])
def test_runs_of_words(least, times):
    rows = texts()
    doc = np.repeat(np.arange(len(rows)), [len(w) for w in rows])
    words = mix(np.array([x for w in rows for x in w], np.uint64) + np.uint64(1))
    first = np.concatenate(([0], np.cumsum([len(w) for w in rows])))
    got = [[] for _ in rows]
    for s, n, q in zip(*(part.tolist() for part in periodic_runs.find_runs(words, doc, least, times))):
        got[doc[s]].append((s - int(first[doc[s]]), n, q))
    for found, w in zip(got, rows):
        assert found == plain_runs(w, least, times)


def test_the_grammar_gives_the_words_back():
    rows = [w for w in texts() if w]
    ids = np.unique([f"{d} {x}" for d, w in enumerate(rows) for x in w], return_inverse=True)
    doc = np.repeat(np.arange(len(rows)), [len(w) for w in rows])
    owner = np.zeros(len(ids[0]), np.int64)
    owner[ids[1]] = doc
    grammar = periodic_runs.compress(ids[1], doc, owner)
    for d, root in enumerate(grammar.roots.tolist()):
        todo, words = [root], []
        while todo:
            symbol = todo.pop()
            if symbol < grammar.terminals:
                words.append(symbol)
            else:
                at = symbol - grammar.terminals
                todo += [int(grammar.right[at]), int(grammar.left[at])]
        assert words == ids[1][doc == d].tolist() and len(words) == grammar.size[root]
    depth = np.zeros(len(grammar.size), np.int64)
    for at, (a, b) in enumerate(zip(grammar.left, grammar.right)):
        depth[grammar.terminals + at] = 1 + max(depth[a], depth[b])
    assert depth.max() < 60


def test_every_document(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = periodic_runs.op13_periodic_runs(spark, folder)
    assert got.columns == list(COLUMNS)
    assert brute.ordered(got.collect()) == brute.ordered(plain(*r, planted=True) for r in rows)
    assert sum(r.n_runs > 0 for r in got.collect()) > 10


def test_odd_rows(spark):
    long = " ".join(f"w{i % 97}" for i in range(30_000))
    rows = [
        (None, "a b " * 12), (None, None), (1, ""), (2, " \n\t\x0b "), (3, "a b " * 11), (4, "a b " * 12),
        (4, "a b " * 12), (5, long), (6, "x " * 30 + "y " * 30), (7, " ".join("ab" * 30)), (8, "a\x00b " * 40),
        (9, "é " * 24 + "end"), (10, ("a b c " * 8 + "\n") * 3),
    ]
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], f"{SCHEMA}, n_runs long, key string").repartition(3)
    got = periodic_runs.collapse(frame)
    assert brute.ordered(got.select(*COLUMNS).collect()) == brute.ordered(plain(*r) for r in rows)
    six = got.where("doc_id = 6").first()
    assert (six.n_runs, six.start, six.n_dropped, six.collapsed) == (2, 0, 58, "x y")
    assert periodic_runs.collapse(frame.limit(0)).count() == 0
    assert periodic_runs.collapse(frame.withColumnRenamed("doc_id", "start"), key="start").columns[0] == "key"
