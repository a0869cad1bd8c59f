"""Both kinds of substring removal and the parts they are made of."""

import random

import numpy as np
import pytest

from plumbline.llm import substring_dedup, suffix_dedup
from plumbline.llm.repeats import STRETCH, Found, Kind, identified, least_in_windows, marked_runs, stretches
from plumbline.llm.suffixes import permuted_common_prefixes, suffix_array
from pyspark.sql import functions as F
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def test_suffix_array_and_common_prefixes():
    draw = np.random.default_rng(1)
    for trial in range(600):
        text = draw.integers(0, draw.integers(1, 6), draw.integers(0, 60)).astype(np.uint8)
        if trial % 3 == 0 and len(text):
            text = np.tile(text[: max(1, len(text) // 4)], 5)
        data = bytes(text)
        order = suffix_array(text)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        if len(text) > 1:
            before, shared = permuted_common_prefixes(text, order)
            for one, two in zip(order[:-1], order[1:]):
                same = 0
                while two + same < len(data) and one + same < len(data) and data[one + same] == data[two + same]:
                    same += 1
                assert before[two] == one and shared[two] == same


def test_long_runs_of_one_letter():
    text = np.full(5000, 97, np.uint8)
    assert suffix_array(text).tolist() == list(range(4999, -1, -1))


def test_least_in_windows():
    values = np.random.default_rng(2).integers(0, 99, 50).astype(np.uint64)
    for width in (1, 3, 7, 50, 51):
        assert least_in_windows(values, width).tolist() == [
            min(values[i : i + width]) for i in range(50 - width + 1)
        ]


def byte_rows():
    random.seed(3)
    base = ["".join(random.choice("abcé") for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(random.randint(0, 6)):
            if random.random() < 0.6:
                parts.append(random.choice(base)[random.randint(0, 20) : random.randint(30, 60)])
            else:
                parts.append("".join(random.choice("xyz") for _ in range(25)))
        rows.append((i if random.random() < 0.9 else None, "".join(parts) if random.random() < 0.95 else None))
    rows += [rows[3], rows[5], (7, "a" * 90), (8, "a" * 31), (9, ""), (10, None), (11, "ab" * 40)]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("share", [None, 300])
def test_suffix_dedup_equals_brute_force(spark, share):
    rows = byte_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = suffix_dedup.dedup(df, length=20, share_bytes=share)
    got = got.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()
    assert brute.ordered(got) == brute.ordered(brute.suffix_dedup(rows, 20))


@pytest.mark.parametrize("share", [None, 700])
def test_substring_dedup_equals_brute_force(spark, share):
    random.seed(4)
    base = [[random.choice(["a", "b", "é", "dd"]) for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(random.randint(0, 6)):
            if random.random() < 0.6:
                words += random.choice(base)[random.randint(0, 20) : random.randint(30, 60)]
            else:
                words += [random.choice("xyz") for _ in range(15)]
        text = "".join(w + random.choice([" ", "\n", "  ", "\t"]) for w in words)
        rows.append((i if random.random() < 0.9 else None, text if random.random() < 0.95 else None))
    rows += [rows[3], rows[5], (7, "a " * 90), (8, "a " * 31), (9, ""), (10, None)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = substring_dedup.dedup(df, window=10, gram=4, share_bytes=share).collect()
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found]
    assert brute.ordered(got) == brute.ordered(brute.substring_dedup(rows, 10))
    given = {(key, text or "") for key, text in rows}
    assert all((r.doc_id, r.text) in given for r in found if not r.n_removed)
    assert all(len(r.text.split()) == r.n_words - r.n_removed for r in found)


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.dedup(empty).count() == 0
    assert substring_dedup.dedup(empty).count() == 0
    rows = [(1, "a b c d e", 5, "x"), (2, "a b c d e", 6, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, name string")
    got = substring_dedup.dedup(df, window=4, gram=2, others=("runs", "name")).orderBy("doc_id").collect()
    assert [(r.runs, r.name, r.n_removed) for r in got] == [(5, "x", 0), (6, "y", 5)]
    assert {r.n_removed for r in suffix_dedup.dedup(df, length=4).collect()} == {9}


def test_nothing_goes_without_a_search(spark, monkeypatch):
    silent = lambda size, letters, counts, firsts: Found(
        np.zeros(counts.sum(), bool), np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
    )
    monkeypatch.setattr(suffix_dedup, "search", silent)
    monkeypatch.setattr(substring_dedup, "search", silent)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert not suffix_dedup.dedup(docs).where("n_removed > 0").count()
    assert not substring_dedup.dedup(docs).where("n_removed > 0").count()


def test_rows_equal_in_key_and_text(spark):
    text = " ".join(f"w{i}" for i in range(120))
    other = text[:300] + " and so on " * 60
    rows = spark.range(0, 6000, 1, 4).select(
        F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 6 == 0, F.lit(other)).otherwise(F.lit(text)).alias("text")
    )
    got = suffix_dedup.dedup(rows, length=100)
    assert {tuple(r) for r in got.groupBy("n_bytes", "n_removed").count().collect()} == {
        (len(text), len(text), 5000), (len(other), len(other), 1000),
    }
    keyed = rows.union(spark.createDataFrame([(7, text)], "doc_id long, text string"))
    got = substring_dedup.dedup(keyed).groupBy("doc_id", "n_words", "n_removed").count()
    words = len(other.split())
    shared = len(text[:300].split()) - 1
    assert {tuple(r) for r in got.collect()} == {
        (7, 120, 0, 1), (None, 120, 120, 5000), (None, words, shared, 1000),
    }


def test_production_lengths_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = suffix_dedup.dedup(docs).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)")
    assert brute.ordered(got.collect()) == brute.ordered(brute.suffix_dedup(rows, 400))
    got = substring_dedup.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert brute.ordered(got.collect()) == brute.ordered(brute.substring_dedup(rows, 50))


def test_suffix_arrays_of_repeats_and_of_many_letters(monkeypatch):
    from plumbline.llm import suffixes

    draw = np.random.default_rng(2)
    texts = [b"a" * 900, b"ab" * 500, (b"a" * 200 + b"b") * 6, (b"b" * 200 + b"a") * 6, bytes(range(256)) * 3,
             (b"zyx" * 40 + b"a" * 300) * 2, b"\xff" * 50 + b"\x00" * 40]
    texts += [np.tile(draw.integers(0, 3, int(draw.integers(1, 40))), 2).astype(np.uint8).tobytes() for _ in range(200)]
    for longest in (suffixes.KEY_LETTERS, 0):  # packed keys, and inducing alone
        monkeypatch.setattr(suffixes, "KEY_LETTERS", longest)
        for text in texts:
            wanted = sorted(range(len(text)), key=lambda i: text[i:])
            assert suffixes.suffix_array(np.frombuffer(text, np.uint8)).tolist() == wanted
    words = np.concatenate((draw.integers(0, 9000, 2000), np.arange(9000)[::-4]))
    words = np.unique(np.concatenate((words, words)), return_inverse=True)[1].astype(np.int32)
    listed = words.tolist()
    wanted = sorted(range(len(listed)), key=lambda i: listed[i:])
    assert suffixes.suffix_array(words, int(words.max()) + 1).tolist() == wanted


def test_suffix_arrays_of_reduced_texts_long_and_short(monkeypatch):
    from plumbline.llm import suffixes

    draw = np.random.default_rng(5)
    texts = [np.tile(draw.integers(0, 4, int(draw.integers(1, 300))), 3).astype(np.uint8) for _ in range(60)]
    texts += [draw.integers(0, 5, 4000).astype(np.uint8), np.tile([1, 0], 2000).astype(np.uint8)]
    for short in (0, 50, suffixes.SHORT):  # inducing at every level, at the first ones, at the first alone
        monkeypatch.setattr(suffixes, "SHORT", short)
        for text in texts:
            data = text.tobytes()
            assert suffix_array(text).tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    for text in texts:
        letters = text.tolist()
        wanted = sorted(range(len(letters)), key=lambda i: letters[i:])
        assert suffixes._doubled(text.astype(np.int32), 5).tolist() == wanted


def test_stretches_of_both_copies_are_cut_alike():
    random.seed(6)
    at, parts = 0, []
    for name in range(300):
        n = random.randint(1, 300)
        parts.append({"name": name, "start": at, "n": n, "chain": random.choice([1, 1, 1, 1, 2, None]), "copy": 0})
        at += n if random.random() < 0.95 else n + 1
    later = [{**p, "start": p["start"] + 1000, "copy": 1} for p in parts]
    both = parts + later
    random.shuffle(both)
    found = stretches(both)
    assert sorted(p["name"] for s in found for p in s) == sorted(p["name"] for p in both)
    for s in found:
        assert all(a["start"] + a["n"] == b["start"] and a["chain"] == b["chain"] for a, b in zip(s[:-1], s[1:]))
        assert sum(p["n"] for p in s) <= STRETCH
    cuts = [sorted([p["name"] for p in s] for s in found if s[0]["copy"] == i) for i in (0, 1)]
    assert cuts[0] == cuts[1] and len(cuts[0]) < 250


def test_copies_are_searched_without_the_overlap_of_their_segments(spark):
    random.seed(7)
    text = "".join(random.choice("abcdefgh") for _ in range(20000))
    docs = identified(spark.createDataFrame([(1, text), (2, text), (3, "x" + text[:9000])], SCHEMA), "doc_id", "text")
    seen = spark.sparkContext.accumulator(0)

    def search(letters, counts, firsts):
        seen.add(sum(map(len, letters)))
        return suffix_dedup.search(400, letters, counts, firsts)

    runs = {r.doc_id: r.runs for r in marked_runs(docs, Kind(False, 400, 128), search, ordered=False).collect()}
    assert {key: sum(r.length for r in found) for key, found in runs.items()} == {1: 19601, 2: 19601, 3: 8601}
    # Two copies, four or five stretches each; segment by segment it is 155,904 bytes.
    assert seen.value <= 2 * (20000 + 5 * 400) + 2000
