"""Mixing, packing, sharding and search."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import mixing, packing, sharding, topk_search
from plumbline.llm.mixing import exchange, targets
from plumbline.llm.packing import plan
from pyspark.sql import functions as F
from tests.llm import brute


def test_targets_fill_up():
    got = targets({"b": 100, "a": 10, None: 50, "c": 40})
    # weights a 3, b 1, c 2, none 3; 300 words to share
    assert got["a"] == 20 and got["c"] == 80
    assert got[None] == 100 and got["b"] == pytest.approx(100)
    assert targets({"x": 0, "y": 4}) == {"x": 0.0, "y": 6.0}
    assert targets({}) == {}


def test_exchange_keeps_words_and_expectation():
    random.seed(1)
    for _ in range(500):
        x, y = random.uniform(0.01, 0.99), random.uniform(0.01, 0.99)
        a, b = random.randint(1, 50), random.randint(1, 50)
        up, down = min(1 - x, y * b / a), min(x, (1 - y) * b / a)
        mean = 0.0
        for luck, weight in ((0.0, down / (up + down)), (0.999999999, up / (up + down))):
            p, q = exchange(x, a, y, b, luck)
            assert p * a + q * b == pytest.approx(x * a + y * b)
            assert p in (0.0, 1.0) or q in (0.0, 1.0)
            mean += weight * p
        assert mean == pytest.approx(x)


def mix_rows():
    random.seed(2)
    rows = [(i, f"s{i % 3}" if i % 5 else None, " ".join("w" * random.randint(0, 30)), "t") for i in range(400)]
    return rows + [(5, "s1", "a b", "t"), (None, None, None, "t"), (5, "s1", "a b", "t"), (6, "only", "", "t")]


@pytest.mark.parametrize("fan_in", [4096, 16])
def test_mix_meets_targets(spark, monkeypatch, fan_in):
    monkeypatch.setattr(mixing, "FAN_IN", fan_in)
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    got = mixing.mix(df.repartition(3)).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), len((r[2] or "").split())) for r in rows)
    by_source = collections.defaultdict(list)
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        by_source[r.source].append(r)
    for group in by_source.values():
        assert group[0].source_size == sum(r.size for r in group)
        assert abs(sum(r.taken for r in group) - group[0].target) <= max(r.size for r in group) / 2 + 1e-6
    again = mixing.mix(df.repartition(5)).collect()
    assert brute.ordered(got) == brute.ordered(again)


def test_mix_passes_columns_on(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    got = mixing.mix(df, others=("text",)).collect()
    assert sorted(str(r.text) for r in got) == sorted(str(r[2]) for r in rows)
    assert all(r.size == len((r.text or "").split()) for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_plan_places_all_and_fills_without_gaps():
    random.seed(3)
    for _ in range(300):
        capacity = random.choice([7, 20, 64, 2048])
        low, high = max(1, capacity // 3 - 1), capacity // 2 + 1
        lengths = [
            random.randint(1, capacity) if random.random() < 0.7 else random.randint(low, high)
            for _ in range(random.randint(0, 200))
        ]
        counts, seen, filled = collections.Counter(lengths), collections.Counter(), collections.defaultdict(list)
        for length, first, pieces, sequence, offset, run in plan(counts, capacity):
            assert first == seen[length]
            seen[length] += pieces
            for i in range(pieces):
                filled[sequence + i // run].append((offset + i % run * length, length))
        assert seen == counts
        for items in filled.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= capacity
        gaps: list[int] = []
        for length in sorted(lengths, reverse=True):
            best = min((g for g in gaps if g >= length), default=None)
            gaps.append(capacity - length) if best is None else gaps.__setitem__(gaps.index(best), best - length)
        assert len(filled) <= 1.1 * len(gaps) + 1


def test_large_items_are_matched_in_pairs():
    rows = plan({6: 2, 4: 2, 5: 2}, 10)
    assert max(r[3] + (r[2] - 1) // r[5] for r in rows) == 2


def test_packing_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(900, None), (901, ""), (None, "word " * 5000), (7, "again"), (7, "again")], "doc_id long, text string")
    docs = docs.union(extra)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    wanted = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        size = len(ids) % 2048 or 2048
        cuts = [0, *range(size, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted.append((r.doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = packing.pack_documents(docs.withColumn("number", F.lit(1))).collect()
    assert brute.ordered(r[:5] for r in got) == brute.ordered(wanted)
    filled = collections.defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for items in filled.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(filled) <= sum(r.length for r in got) / 2048 * 1.02 + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


HELPERS = (
    "tie", "own_key", "weight", "part", "before", "sort_key", "bucket", "number", "row", "pieces", "place", "o0", "o1", "Shard_"
)


def test_shards_keep_columns_named_like_helpers(spark):
    given = [F.concat(F.lit(f"{name} "), F.col("id")).alias(name) for name in HELPERS]
    df = spark.range(50).select(F.col("id").alias("doc_id"), *given, F.lit(0).alias("shard"))
    got = sharding.histogram_shards(df, sharding.byte_key((F.col("doc_id"), 8)), 9, F.lit(3), 4, part_rows=5)
    assert got.columns == ["doc_id", *HELPERS, "shard", "slot"]
    rows = got.collect()
    assert all(r[name] == f"{name} {r.doc_id}" for r in rows for name in HELPERS)
    assert sorted(r.doc_id for r in rows) == list(range(50)) and {r.shard for r in rows} == {0, 1, 2, 3}


def test_packing_keeps_columns_named_like_helpers(spark):
    given = [F.concat(F.lit(f"{name} "), F.col("id")).alias(name) for name in HELPERS]
    pieces = spark.range(300).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), "id",
        (F.col("id") % 7 + 1).alias("length"), *given, F.lit("x").alias("offset"),
    )
    for bucket_pieces in (5, 50_000):
        got = packing.pack(pieces, 10, bucket_pieces)
        assert got.columns == ["doc_id", "piece", "id", "length", *HELPERS, "sequence_id", "offset"]
        rows = got.collect()
        assert sorted(r.id for r in rows) == list(range(300))
        assert all(r[name] == f"{name} {r.id}" for r in rows for name in HELPERS)
        places = [(r.sequence_id, r.offset + i) for r in rows for i in range(r.length)]
        assert len(set(places)) == len(places)
        for sequence, used in collections.Counter(s for s, _ in places).items():
            assert {at for s, at in places if s == sequence} == set(range(used)) and used <= 10


def test_byte_key_sorts_as_numbers(spark):
    rows = [(None,), (-(1 << 63),), (-5,), (0,), (7,), ((1 << 63) - 1,)]
    df = spark.createDataFrame(rows, "n long").withColumn("k", sharding.byte_key((F.col("n"), 8)))
    assert [r.n for r in df.orderBy("k").collect()] == [r[0] for r in rows]


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(spark, law):
    random.seed(4)
    rows = [(random.choice([None, 1, 2, i, i]), random.randint(1, 40), "x") for i in range(700)] + [(9, 5, "x")] * 300
    df = spark.createDataFrame(rows, "doc_id long, size int, slot string").repartition(4)
    key = sharding.byte_key((F.col("size"), 4), (F.col("doc_id"), 8))
    got = sharding.histogram_shards(df.drop("slot"), key, 14, F.col("size"), 8, law, part_rows=40).collect()
    assert brute.ordered((r.doc_id, r["size"]) for r in got) == brute.ordered(r[:2] for r in rows)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    assert sorted(shards) == list(range(8))
    for group in shards.values():
        assert sorted(r.slot for r in group) == list(range(len(group)))
    if law == "rows":
        assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    else:
        weights = [sum(r["size"] for r in g) for g in shards.values()]
        assert max(weights) - min(weights) <= 2 * 40
    placed = sorted(got, key=lambda r: (r.shard, r.slot))
    order = [(r["size"], r.doc_id is not None, r.doc_id or 0) for r in placed]
    assert order == sorted(order)
    assert sharding.histogram_shards(df.limit(0).drop("slot"), key, 14, F.col("size")).count() == 0


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 64)
    draw = np.random.default_rng(5)
    rows = []
    for i in range(320):
        vector = [float(x) for x in np.round(draw.normal(size=6), 2) * (draw.random(6) < 0.6)]
        rows.append((i, vector, 0))
    rows[3], rows[4], rows[5] = (3, None, 0), (4, [1.0, None], 0), (5, [float("nan")], 0)
    rows[6], rows[7], rows[8] = (6, [], 0), (7, [1.5], 0), (None, [9.0] * 6, 0)
    rows[100] = (100, [0.0] * 6, 0)
    rows += [rows[50], rows[200], (300, [2.0] * 6, 0)]
    valid = [
        (i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, _ in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    wanted = []
    queries = {(i, tuple(v)) for i, v in valid if i % 100 == 0}
    for i, v in queries:
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in valid if j != i)[:10]
        wanted += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(found)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    assert brute.ordered(topk_search.search(df).collect()) == brute.ordered(wanted)
    few = spark.createDataFrame(rows[:2], "vec_id long, embedding array<float>, score int")
    assert topk_search.search(few).count() == 1
    assert topk_search.search(few.limit(0)).count() == 0


def test_top_k_over_a_grid_of_blocks_and_groups(spark, monkeypatch):
    rows = [(i % 900, [float((i * 7 + j * j) % 11) / 8 - 0.5 for j in range(5)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = brute.ordered(topk_search.search(df).collect())
    assert len(whole) >= 90
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 100)
    monkeypatch.setattr(topk_search, "GROUP_QUERIES", 2)
    assert brute.ordered(topk_search.search(df).collect()) == whole
    monkeypatch.setattr(topk_search, "QUERIES_AT_ONCE", 1)
    assert brute.ordered(topk_search.search(df).collect()) == whole


def test_top_k_among_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 50)
    rows = [(1, [float(i % 37), float(i)]) for i in range(1000)] + [(100, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk_search.search(df, k=5).collect()
    best = sorted((-(int(1024 * (i % 37)) * 1024 + 1024 * i * 512) for i in range(1000)))[:5]
    assert [r["score"] for r in sorted(found, key=lambda r: r["rank"])] == [-b for b in best]
