"""The n-gram Jaccard join: components, the tile guarantee, the bounds."""

import random

import numpy as np
import pyarrow as pa

from plumbline.llm import ngram_join
from plumbline.llm.components import components, forest_roots
from plumbline.llm.shingles import bitmap, folded, linked, overlap_possible, set_hash, tile_keys
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def test_linked_sets_share_a_tile_and_pass_the_bit_bound():
    draw = np.random.default_rng(0)
    seen = 0
    for _ in range(2000):
        n = int(draw.integers(1, 400))
        pool = draw.integers(0, 1 << 63, n * 2, dtype=np.uint64) * np.uint64(2)
        one = np.unique(pool[:n])
        differ = int(draw.integers(0, max(1, n // 9 + 1)))
        gone = int(draw.integers(0, differ + 1))
        two = np.unique(np.concatenate((one[draw.permutation(len(one))[: len(one) - gone]], pool[n : n + differ - gone])))
        if linked(one, two):
            seen += 1
            a, b = bitmap(one).view(np.uint64)[None], bitmap(two).view(np.uint64)[None]
            words = min(a.shape[1], b.shape[1])
            bits = np.bitwise_count(folded(a, words) ^ folded(b, words)).sum(dtype=np.int64)
            assert bits <= len(np.setxor1d(one, two))
            assert overlap_possible(len(one), len(two), bits)
            assert len(np.intersect1d(tile_keys(one), tile_keys(two))) or set_hash(one) == set_hash(two)
    assert seen > 500


def test_components(spark):
    random.seed(5)
    edges = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(45)]
    edges += [(i, i + 1) for i in range(100, 130)] + [(7, 7)]
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for e in edges for n in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_roots(spark):
    random.seed(8)
    parent = {i: random.randint(max(0, i - 3), i - 1) for i in range(1, 200) if i % 40}

    def root(x):
        while x in parent:
            x = parent[x]
        return x

    found = forest_roots(spark.createDataFrame(list(parent.items()), "node long, parent long")).collect()
    nodes = {*parent, *map(root, parent)}
    assert {r.node: r.component for r in found} == {n: root(n) for n in nodes}


def test_folded_bitmaps_still_bound_the_difference():
    draw = np.random.default_rng(4)
    one = np.unique(draw.integers(0, 1 << 63, 5000, dtype=np.uint64))
    two = np.unique(np.concatenate((one[:4100], draw.integers(0, 1 << 63, 60, dtype=np.uint64))))
    a, b = bitmap(one).view(np.uint64)[None], bitmap(two).view(np.uint64)[None]
    assert a.shape[1] == 128
    for words in (128, 64, 16):
        differ = np.bitwise_count(folded(a, words) ^ folded(b, words)).sum()
        assert differ <= len(np.setxor1d(one, two))
    small = np.bincount((one & np.uint64(1023)).astype(int), minlength=1024) & 1
    assert np.array_equal(folded(a, 16)[0], np.packbits(small.astype(np.uint8)).view(np.uint64))


def near_copies(seed):
    random.seed(seed)
    bases = [[f"w{random.randint(0, 400)}" for _ in range(random.choice([3, 8, 12, 20, 40, 80, 150, 300]))] for _ in range(8)]
    rows = []
    for i in range(150):
        words = list(random.choice(bases))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            k = random.randrange(len(words) + 1)
            if random.random() < 0.5:
                words[k : k + 1] = [f"w{random.randint(0, 400)}"]
            elif random.random() < 0.5:
                del words[k : k + random.randint(1, 3)]
            else:
                words[k:k] = [f"z{random.randint(0, 9)}"]
        text = " ".join(words)
        text = text.upper() if random.random() < 0.1 else text
        rows.append((i if random.random() < 0.95 else None, text if random.random() < 0.95 else None))
    rows += [rows[3], rows[5], (200, "a"), (201, "A"), (202, "a b"), (203, "A b"), (204, ""), (205, None), (206, " \n")]
    random.shuffle(rows)
    return rows


def test_join_equals_brute_force(spark):
    for seed in (3, 4):
        rows = near_copies(seed)
        got = ngram_join.join_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
        assert brute.ordered(got) == brute.ordered(brute.jaccard_components(rows))


def test_first_of_components_keeps_one_row_of_each(spark):
    rows = near_copies(6)
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], f"{SCHEMA}, class int, one string").repartition(3)
    kept = ngram_join.first_of_components(df).collect()
    found = list(brute.jaccard_components(rows))
    alone = [r for r, s in zip(rows, brute.shingle_sets(rows)) if not s]
    keyed = {c for _, n, c in found if n and c is not None}
    assert {r.doc_id for r in kept if r.doc_id is not None and (r.text or "").split()} == keyed
    assert sum(not (r.text or "").split() for r in kept) == len(alone)
    words = [r.doc_id for r in kept if (r.text or "").split() and r.doc_id is not None]
    assert len(words) == len(set(words))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.join_components(empty).count() == 0
    assert ngram_join.first_of_components(empty).count() == 0


def test_two_components_of_a_tile_are_joined_by_one_pair_not_by_all():
    """100 against 100 members: the closest pair, whatever the number of members."""

    def made(members: int, wanted: str) -> list[tuple[int, int]]:
        size = 2 * members
        bits = np.zeros((size, 16), np.int64)
        bits[members:, 0] = 3  # every pair across differs in two bits, but for the last row's
        bits[-1, 0] = 1
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, 7)), pa.array(np.arange(size)), pa.array(np.repeat([0, members], members)),
             pa.array(np.full(size, 300)), pa.array(list(bits), pa.list_(pa.int64()))],
            ["key", "class", "component", "n", "bits"],
        )
        found = ngram_join._open_pairs(iter([batch]), wanted, ngram_join.Rule())
        return [(a, b) for part in found for a, b in zip(*(part.column(i).to_pylist() for i in (0, 1)))]

    assert made(100, ngram_join.CLOSEST) == [(0, 199)]
    assert len(made(100, ngram_join.ALL)) == 10_000
    assert len(made(400, ngram_join.CLOSEST)) <= 4
