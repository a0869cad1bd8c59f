"""The n-gram Jaccard join under other shingle lengths and limits than op2's."""

import itertools
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from plumbline.llm import ngram_join
from plumbline.llm.shingles import bitmap, linked, overlap_possible, set_hash, tile_keys
from tests.llm import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WIDER = ngram_join.Rule(5, (80, 100))


def sets_by(rows, shingle):
    for _, text in rows:
        words = brute.WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if len(words) >= shingle:
            yield {tuple(words[k : k + shingle]) for k in range(len(words) - shingle + 1)}
        else:
            yield {tuple(words)} if words else set()


def components_by(rows, rule):
    """doc_id and least doc_id of its component; a component is found by walking the links."""
    sets = list(sets_by(rows, rule.shingle))
    least, whole = rule.least
    near = {i: [] for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and whole * both >= least * (len(sets[i]) + len(sets[j]) - both):
            near[i].append(j)
            near[j].append(i)
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        yield rows[i][0], len(sets[i]), min(rows[k][0] for k in seen)


def copies_between_the_limits():
    """Texts with an appended block, a part cut off or scattered edits, and the bases they come from."""
    draw = random.Random(11)
    rows = []
    for n in (12, 40, 150, 400):
        for _ in range(4):
            base = [f"w{draw.randrange(5000)}" for _ in range(n)]
            more = [f"w{draw.randrange(5000)}" for _ in range(n)]
            edited = [f"e{draw.randrange(99)}" if draw.random() < 0.02 else w for w in base]
            rows += [base, base + more[: n * 18 // 100], base[: n * 85 // 100], edited, base + more[: n * 40 // 100]]
    rows += [["a"], ["A"], ["a", "b", "c", "d"], ["a", "b", "c", "d", "e"], []]
    draw.shuffle(rows)
    return [(i, " ".join(words)) for i, words in enumerate(rows)]


@pytest.mark.parametrize("rule", [WIDER, ngram_join.Rule(5, (50, 100)), ngram_join.Rule(2, (1, 1))])
def test_components_under_other_rules(spark, rule):
    rows = copies_between_the_limits()
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rule=rule)
    assert brute.ordered(got.collect()) == brute.ordered(
        (key, n, least if n else key) for key, n, least in components_by(rows, rule)
    )


def test_the_stage_under_five_words_and_four_fifths(spark):
    rows = copies_between_the_limits()
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], COLUMNS).repartition(3)
    left = corpus_pipeline.keep_one_of_near_copies(spark, docs, "", WIDER)
    kept = {r.doc_id for r in left.collect()}
    assert kept == {least for _, _, least in components_by(rows, WIDER)}
    assert kept < {least for _, _, least in components_by(rows, ngram_join.Rule())}


@pytest.mark.parametrize("least", [(80, 100), (50, 100), (30, 100)])
def test_linked_sets_share_a_tile(least):
    draw = np.random.default_rng(1)
    seen = 0
    for _ in range(1500):
        n = int(draw.integers(1, 300))
        pool = draw.integers(0, 1 << 63, n * 5, dtype=np.uint64) * np.uint64(2)
        apart = n * (least[1] - least[0]) // least[0]  # what the smaller one can miss or the larger have beyond it
        gone, more = int(draw.integers(0, min(n, apart + 1))), int(draw.integers(0, apart + 1))
        one, two = np.unique(pool[:n]), np.unique(np.concatenate((pool[: n - gone], pool[n : n + more])))
        if linked(one, two, least):
            seen += 1
            words = [np.unpackbits(bitmap(x).view(np.uint8)) for x in (one, two)]
            if len(words[0]) == len(words[1]):
                assert overlap_possible(len(one), len(two), int((words[0] != words[1]).sum()), least)
            assert len(np.intersect1d(tile_keys(one, least), tile_keys(two, least))) or set_hash(one) == set_hash(two)
    assert seen > 50


def test_rules_that_make_no_sense():
    for shingle, least in ((0, (9, 10)), (3, (0, 1)), (3, (11, 10))):
        with pytest.raises(ValueError):
            ngram_join.Rule(shingle, least)


@pytest.mark.parametrize("least", [(90, 100), (80, 100)])
def test_unrelated_sets_do_not_meet_in_empty_parts(least):
    draw = np.random.default_rng(4)
    sizes = draw.integers(30, 900, 300)
    tiles = [np.unique(tile_keys(np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)), least)) for n in sizes]
    keys, times = np.unique(np.concatenate(tiles), return_counts=True)
    assert (times == 1).all() and len(keys) > 300


def test_copies_among_documents_that_share_passages(spark):
    """Most tiles of these documents are crowded; no link may be lost with those they leave."""
    draw = random.Random(21)
    passages = [[f"p{k}_{i}" for i in range(60)] for k in range(3)]
    rows = []
    for _ in range(50):
        own = [f"w{draw.randrange(9000)}" for _ in range(draw.choice([20, 60, 150]))]
        body = own + [w for p in passages[: draw.randrange(4)] for w in p]
        rows += [body, [f"e{draw.randrange(99)}" if draw.random() < 0.02 else w for w in body]]
        rows += [body[: len(body) * 88 // 100]]
    draw.shuffle(rows)
    rows = [(i, " ".join(words)) for i, words in enumerate(rows)]
    for rule in (WIDER, ngram_join.Rule(5, (60, 100))):
        got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rule=rule)
        assert brute.ordered(got.collect()) == brute.ordered(
            (key, n, least if n else key) for key, n, least in components_by(rows, rule)
        )
