"""Pruned intersections against the full lattice, and metrics from merged states against plain ones."""

import itertools

import numpy as np
import pytest

from plumbline.config import FairnessConfig
from plumbline.operators import groups, lattice, mergeable
from plumbline.plans.audit import audit

ATTRIBUTES = ["a", "b", "c", "d"]


def people(n=6000, seed=3):
    """A rate that depends on a and b together and on nothing else; d has one large value only."""
    draw = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        a, b, c = (str(draw.choice(list(x))) for x in ("xy", "pq", "mn"))
        d = "big" if draw.random() < 0.995 else f"tiny{draw.integers(0, 20)}"
        rate = 0.9 if (a, b) == ("x", "p") else 0.4
        rows.append((a, b, c, d, int(draw.random() < 0.5), int(draw.random() < rate)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, c string, d string, t int, p int").repartition(5)


def plain_sets(rows, tolerance, least=30):
    """{members: kept} of the sets looked at."""

    def cells(members):
        out = {}
        for row in rows:
            out.setdefault(tuple(row[i] for i in members), []).append(row)
        return out

    def rates(some):
        t, p = np.array([r[4] for r in some]), np.array([r[5] for r in some])
        return p.mean(), (p[t == 1].mean() if (t == 1).any() else 0), (p[t == 0].mean() if (t == 0).any() else 0)

    measured = {
        m: {k: (len(v), rates(v)) for k, v in cells(m).items()}
        for size in (1, 2, 3) for m in itertools.combinations(range(4), size)
    }
    seen, open_sets = {}, set()
    for m in measured:
        parents = list(itertools.combinations(m, len(m) - 1)) if len(m) > 1 else []
        if not all(x in open_sets for x in parents):
            continue
        large = {k: v for k, v in measured[m].items() if v[0] >= least}
        changed = len(large) if len(m) == 1 else 0
        for key, (_, own) in large.items():
            if len(m) == 1:
                break
            above = [measured[x][tuple(v for i, v in zip(m, key) if i in x)][1] for x in parents]
            changed += any(
                own[r] < min(u[r] for u in above) - tolerance or own[r] > max(u[r] for u in above) + tolerance
                for r in range(3)
            )
        seen[m] = len(m) == 1 or changed > 0
        if seen[m] and large:
            open_sets.add(m)
    return seen


@pytest.mark.parametrize("tolerance", [0.0, 0.02, 0.05, 0.6])
def test_sets_looked_at(spark, tolerance):
    rows = people()
    config = FairnessConfig(intersection_tolerance=tolerance)
    counts = groups.additive_counts(frame(spark, rows), "t", "p", ATTRIBUTES)
    kept, facts = lattice.pruned_counts(counts, ATTRIBUTES, config)
    wanted = {"_&_".join(ATTRIBUTES[i] for i in m): keeps for m, keeps in plain_sets(rows, tolerance).items()}
    assert {f.attribute: f.kept for f in facts} == wanted
    # What is kept is what the full roll-up says of those sets.
    names = [name for name, keeps in wanted.items() if keeps]
    full = groups.group_counts(counts, ATTRIBUTES, 3).filter(groups.F.col("attribute").isin(names))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, full.collect()))
    if tolerance == 0.6:
        assert len(facts) == 10 and len(names) == 4


def test_audit_finds_the_same_in_what_is_left(spark):
    rows = frame(spark, people())
    full = audit(rows, "t", "p", ATTRIBUTES)
    config = FairnessConfig(intersection_tolerance=0.05)
    some = audit(rows, "t", "p", ATTRIBUTES, config)
    names = some.dataset_info["groups_analyzed"]
    assert "a_&_b" in names and len(names) < len(full.dataset_info["groups_analyzed"])
    columns = ["metric", "attribute", "value", "severity", "interpretation"]
    found = sorted(map(tuple, some.violations.select(*columns).collect()))
    assert found == sorted(tuple(r) for r in full.violations.select(*columns).collect() if r.attribute in names)
    assert any(r[1] == "a_&_b" for r in found)


def test_values_that_hold_the_separator_stay_apart(spark):
    rows = [("x_y", "z", "m", "big", 1, 1)] * 40 + [("x", "y_z", "m", "big", 1, 0)] * 40
    config = FairnessConfig(intersection_tolerance=0.0)
    counts = groups.additive_counts(frame(spark, rows), "t", "p", ATTRIBUTES)
    kept, _ = lattice.pruned_counts(counts, ATTRIBUTES, config)
    assert sorted(r.n for r in kept.collect() if r.attribute == "a") == [40, 40]


def plain_auc(truth, score, bins):
    place = np.clip((score * bins).astype(int), 0, bins - 1)
    pairs = [(p > n) + 0.5 * (p == n) for p in place[truth == 1] for n in place[truth == 0]]
    return float(np.mean(pairs)) if pairs else None


def plain_error(truth, score, bins):
    place = np.clip((score * bins).astype(int), 0, bins - 1)
    off = [abs(score[place == b].sum() - truth[place == b].sum()) for b in range(bins)]
    return float(sum(off) / len(score))


class Longest:
    """A metric of a user: the longest gap between scores of label 1, as (least, greatest, ...) sets."""

    def zero(self):
        return set()

    def update(self, state, y_true, score):
        return state | set(np.round(score[y_true == 1], 1).tolist())

    def merge(self, one, two):
        return one | two

    def finish(self, state):
        return max(state) - min(state) if state else None


def test_merged_metrics(spark, monkeypatch):
    draw = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        # One group holds two thirds of all rows.
        sex = "f" if i % 3 else [None, "m", "only"][int(draw.integers(0, 3))]
        t = 1 if sex == "only" else int(draw.integers(0, 2))
        score = [None, float("nan"), 1.0, 0.0, float(draw.random() * 0.7 + 0.3 * t)][min(4, int(draw.integers(0, 30)))]
        rows.append((sex, str(i % 2), None if draw.random() < 0.02 else t, score))
    df = spark.createDataFrame(rows, "sex string, half string, t int, s double").repartition(7)
    metrics = {"auc": mergeable.AreaUnderCurve(50), "error": mergeable.CalibrationError(8), "range": Longest()}
    monkeypatch.setattr(mergeable, "HELD_GROUPS", 1)
    got = mergeable.group_values(df, "t", "s", ["sex", "half"], metrics, depth=2)
    assert got.columns == ["attribute", "grp", "n", *metrics]
    wanted = {}
    for sex, half, t, s in rows:
        if t is None or s is None or s != s:
            continue
        sex = sex or "nan"
        for key in (("sex", sex), ("half", half), ("sex_&_half", f"{sex}_{half}")):
            wanted.setdefault(key, []).append((t, s))
    found = {(r.attribute, r.grp): r for r in got.collect()}
    assert set(found) == set(wanted)
    for key, cells in wanted.items():
        truth, score = np.array([c[0] for c in cells]), np.array([c[1] for c in cells])
        row = found[key]
        assert row.n == len(cells)
        auc = plain_auc(truth, score, 50)
        assert row.auc is None if auc is None else row.auc == pytest.approx(auc)
        assert row.error == pytest.approx(plain_error(truth, score, 8))
        ones = np.round(score[truth == 1], 1)
        assert row.range == pytest.approx(ones.max() - ones.min())
    assert found["sex", "only"].auc is None
    assert mergeable.group_values(df.limit(0), "t", "s", ["sex"], metrics).count() == 0
