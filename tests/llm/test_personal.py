"""Personal data: rules against plain expressions, the field by what it has not seen."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from plumbline.llm import personal_data as pd
from tests.llm import brute

EXPRESSIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checksum(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def plain(key, text):
    """(key, counts, digest) and the spans of the rules."""
    found = []
    for place, (kind, expression) in enumerate(EXPRESSIONS.items()):
        for m in re.finditer(expression, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".") if kind == "ip"),
                "card": 14 <= len(digits) <= 19 and checksum(digits), "phone": 10 <= len(digits) <= 15,
            }
            if good[kind]:
                found.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    spans = [s for _, _, s in sorted(found)]
    counts = [sum(p == k for _, p, _ in found) for k in range(4)]
    return (key, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest()), spans


def base(row):
    return tuple(row[:6])


def odd_texts():
    draw = random.Random(5)
    pieces = [
        "a", "@", ".", "..", "1", "255", "256", "007", "1.2.3.4", "+", "+4", "(", ")", " ", "-", "\n", "é", "x@y.z",
        "4111111111111111", "4111 1111-1111 1111", "+49 30 1234567", "%", "_", "a.b@c-d.e.f", "0.0.0.0.0", "١٢",
        "+1 (743) 555-3824", "5500005555555559", "٣", "\t",
    ]
    rows = [(i, "".join(draw.choices(pieces, k=draw.randrange(1, 25)))) for i in range(400)]
    rows += [
        (None, None), (None, "x@y.zz"), (900, ""), (901, "1" * 5000), (902, "4111111111111111 " * 300), (902, "a@b.c"),
        (902, "a@b.c"), (903, "x" * 50_000 + "@" + "y" * 5000), (904, "1.2.3.4." * 500), (905, "+1+2+33333333333"),
        (906, "a@b.c@d.e@f.g"), (907, "@a.b"), (908, "é" * 9 + " 4111111111111111"), (909, "0" * 300 + "1.2.3.4"),
    ]
    return rows


@pytest.fixture(scope="module")
def field():
    return pd.fit([pd._line_zone(*line) for line in pd.made_up_lines(1500)])


def test_rules_on_odd_texts(spark, field):
    rows = odd_texts()
    frame = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, n_ip int, key string")
    frame = frame.repartition(3)
    bare = pd.find(frame)
    assert bare.columns == ["doc_id", *(c.split()[0] for c in pd.SCHEMA.split(", "))]
    assert brute.ordered(base(r) for r in bare.collect()) == brute.ordered(plain(*r)[0] for r in rows)
    texts = {}
    for row in rows:
        texts.setdefault(row[0], []).append(row)
    for r in pd.find(frame, field=field).collect():
        found = [plain(*t) for t in texts[r.doc_id]]
        spans = next(s for b, s in found if b == base(r))
        listed = r.spans.split(",") if r.spans else []
        assert set(spans) <= set(listed)
        cells = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in listed]
        assert cells == sorted(cells, key=lambda c: (c[1], pd.KINDS.index(c[0])))
        added = [c for c in cells if f"{c[0]}:{c[1]}:{c[2]}" not in spans]
        for one in added:
            assert all(two is one or one[2] <= two[1] or two[2] <= one[1] for two in cells)
    assert pd.find(frame.limit(0), field=field).count() == 0
    assert pd.find(frame.withColumnRenamed("doc_id", "spans"), key="spans").columns[0] == "key"


def test_every_document(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = pd.op11_personal_data(spark, folder)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    found = got.collect()
    assert brute.ordered(base(r) for r in found) == brute.ordered(plain(k, t)[0] for k, t in rows.items())
    more = sum(len(r.spans.split(",")) - len(plain(r.doc_id, rows[r.doc_id])[1]) for r in found if r.spans)
    assert more <= 2  # these texts hold hardly anything the rules miss
    assert all(set(plain(r.doc_id, rows[r.doc_id])[1]) <= set(r.spans.split(",")) for r in found if r.spans)


def test_lines_not_seen_in_training(field):
    right = wrong = missed = 0
    for line in pd.made_up_lines(600, seed=77):
        options, spans = pd._line_zone(*line)
        found = set(pd.best_spans(field, options))
        right, wrong, missed = right + len(found & spans), wrong + len(found - spans), missed + len(spans - found)
    assert right > 500 and wrong <= 0.01 * right and missed <= 0.03 * right


def test_spans_the_rules_miss_and_decoys(field):
    def spans(text):
        data = np.frombuffer(text.encode(), np.uint8)
        _, more = pd.find_spans(np.array([0, len(data)]), data, field)
        return [(text.encode()[a:b].decode(), pd.KINDS[k]) for a, b, k in more[0]]

    assert spans("pay 4111111111111111 5500005555555559 now") == [
        ("4111111111111111", "card"), ("5500005555555559", "card"),
    ]
    assert spans("or +1 (826) 555-4081 190.137.223.20 there") == [("+1 (826) 555-4081", "phone")]
    assert spans("call (743) 555-3824 today") == [("(743) 555-3824", "phone")]
    assert spans("write to joe (at) example (dot) org please") == [("joe (at) example (dot) org", "email")]
    for clean in (
        "Licensed under the Apache License, Version 2.0.", "on 2024-01-15 at 10", "look at example.com",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "pages 100-200 of 1984", "4111111111111112",
        "He was at home. Dot was there.", "1 22 333 4444 55555", "999.300.999.999", "at dot at", "",
    ):
        assert spans(clean) == []


def test_best_spans_is_the_best_of_all(field):
    draw = np.random.default_rng(2)
    names = {"a": 0, "b": 1, "c": 2}
    for _ in range(60):
        weights = pd.Field(names, draw.normal(1, 2, (4, 3)))
        options = []
        for _ in range(7):
            start = int(draw.integers(0, 12))
            kinds = (0,) if draw.random() < 0.3 else (1, 2, 3)
            options.append(pd.Option(start, start + int(draw.integers(1, 5)), kinds, [draw.choice(list("abcx"))]))
        best = 0.0
        arcs = [(o.start, o.end, weights.score(o, k) - 0.5) for o in options for k in o.kinds]
        arcs = [a for a in arcs if a[2] > 0]
        for size in range(1, 5):
            for some in itertools.combinations(sorted(arcs), size):
                if all(x[1] <= y[0] for x, y in itertools.pairwise(some)):
                    best = max(best, sum(a[2] for a in some))
        chosen = pd.best_spans(weights, options, margin=0.5)
        got = sum(
            max(weights.score(o, k) - 0.5 for o in options if (o.start, o.end) == (a, b) and k in o.kinds)
            for a, b, k in chosen
        )
        assert got == pytest.approx(best)


def test_fit_raises_the_likelihood_of_the_truth():
    """Weights from one small zone against the likelihood over all its segmentations."""
    options = [pd.Option(0, 2, (1, 2), ["a"]), pd.Option(2, 4, (1,), ["b"]), pd.Option(1, 3, (2,), ["a", "b"])]
    truth = {(0, 2, 1), (2, 4, 1)}
    arcs = [(o.start, o.end, k, o) for o in options for k in o.kinds]

    def loss(field):
        total, own = [], 0.0
        for size in range(4):
            for some in itertools.combinations(arcs, size):
                some = sorted(some, key=lambda a: a[0])
                if all(x[1] <= y[0] for x, y in itertools.pairwise(some)):
                    score = sum(field.score(o, k) for _, _, k, o in some)
                    total.append(score)
                    if {a[:3] for a in some} == truth:
                        own = score
        return np.log(np.sum(np.exp(total))) - own + 0.01 * (field.weights**2).sum()

    fitted = pd.fit([(options, truth)], steps=400, rate=0.05)
    least = loss(fitted)
    draw = np.random.default_rng(0)
    for _ in range(50):
        moved = pd.Field(fitted.names, fitted.weights + draw.normal(0, 0.05, fitted.weights.shape))
        assert loss(moved) >= least - 1e-3


def test_redaction(spark, field):
    rows = [(1, "é write a@b.c or +1 (826) 555-4081 190.137.223.20."), (2, "nothing"), (3, "+12345678901234 x")]
    got = {r.doc_id: r.redacted for r in pd.find(spark.createDataFrame(rows, "doc_id long, text string"), field=field).collect()}
    assert got[1] == "é write <email> or <phone> <ip>." and got[2] == "nothing"
    assert re.sub("<[a-z]+>", "", got[3]) == " x"
