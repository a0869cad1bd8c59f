"""Conversation repair against all edits of short conversations."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from plumbline.llm import conversation_repair as cr
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string"
FORM = re.compile(r"(s?(ua)+)?\Z")
COLUMNS = ["conv_id", *cr.COUNTS, "audit", "repaired_sha256"]


def plain_faults(rows):
    """Fault of each (role, text) in order."""
    seen = set()
    for role, text in rows:
        core = brute.WORD.findall(text)
        if not core:
            yield "blank"
        elif (role, text) in seen:
            yield "duplicate"
        else:
            yield "truncated" if core[-1][-1] not in ".!?" else None
        seen.add((role, text))


def plain_repair(rows):
    """(cost, audit, repaired rows): edits in order of cost and letters until roles have the form."""
    faults = list(plain_faults(rows))
    heap = [(0, "", 0, "", [])]
    reached = set()
    while True:
        cost, audit, at, letters, out = heapq.heappop(heap)
        if at == len(rows) and FORM.match(letters):
            return cost, audit, out
        if (at, letters[-1:], len(letters) == 0) in reached:
            continue
        reached.add((at, letters[-1:], len(letters) == 0))
        options = [("I", cost + 2, at, role, "") for role in ("user", "assistant")]
        if at < len(rows):
            role, text = rows[at]
            options.append(("D", cost + 3, at + 1, None, None))
            if faults[at] not in ("blank", "duplicate"):
                more = faults[at] == "truncated"
                options.append(("K", cost + more, at + 1, role, text))
                options += [("R", cost + 2 + more, at + 1, r, text) for r in ("user", "assistant")]
        for edit, price, after, role, text in options:
            line = letters if role is None else letters + (role[:1] or "?")
            if re.match(r"(s?(ua)*u?)?\Z", line):  # the beginning of a form
                heapq.heappush(heap, (price, audit + edit, after, line, out if role is None else [*out, (role, text)]))


def plain(given, damage=True):
    """Rows of the query by following its text."""
    groups = collections.defaultdict(list)
    for conv, turn, role, text in given:
        role, text = (" " if x is None else x for x in (role, text))
        parts = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(parts).encode()) % 20 if damage else 19
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        order = (turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest())
        groups[conv] += [(order, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, rows in groups.items():
        rows = sorted(rows, key=lambda r: r[0])
        turns = [t for _, t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        lines = [(role, text) for _, _, role, text in rows]
        faults = collections.Counter(plain_faults(lines))
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(lines)]
        cost, audit, out = plain_repair(lines)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        yield (conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"],
               sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def odd_conversations():
    draw = random.Random(9)
    rows = []
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["One.", "Two!", "cut off", " \t\n\x0b\x0c\r", "", None, 'Said "so."', "é?", "…", "end.\n", "x" * 5000]
    for conv in [None, *range(60)]:
        for _ in range(draw.randrange(1, 12)):
            turn = draw.choice([None, draw.randrange(9), draw.randrange(9), draw.randrange(9)])
            rows += [(conv, turn, draw.choice(roles), draw.choice(texts))] * draw.choice([1, 1, 1, 1, 3])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, conv string, part int").repartition(5)


@pytest.mark.parametrize("seed", range(3))
def test_search_finds_the_least(seed):
    draw = random.Random(seed)
    names = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    for _ in range(150):
        codes = bytes(
            draw.randrange(4) + draw.choice([0, 0, cr.CUT, cr.GOES]) for _ in range(draw.randrange(9))
        )
        rows = []
        for i, c in enumerate(codes):
            rows.append((names[c & 3], "" if c & cr.GOES else f"{i}" + ("" if c & cr.CUT else ".")))
        cost, audit, _ = plain_repair(rows)
        assert cr.search(codes) == (cost, audit)
        # Cut anywhere, the parts give the same.
        cut = draw.randrange(len(codes) + 1)
        joined = min(
            (a[0] + b[0], a[1] + b[1])
            for s in cr.STATES
            if (a := cr.search(codes[:cut], 0, (s,)))[0] < 1 << 50
            if (b := cr.search(codes[cut:], s))
        )
        assert joined == (cost, audit)


def test_long_conversations_are_searched_once():
    draw = random.Random(1)
    codes = bytes(draw.randrange(4) + draw.choice([0, 0, cr.CUT, cr.GOES]) for _ in range(30_000))
    cost, audit = cr.search(codes)
    assert sum(audit.count(x) for x in "DKR") == len(codes) and cost > 0


def test_odd_rows(spark):
    rows = odd_conversations()
    got = cr.repair(frame(spark, rows))
    assert got.columns == COLUMNS
    assert brute.ordered(got.collect()) == brute.ordered(plain(rows, damage=False))
    lines = collections.defaultdict(list)
    for r in cr.repaired(frame(spark, rows)).orderBy("conv_id", "turn").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for r in got.collect():
        assert hashlib.sha256("\n".join(lines[r.conv_id]).encode()).hexdigest() == r.repaired_sha256


def test_a_conversation_over_many_tasks(spark):
    """One conversation of all but a few rows is searched in parts."""
    draw = random.Random(4)
    rows = [(7, t // 2, draw.choice(["user", "assistant", "system"]), f"{draw.randrange(300)}.") for t in range(600)]
    rows += [(c, t, "user", "a.") for c in (1, 9) for t in range(3)]
    given = frame(spark, rows)
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")
    try:
        parts = cr._stream(given, ("conv_id", "turn", "role", "text"), given)
        assert parts.where("conv = 7 and phase = 1").count() > 1
        assert brute.ordered(cr.repair(given).collect()) == brute.ordered(plain(rows, damage=False))
    finally:
        spark.conf.unset(small)


def test_nothing_left(spark):
    rows = frame(spark, [(1, 0, "user", "a."), (None, 0, "user", "b.")])
    got = cr.repair(rows.where("turn > 0"), given=rows)
    digest = hashlib.sha256(b"").hexdigest()
    assert brute.ordered(got.collect()) == brute.ordered([(k, 0, 0, 0, 0, 0, 0, "", digest) for k in (1, None)])
    assert cr.repair(rows.limit(0)).count() == 0
    alone = cr.repair(frame(spark, [(1, 0, "system", " ")])).first()
    assert (alone.cost, alone.audit, alone.repaired_sha256) == (3, "D", digest)


def test_every_conversation(spark):
    folder = "/root/testdata/sf0.001"
    given = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(*SCHEMA.split()[::2]).collect()]
    got = cr.op12_conversation_repair(spark, folder)
    found = {r[0]: r for r in plain(given)}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    wanted = [found.get(conv, (conv, *empty)) for conv in {r[0] for r in given}]
    assert brute.ordered(got.collect()) == brute.ordered(wanted)
