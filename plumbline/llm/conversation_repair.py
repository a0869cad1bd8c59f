"""Repair of conversation structure by branch and bound.

Every conversation gets the cheapest edits after which an optional system turn is followed by pairs
of user and assistant turns. Rows travel to the search as one byte each (first letter of the role,
fault); texts follow only when the edits are known. Codes are sorted by conversation and turn over
ranges, so a conversation may lie in several tasks: each searches its part for every state the
conversation can be in before and after it, and the parts are then joined like matrices. What holds
all rows of a conversation is only the stream that writes it out, one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.storage import pin
from plumbline.llm.tables import read

# Letters of the audit in ASCII order, and what an edit costs.
DELETE, INSERT, KEEP, REROLE = "DIKR"
COSTS = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
TRUNCATED_COST = 1

# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES = range(4)
DONE = (0, 3)
#: State after an inserted or reroled turn; it is the user's unless it leads to state 3.
WRITTEN = (2, 2, 3, 2)
#: State after a kept turn by its code's letter (system, user, assistant, other).
KEPT = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
LETTERS = "sua"
LEGAL = {"su", "ua", "au"}

# Code of a row: letter, plus a bit for text cut off and one for rows that must go.
CUT, GOES = 4, 8
BLANK, REPEATED, WHOLE = "blank", "duplicate", "whole"
WHITE = " \t\n\x0b\x0c\r"


def suffix_bounds(codes: bytes, exits: Iterable[int]) -> list[int]:
    """Lower bound of the cost from each row and state on, 4 entries a row; no prefix matters."""
    never = 1 << 60
    last = [0 if s in exits else never for s in STATES]
    for _ in range(2):
        last = [min(last[s], COSTS[INSERT] + last[WRITTEN[s]]) for s in STATES]
    out = [last]
    for code in reversed(codes):
        after = out[-1]
        eaten = []
        for s in STATES:
            cost = COSTS[DELETE] + after[s]
            if code < GOES:
                extra = TRUNCATED_COST if code & CUT else 0
                cost = min(cost, COSTS[REROLE] + extra + after[WRITTEN[s]])
                kept = KEPT[s][code & 3]
                if kept is not None:
                    cost = min(cost, extra + after[kept])
            eaten.append(cost)
        now = eaten
        for _ in range(2):
            now = [min(eaten[s], COSTS[INSERT] + now[WRITTEN[s]]) for s in STATES]
        out.append(now)
    return [cost for row in reversed(out) for cost in row]


def search(codes: bytes, entry: int = 0, exits: Iterable[int] = DONE) -> tuple[int, str]:
    """Least cost and its ASCII-least audit from state ``entry`` to one of ``exits``.

    Depth-first over an explicit stack, edits in ASCII order. A node goes if its cost and the bound
    of its suffix exceed the limit, or if its row and state were reached as cheaply before: prefixes
    of equal cost are visited in ASCII order and none is the beginning of another. The first leaf
    within the limit is the incumbent; from then on only cheaper nodes count, until none is left.
    """
    exits, end = set(exits), len(codes)
    bound = suffix_bounds(codes, exits)
    cheapest = [1 << 60] * (4 * end + 4)
    limit, incumbent = bound[entry], -1
    parents, edits = [-1], [""]
    stack = [(0, entry, 0, 0)]
    while stack:
        row, state, cost, node = stack.pop()
        place = 4 * row + state
        if cost + bound[place] > limit or cost >= cheapest[place]:
            continue
        cheapest[place] = cost
        if row == end and state in exits:
            incumbent, limit = node, cost - 1
            continue
        children = [(row, WRITTEN[state], cost + COSTS[INSERT], INSERT)]
        if row < end:
            code = codes[row]
            children.append((row + 1, state, cost + COSTS[DELETE], DELETE))
            if code < GOES:
                extra = TRUNCATED_COST if code & CUT else 0
                children.append((row + 1, WRITTEN[state], cost + COSTS[REROLE] + extra, REROLE))
                kept = KEPT[state][code & 3]
                if kept is not None:
                    children.append((row + 1, kept, cost + COSTS[KEEP] + extra, KEEP))
        for child, after, price, edit in sorted(children, key=lambda c: c[3], reverse=True):
            if price + bound[4 * child + after] <= limit:
                parents.append(node)
                edits.append(edit)
                stack.append((child, after, price, len(edits) - 1))
    audit = []
    while incumbent > 0:
        audit.append(edits[incumbent])
        incumbent = parents[incumbent]
    return bound[entry], "".join(reversed(audit))


# --- preparing rows --------------------------------------------------------------------------


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct rows with how often they occur; null roles and texts are one blank."""
    cells = [
        df[conv].alias("conv"), df[turn].cast("long").alias("turn"),
        F.coalesce(df[role].cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(df[text].cast("string"), F.lit(" ")).alias("text"),
    ]
    # Copies of a row, however many, are one row from here on.
    grouped = df.select(*cells).groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    return pin(grouped.withColumn("digest", F.md5("text")))


def _codes(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, n, letter, fault, cut) without texts."""
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    bare = rows.select(
        "conv", "turn", "role", "digest", "n",
        (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    first = rows.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(
        F.min("turn").alias("first_turn"), F.max(F.col("turn").isNull()).alias("unnumbered")
    )
    same = bare["conv"].eqNullSafe(first["c"]) & (bare["role"] == first["r"]) & (bare["digest"] == first["d"])
    leads = F.col("turn").isNull() | (~F.col("unnumbered") & (F.col("turn") == F.col("first_turn")))
    fault = F.when(F.col("blank"), BLANK).when(~leads, REPEATED).otherwise(WHOLE)
    return bare.join(first, same).select(
        "conv", "turn", "role", "digest", "n", F.substring("role", 1, 1).alias("letter"),
        fault.alias("fault"), (F.col("cut") & (fault == WHOLE)).alias("cut"),
    )


ORDER = ("conv", "phase", "part", "turn", "role", "digest")
PART = (
    "part int, blank long, duplicate long, truncated long, illegal long, first_letter string, "
    "last_letter string, first_turn long, last_turn long, turns long, "
    "paths array<struct<entry:int,exit:int,cost:long,audit:string>>"
)


class _Part:
    """Rows of one conversation in one task: counts, and a byte a row."""

    def __init__(self) -> None:
        self.codes = bytearray()
        self.counts = dict.fromkeys((BLANK, REPEATED, "truncated", "illegal"), 0)
        self.first_letter = self.last_letter = None
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn: int | None, letter: str, n: int, fault: str, cut: bool) -> None:
        code = LETTERS.find(letter) if letter else -1
        code = 3 if code < 0 else code
        self.codes.append(code + (CUT if cut else 0) + (0 if fault == WHOLE else GOES))
        self.codes.extend(bytes([code + GOES]) * (n - 1))
        if fault != WHOLE:
            self.counts[fault] += n
        else:
            self.counts["truncated"] += cut
            self.counts[REPEATED] += n - 1
        if self.last_letter is not None:
            self.counts["illegal"] += self.last_letter + letter not in LEGAL
        else:
            self.first_letter = letter
        self.counts["illegal"] += n - 1  # a letter beside itself is never legal
        self.last_letter = letter
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1

    def row(self, conv, part: int, whole: bool) -> dict:
        codes = bytes(self.codes)
        if whole:
            paths = [(0, 0, *search(codes))]
        else:
            paths = [(a, b, *search(codes, a, (b,))) for a in STATES for b in self._reached(a)]
        return {
            "conv": conv, "part": part, "blank": self.counts[BLANK], "duplicate": self.counts[REPEATED],
            "truncated": self.counts["truncated"], "illegal": self.counts["illegal"],
            "first_letter": self.first_letter, "last_letter": self.last_letter,
            "first_turn": self.first_turn, "last_turn": self.last_turn, "turns": self.turns,
            "paths": [dict(zip(("entry", "exit", "cost", "audit"), p)) for p in paths],
        }

    def _reached(self, entry: int) -> list[int]:
        """States a conversation can be in after this part: never back in an earlier one."""
        kept = {KEPT[entry][c & 3] for c in self.codes if c < GOES} if entry == 0 else set()
        return sorted({entry, 2, 3} | ({1} & kept))


def _search_parts(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a task, whose rows arrive in order.

    The first and the last conversation of a task may go on in its neighbours.
    """
    number = TaskContext.get().partitionId()
    done: list[dict] = []
    conv, part, first = None, None, True
    for batch in batches:
        cells = (batch.column(i).to_pylist() for i in range(batch.num_columns))
        for key, turn, _, _, n, letter, fault, cut in zip(*cells):
            if part is None or key != conv:
                if part is not None:
                    done.append(part.row(conv, number, whole=not first))
                    first = False
                conv, part = key, _Part()
            part.add(turn, letter, n, fault, cut)
        if len(done) > 4096:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if part is not None:
        done.append(part.row(conv, number, whole=False))
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


# --- writing conversations out ---------------------------------------------------------------


class _Writer:
    """Puts a conversation's parts together, then replays its edits on the rows that follow."""

    def __init__(self) -> None:
        self.reached = {0: (0, "")}
        self.counts = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0)
        self.last_letter = self.first_turn = self.last_turn = None
        self.turns = 0
        self.at, self.state = 0, 0
        self.closed = False

    def part(self, row: dict) -> None:
        found: dict[int, tuple[int, str]] = {}
        for path in row["paths"]:
            if path["entry"] in self.reached:
                cost, audit = self.reached[path["entry"]]
                option = (cost + path["cost"], audit + path["audit"])
                found[path["exit"]] = min(found.get(path["exit"], option), option)
        self.reached = found
        for name in ("blank", "duplicate", "truncated", "illegal"):
            self.counts[name] += row[name]
        if self.last_letter is not None:
            self.counts["illegal"] += self.last_letter + row["first_letter"] not in LEGAL
        self.last_letter = row["last_letter"]
        if row["turns"]:
            self.turns += row["turns"] - (row["first_turn"] == self.last_turn)
            self.first_turn = row["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = row["last_turn"]

    def close(self) -> None:
        self.cost, self.audit = min(self.reached[s] for s in DONE if s in self.reached)
        if self.turns:
            self.counts["gaps"] = self.last_turn - self.first_turn + 1 - self.turns
        self.closed = True

    def _written(self) -> str:
        self.state = WRITTEN[self.state]
        return "assistant" if self.state == 3 else "user"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == INSERT:
            self.at += 1
            yield self._written(), ""

    def rows(self, role: str, text: str, n: int) -> Iterator[tuple[str, str]]:
        for _ in range(n):
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit == KEEP:
                letter = LETTERS.find(role[:1]) if role else -1
                self.state = KEPT[self.state][letter]
                yield role, text
            elif edit == REROLE:
                yield self._written(), text


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, writer, role, text) for every row of the result, and (…, None, None) at its end."""
    conv, writer = None, None

    def finish() -> Iterator[tuple]:
        if not writer.closed:
            writer.close()
        for role, text in writer.inserted():
            yield conv, writer, role, text
        yield conv, writer, None, None

    for batch in batches:
        for row in batch.to_pylist():
            if writer is None or row["conv"] != conv:
                if writer is not None:
                    yield from finish()
                conv, writer = row["conv"], _Writer()
            if row["phase"] == 1:
                writer.part(row)
            elif row["phase"] == 2:
                if not writer.closed:
                    writer.close()
                for role, text in writer.rows(row["role"], row["text"], row["n"]):
                    yield conv, writer, role, text
    if writer is not None:
        yield from finish()


def _stream(df: DataFrame, names: tuple[str, str, str, str], given: DataFrame) -> DataFrame:
    """Per conversation: its name (of ``given``), its searched parts, its rows with texts."""
    rows = _rows(df, *names)
    order = ("conv", "turn", "role", "digest")
    ranged = _codes(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    conv = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {conv}, {PART}"
    arrow = _arrow(df.sparkSession, schema)
    parts = ranged.mapInArrow(lambda batches: _search_parts(batches, arrow), schema)
    texts = rows.withColumn("phase", F.lit(2))
    named = given.select(given[names[0]].alias("conv")).distinct().withColumn("phase", F.lit(0))
    together = parts.withColumn("phase", F.lit(1)).unionByName(texts, allowMissingColumns=True)
    together = together.unionByName(named, allowMissingColumns=True)
    return together.repartition("conv").sortWithinPartitions(*ORDER)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SUMMARY = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def repair(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    given: DataFrame | None = None,
) -> DataFrame:
    """Faults of every conversation and its cheapest repair.

    Rows count by turn, null turns first, ties by role and a digest of the text; a null role or text
    is one blank. A row's fault is blank (no word character), else duplicate (role and text seen
    earlier in the conversation), else truncated (its last such character is none of ``.!?``). Edits:
    Keep 0; Rerole to user or assistant 2; Delete 3, required for blank and duplicate rows; Insert an
    empty user or assistant turn 2; a truncated row that stays adds 1. First letters of roles must
    then read ``(s?(ua)+)?``. Returns conv_id, gaps (missing turn numbers), blank, duplicate,
    truncated, illegal (neighbouring letters other than su, ua, au), cost, audit (first letters of
    the cheapest edits in order, ties ASCII-least) and repaired_sha256 (lines ``role:text``).

    ``given`` names the conversations to report (default: those of ``df``); one without rows has
    zeros, an empty audit and the digest of nothing. A null conversation is one of its own. Repeated
    rows are duplicates of the first. Other columns are not read. An empty table gives an empty
    result. A task holds a byte for each row of its range and one row's text at a time.
    """
    names = (conv, turn, role, text)
    given = df if given is None else given
    kind = given.schema[conv].dataType.simpleString()
    schema = f"conv {kind}, {SUMMARY}"
    arrow = _arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, digest, empty = [], hashlib.sha256(), True
        for key, writer, name, words in _replayed(batches):
            if name is not None:
                digest.update(f"{'' if empty else chr(10)}{name}:{words}".encode())
                empty = False
                continue
            done.append(
                {"conv": key, **writer.counts, "cost": writer.cost, "audit": writer.audit,
                 "repaired_sha256": digest.hexdigest()}
            )
            digest, empty = hashlib.sha256(), True
            if len(done) > 4096:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, arrow)

    return _stream(df, names, given).mapInArrow(run, schema).withColumnRenamed("conv", conv)


def repaired(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The rows of every repaired conversation: conv_id, turn (from 0), role, text; as ``repair`` says."""
    kind = df.schema[conv].dataType.simpleString()
    schema = f"conv {kind}, turn long, role string, text string"
    arrow = _arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, place, size = [], 0, 0
        for key, _, name, words in _replayed(batches):
            if name is None:
                place = 0
                continue
            done.append({"conv": key, "turn": place, "role": name, "text": words})
            place, size = place + 1, size + len(words)
            if len(done) > 4096 or size > 1 << 22:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done, size = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, arrow)

    return _stream(df, (conv, turn, role, text), df).mapInArrow(run, schema).toDF(conv, "turn", "role", "text")


def damaged(df: DataFrame) -> DataFrame:
    """The query's own damage: rows dropped, emptied, cut off, repeated or given another role."""
    cells = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in df.columns}
    kind = F.crc32(F.concat(cells["conv_id"], F.lit(":"), cells["turn"])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(cells["text"], "[.!?]", "")).otherwise(cells["text"])
    times = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return df.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(cells["role"]).alias("role"),
        text.alias("text"), times.alias("time"),
    ).drop("time")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage to its rows."""
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damaged(given), given=given)


def _edited(state: str, cost: str, edit: str, line: str | None = None) -> str:
    out = f"{state}.o" if line is None else f"list_append({state}.o, {line})"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'o': {out}}}"


def _inserted(state: str, role: str) -> str:
    return _edited(state, "2", "I", f"'{role}:'")


def _kept(state: str, letter: str) -> str:
    return f"CASE WHEN r.l = '{letter}' AND NOT r.f THEN {_edited(state, 'r.x', 'K', 'r.line')} END"


def _reroled(state: str, role: str) -> str:
    line = f"'{role}:' || r.text"
    return f"CASE WHEN NOT r.f THEN {_edited(state, '2 + r.x', 'R', line)} END"


_CLOSED = f"""least(v2, {_inserted('v0', 'user')}, {_inserted('v1', 'user')}, {_inserted('v3', 'user')})"""
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# Cost, audit and lines of the cheapest way into each state, row by row.
SQL = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT),
    list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(k[i]) AS UBIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])),
      lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, CAST(3988292384 AS UBIGINT)) ELSE x >> 1 END)),
    CAST(4294967295 AS UBIGINT)) % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
n AS (SELECT *, rtrim(text, {_WHITE}) AS core,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
m AS (SELECT *, left(role, 1) AS l, role || ':' || text AS line, CASE WHEN core = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM n),
r AS (SELECT conv_id, i, l, text, line, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS x,
    fault IN ('blank', 'duplicate') AS f FROM m),
counts AS (SELECT conv_id, count(*) AS rows,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0 AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': CAST([] AS VARCHAR[])}} AS v0,
    {{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': CAST([] AS VARCHAR[])}} AS v1,
    {{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': CAST([] AS VARCHAR[])}} AS v2,
    {{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': CAST([] AS VARCHAR[])}} AS v3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i + 1, {_edited('v0', '3', 'D')},
    least({_edited('v1', '3', 'D')}, {_kept('v0', 's')}),
    least({_edited('e2', '3', 'D')}, {_kept('v0', 'u')}, {_kept('v1', 'u')}, {_kept('e3', 'u')},
      {_reroled('v0', 'user')}, {_reroled('v1', 'user')}, {_reroled('e3', 'user')}),
    least({_edited('e3', '3', 'D')}, {_kept('e2', 'a')}, {_reroled('e2', 'assistant')})
  FROM (SELECT *, least(v3, {_inserted('e2', 'assistant')}) AS e3
    FROM (SELECT *, {_CLOSED} AS e2 FROM walk) AS a) AS w
  JOIN (SELECT i AS at, conv_id AS conv, l, text, line, x, f FROM r) AS r
    ON r.conv IS NOT DISTINCT FROM w.conv_id AND r.at = w.i + 1),
ends AS (SELECT conv_id, least(v0, v3, {_inserted('e2', 'assistant')}) AS best
  FROM (SELECT w.*, {_CLOSED} AS e2 FROM walk AS w LEFT JOIN counts AS n
    ON n.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(n.rows, 0)) AS w)
SELECT e.conv_id, CAST(coalesce(n.gaps, 0) AS BIGINT) AS gaps, coalesce(n.blank, 0) AS blank,
  coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated,
  coalesce(n.illegal, 0) AS illegal, e.best.c AS cost, e.best.a AS audit,
  sha256(array_to_string(e.best.o, chr(10))) AS repaired_sha256
FROM ends AS e LEFT JOIN counts AS n ON n.conv_id IS NOT DISTINCT FROM e.conv_id
"""

QUERIES = {"op12_conversation_repair": (op12_conversation_repair, SQL)}
