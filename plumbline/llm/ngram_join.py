"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact sorted-array intersection.

1. Equal shingle sets become one class before anything is compared.
2. A class lies in the tiles of its size band; linked classes share a tile (see ``shingles``). Map
   tasks put equal tiles together first and send one class a tile. Every class then leaves its most
   crowded tiles, as many as it can spare, which are mostly those of passages that many share.
3. Inside a tile bit counts rule out most members; every class is tested against the first one that
   they let pass, and what links is one component.
4. Tiles that still hold several components compare their members' bitmaps, twice to join components
   by their closest members, which are tested. Then pairs of components that are still apart and
   that bit counts cannot rule out are tested, so no link between components is lost.

Pairs inside a component are never listed: the work of a group of near copies grows with its
members, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.storage import pin
from plumbline.llm.components import components, forest_roots
from plumbline.llm.repeats import identified
from plumbline.llm.shingles import (
    LEAST, SHINGLE, SPARE_BITS, bitmap, folded, linked, overlap_possible, set_hash, sets_of, tiles_of,
)
from plumbline.llm.tables import by_batch, read
from plumbline.llm.texts import chunks

#: Tile rows that a map task puts together before it sends them.
TILE_ROWS = 1_000_000
#: Members of a tile whose bitmaps are compared at once with all others.
BLOCK = 256
#: What is wanted of the pairs of a tile, and how often components are joined by their closest members
#: before all pairs of members of different components are.
FIRST, CLOSEST, ALL = "first", "closest", "all"
ROUNDS = 2
#: Rows of equal tiles found in one task go on to so many others.
SALTS = 64


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and the least similarity of linked sets as numerator and denominator."""

    shingle: int = SHINGLE
    least: tuple[int, int] = LEAST

    def __post_init__(self) -> None:
        if self.shingle < 1 or not 0 < self.least[0] <= self.least[1]:
            raise ValueError("a shingle has a word or more, and the least similarity is above 0 and at most 1")


def classes_of(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, text_hash, n, class and bits of every row of docs."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, end, offsets, data in chunks(batch):
            found = list(sets_of(offsets, data, rule.shingle))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(first, end - first) for i in (0, 1)),
                 pa.array([len(s) for s in found], pa.int64()), pa.array([set_hash(s) for s in found], pa.int64()),
                 pa.array([bitmap(s) for s in found], pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n", "class", "bits"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs, run, f"doc_id {kind}, text_hash long, n long, class long, bits array<long>")


def _tile_rows(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Tile rows: one class a tile under salt 0, all classes of tiles with several under others."""
    seen: set[int] = set()
    keys: list[np.ndarray] = []
    spares: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def give() -> pa.RecordBatch:
        key = np.concatenate(keys).view(np.int64)
        owner = np.repeat(np.array(owners, np.int64), [len(k) for k in keys])
        order = np.lexsort((owner, key))
        key, owner, spare = key[order], owner[order], np.concatenate(spares)[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        shared = ~new
        shared[:-1] |= ~new[1:]
        salt = 1 + (owner[shared] % SALTS)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((key[new], key[shared]))),
             pa.array(np.concatenate((np.zeros(new.sum(), np.int64), salt)).astype(np.int32)),
             pa.array(np.concatenate((owner[new], owner[shared]))),
             pa.array(np.concatenate((spare[new], spare[shared])))],
            ["key", "salt", "class", "spare"],
        )

    for batch in batches:
        for _, _, offsets, data in chunks(batch):
            for members in sets_of(offsets, data, rule.shingle):
                name = set_hash(members)
                if name in seen:
                    continue
                if len(seen) < TILE_ROWS:
                    seen.add(name)
                tiles, spare = tiles_of(members, rule.least)
                if len(tiles):
                    keys.append(tiles)
                    spares.append(spare)
                    owners.append(name)
                    size += len(tiles)
            if size > TILE_ROWS:
                yield give()
                keys, spares, owners, size = [], [], [], 0
    if keys:
        yield give()


def _shared_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows by key and salt: members of tiles that hold two classes or more."""
    rest: pa.RecordBatch | None = None

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, salt, name, spare = (np.asarray(batch.column(i)) for i in range(4))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        group = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        number = np.cumsum(new) - 1
        several = np.zeros(number[-1] + 1, bool)
        several[number[name != name[group]]] = True
        again = np.zeros(len(key), bool)
        again[1:] = ~new[1:] & (name[1:] == name[:-1])
        keep = ((salt > 0) | several[number]) & ~again
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, name, spare)], ["key", "class", "spare"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        key, salt = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        last = int(np.flatnonzero((key != key[-1]) | (salt != salt[-1]))[-1:].max(initial=-1)) + 1
        if last:
            yield find(batch.slice(0, last))
        rest = batch.slice(last)
    if rest is not None:
        yield find(rest)


def _sets_table(docs: DataFrame, stands: DataFrame, rule: Rule) -> DataFrame:
    """class and members of classes, from one standing document of each."""
    held = docs.alias("d").join(
        stands.hint("shuffle_hash").alias("s"),
        F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash")),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()  # rows equal in key and text meet in one task and give their class once
        for batch in batches:
            for first, end, offsets, data in chunks(batch):
                names = batch.column(0).slice(first, end - first).to_pylist()
                sets = zip(names, sets_of(offsets, data, rule.shingle))
                new = [(n, s) for n, s in sets if n not in given and not given.add(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _ in new], pa.int64()), pa.array([s.tobytes() for _, s in new], pa.binary())],
                    ["class", "members"],
                )

    return held.select("s.class", "d.text").mapInArrow(run, "class long, members binary")


def _links(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sets link, by exact intersection of sorted arrays."""
    full = pairs.join(sets.toDF("a", "one"), "a").join(sets.toDF("b", "two"), "b").select("a", "b", "one", "two")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = [
            linked(np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64), rule.least)
            for one, two in zip(batch.column(2), batch.column(3))
        ]
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return by_batch(full, run, "a long, b long")


def _open_pairs(batches: Iterator[pa.RecordBatch], wanted: str, rule: Rule) -> Iterator[pa.RecordBatch]:
    """From tile members by key: pairs of different components that bit counts let pass.

    With FIRST only the first partner, before it or after it, of each member that has one; with
    CLOSEST, from each block of members, the pair of each two components that differs in the fewest bits.
    """
    one_each = wanted == FIRST
    rest: list[pa.RecordBatch] = []

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        key, name, label, size = (np.asarray(table.column(i).combine_chunks()) for i in range(4))
        lists = table.column(4).combine_chunks()
        words, widths = np.asarray(lists.flatten()).view(np.uint64), np.asarray(pc.list_value_length(lists))
        place = np.concatenate(([0], np.cumsum(widths)))
        edges = np.concatenate(([0], 1 + np.flatnonzero(key[1:] != key[:-1]), [len(key)]))
        for first, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            paired = np.zeros(end - first, bool)
            width = widths[first:end]
            bits = np.empty((end - first, width.min()), np.uint64)
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                bits[rows] = folded(words[place[first + rows, None] + np.arange(w)], bits.shape[1])
            for low in range(first, end, BLOCK):
                own = np.arange(low, min(low + BLOCK, end))
                kept: list[np.ndarray] = []
                for at in range(first if one_each else low, end, BLOCK):
                    other = np.arange(at, min(at + BLOCK, end))
                    if one_each:
                        other = other[~paired[other - first]]
                    after = own[:, None] != other[None] if one_each else own[:, None] < other[None]
                    able = (label[own, None] != label[None, other]) & after
                    one, two = np.nonzero(able)
                    if not len(one):
                        continue
                    one, two = own[one], other[two]
                    differ = np.bitwise_count(bits[one - first] ^ bits[two - first]).sum(1, dtype=np.int64)
                    good = overlap_possible(size[one], size[two], differ, rule.least)
                    if good.any():
                        one, two = one[good], two[good]
                        if one_each:
                            two, earliest = np.unique(two, return_index=True)
                            one = one[earliest]
                            paired[two - first] = True
                        if wanted == CLOSEST:
                            sides = np.sort(np.stack((label[one], label[two])), axis=0)
                            kept.append(np.stack((*sides, differ[good], one, two)))
                            continue
                        a, b = name[one], name[two]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
                if kept:
                    found = np.concatenate(kept, axis=1)
                    found = found[:, np.lexsort(found[2::-1])]
                    new = np.ones(found.shape[1], bool)
                    new[1:] = (found[:2, 1:] != found[:2, :-1]).any(axis=0)
                    a, b = name[found[3, new]], name[found[4, new]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0))
        last = int(np.flatnonzero(key != key[-1])[-1:].max(initial=-1)) + 1
        if rest and (last or rest[0].column(0)[0].as_py() != key[0]):
            head = [batch.slice(0, last)] if last else []
            yield from compare(pa.Table.from_batches([*rest, *head]))
            rest = [batch.slice(last)]
        else:
            if last:
                yield from compare(pa.Table.from_batches([batch.slice(0, last)]))
            rest.append(batch.slice(last))
    if rest:
        yield from compare(pa.Table.from_batches(rest))


def class_links(docs: DataFrame, classed: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Pairs (a, b) of classes that verified links connect, enough to span every component."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "key long, salt int, class long, spare int"
    given = pin(
        docs.select("text").mapInArrow(lambda batches: _tile_rows(batches, rule), schema)
        .repartition(tasks, "key", "salt").sortWithinPartitions("key", "salt", "class")
        .mapInArrow(_shared_tiles, "key long, class long, spare int").distinct()
    )
    # By one order for all: the number of members, then the key.
    crowd = given.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    most = Window.partitionBy("class", "spare").orderBy(F.desc("members"), "key")
    ranked = given.join(crowd, "key").withColumn("place", F.row_number().over(most))
    tiles = pin(ranked.where(F.col("place") > F.col("spare").bitwiseAND((1 << SPARE_BITS) - 1)).select("key", "class"))
    bits = pin(classed.where("n > 0").groupBy("class").agg(F.first("n").alias("n"), F.first("bits").alias("bits")))

    def compared(members: DataFrame, wanted: str) -> DataFrame:
        """Pairs of tile members (key, class, component) that bit counts let pass."""
        return (
            members.join(bits, "class").select("key", "class", "component", "n", "bits")
            .repartition(tasks, "key").sortWithinPartitions("key", "class")
            .mapInArrow(lambda batches: _open_pairs(batches, wanted, rule), "a long, b long").distinct()
        )

    passed = pin(compared(tiles.withColumn("component", F.col("class")), FIRST))
    asked = pin(passed.select(F.col("a").alias("class")).union(passed.select("b")).distinct())
    stands = classed.join(asked, "class", "left_semi").groupBy("class").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash")
    )
    sets = pin(_sets_table(docs, stands, rule))
    first = passed.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = pin(_links(first, sets, rule))

    found = pin(forest_roots(links.select(F.col("b").alias("node"), F.col("a").alias("parent"))))
    stars = found.select(F.col("component").alias("a"), F.col("node").alias("b"))
    spans, tested = stars, first
    held = tiles.join(asked, "class", "left_semi")
    for turn in range(ROUNDS, -1, -1):
        names = found.select(F.col("node").alias("class"), "component")
        labelled = pin(held.join(names, "class", "left").withColumn("component", F.coalesce("component", "class")))
        mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        held = labelled.join(mixed.where("low <> high").select("key"), "key", "left_semi")
        pairs = pin(compared(held, CLOSEST if turn else ALL).join(tested, ["a", "b"], "left_anti"))
        joined = pin(_links(pairs, sets, rule))
        spans = spans.union(joined)
        if turn:
            found, tested = components(spans).select("node", "component"), tested.union(pairs)
        held = held.select("key", "class")
    return spans


def _grouped(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Rows with words (doc_id, text_hash, n, class, component), and rows without."""
    classed = pin(classes_of(docs, rule))
    found = components(class_links(docs, classed, rule)).select(F.col("node").alias("class"), "component")
    by_class = (
        classed.where("n > 0").select("class").distinct().join(found, "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    return classed.where("n > 0").join(by_class, "class"), classed.where("n = 0")


def join_components(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a row's set is its distinct shingles of
    ``rule.shingle`` words, or the whole sequence as one if it has fewer words. Rows link when
    intersection / union is ``rule.least`` or more; component_id is the least key reachable by
    links, null if none of them has a key. Rows without words link with nothing and keep their own
    key. Repeated rows link with each other; other columns are not read; an empty table gives an
    empty result. Shingles and sets are told apart by 64-bit hashes.
    """
    grouped, alone = _grouped(identified(df, key, text), rule)
    least = grouped.groupBy("class", "component").agg(F.min("doc_id").alias("least"))
    smallest = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(smallest, "component").select("class", "component_id")
    rows = grouped.select("doc_id", F.col("n").alias("n_shingles"), "class").join(named, "class").drop("class")
    return rows.union(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def first_of_components(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """The rows of df without all but one of each component: that of the least key.

    Rows without a key come after all others. Rows without words all stay.
    """
    names = [c for c in df.columns if c not in (key, text)]
    grouped, alone = _grouped(identified(df, key, text), rule)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = grouped.groupBy("component").agg(F.min(order).alias("of")).select("of.doc_id", "of.text_hash", F.lit(True).alias("one"))
    kept = kept.union(alone.select("doc_id", "text_hash", F.lit(False)).distinct())
    cells = F.coalesce(df[text].cast("string"), F.lit(""))
    given = df.select(
        df[text].alias("given"), df[key].alias("doc_id"), F.xxhash64(cells).alias("text_hash"),
        *[df[c].alias(f"o{i}") for i, c in enumerate(names)],
    )
    rows = given.alias("d").join(
        kept.hint("shuffle_hash").alias("k"),
        F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.text_hash") == F.col("k.text_hash")),
    ).select("d.*", "k.one")
    number = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("text_hash"))
    rows = rows.withColumn("number", number).where("number = 1 or not one")
    back = {key: F.col("doc_id"), text: F.col("given")} | {c: F.col(f"o{i}") for i, c in enumerate(names)}
    return rows.select(*[back[c].alias(c) for c in df.columns])


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under shingle similarity of 0.9 or more."""
    return join_components(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i
    FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)),
c AS (SELECT a AS doc_id, a AS other FROM e UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(f.least, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(other) AS least FROM c GROUP BY doc_id) f ON f.doc_id = d.doc_id
"""

QUERIES = {"op2_ngram_jaccard": (op2_ngram_jaccard, SQL)}
