"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates are dealt into blocks and queries into groups, both of bounded size; a task is one block
and one group. A block becomes postings, one list of (row, weight) for each dimension; each query's
non-zero components scatter their weighted postings into a dense score array of the block, the k
best are selected by partitioning, and the blocks' lists are merged by query. Queries stream past a
block, so a task holds one block and a few queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import read

#: Rows of a block, queries of a group, and queries whose score arrays are filled together.
BLOCK_ROWS = 16_384
GROUP_QUERIES = 65_536
QUERIES_AT_ONCE = 16
#: Tasks for each core that few blocks are cut into by smaller groups.
TASKS_PER_CORE = 3
SCALE = 1024


class Block:
    """Postings of one block, rows in order of their id."""

    def __init__(self, ids: list[int], vectors: list[np.ndarray]):
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        self.ids = np.array(ids, np.int64)[order]
        self.postings = []
        width = max((len(v) for v in vectors), default=0)
        dense = np.zeros((width, len(order)), np.int64)
        for place, row in enumerate(order):
            dense[: len(vectors[row]), place] = vectors[row]
        for weights in dense:
            rows = np.flatnonzero(weights)
            self.postings.append((None if len(rows) == len(weights) else rows, weights[rows]))

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(queries), len(self.ids)), np.int64)
        for term, (rows, weights) in enumerate(self.postings):
            values = np.array([q[term] if term < len(q) else 0 for q in queries], np.int64)
            asking = np.flatnonzero(values)
            if not len(asking):
                continue
            part = values[asking, None] * weights
            if rows is not None:
                out[np.ix_(asking, rows)] += part
            elif len(asking) == len(queries):
                out += part
            else:
                out[asking] += part
        return out

    def best(self, own: int, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the k highest scores without the query's own row; ties to the smaller id."""
        places = np.concatenate(
            (np.arange(np.searchsorted(self.ids, own)), np.arange(np.searchsorted(self.ids, own, "right"), len(scores)))
        )
        values = scores[places]
        if len(values) > k:
            least = np.partition(values, len(values) - k)[len(values) - k]
            above, level = np.flatnonzero(values > least), np.flatnonzero(values == least)
            places = places[np.concatenate((above, level[: k - len(above)]))]
        return places


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    current, block, ids, vectors, waiting = None, None, [], [], []

    def answer() -> Iterator[pa.RecordBatch]:
        nonlocal block
        if not waiting:
            return
        if block is None:
            block = Block(ids, vectors)
        found = block.scores([vector for _, _, vector in waiting])
        columns: list[list] = [[], [], [], []]
        for (own, which, _), scores in zip(waiting, found):
            places = block.best(own, scores, k)
            for column, values in zip(
                columns, ([own] * len(places), [which] * len(places), block.ids[places], scores[places])
            ):
                column.extend(values)
        waiting.clear()
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
             pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
            ["query_id", "which", "vec_id", "score"],
        )

    for batch in batches:
        of, asks, names, which, cells = (batch.column(i) for i in range(5))
        flat, offsets = np.asarray(cells.flatten()), np.asarray(cells.offsets)
        offsets = offsets - offsets[0]
        for i, (at, ask, name, tag) in enumerate(
            zip(of.to_pylist(), asks.to_pylist(), names.to_pylist(), which.to_pylist())
        ):
            vector = flat[offsets[i] : offsets[i + 1]]
            if at != current:
                yield from answer()
                current, block, ids, vectors = at, None, [], []
            if ask:
                waiting.append((name, tag, vector))
                if len(waiting) == QUERIES_AT_ONCE:
                    yield from answer()
            else:
                ids.append(name)
                vectors.append(vector)
    yield from answer()


def search(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100
) -> DataFrame:
    """The k rows of highest integer inner product for each query.

    Components x become floor(1024 * x). Queries are the rows whose key is divisible by ``every``;
    candidates are all rows with another key; ties go to the smaller key. Returns query_id, rank,
    vec_id, score; fewer than k rows where there are fewer candidates. Rows without a key, with a
    null vector or with a null or non-finite component take no part. Missing trailing components
    count as 0, so an empty vector scores 0 with all. Repeated rows are candidates each; repeated
    equal queries are answered once, equal keys with other vectors each. Scores are 64-bit and
    wrap beyond that. Other columns are not read; an empty table gives an empty result.
    """
    rows = (
        df.select(F.col(key).cast("long").alias("name"), F.col(vector).alias("cells"))
        .where("name is not null and cells is not null")
        .where("not exists(cells, x -> x is null or isnan(x) or abs(cast(x as double)) = double('infinity'))")
        .selectExpr("name", f"transform(cells, x -> cast(floor({SCALE}D * cast(x as double)) as bigint)) as cells")
    )
    asking = F.col("name") % every == 0
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if(asking)).first()
    blocks = max(1, -(-total // BLOCK_ROWS))
    cores = df.sparkSession.sparkContext.defaultParallelism
    groups = max(-(-asked // GROUP_QUERIES), min(-(-TASKS_PER_CORE * cores // blocks), -(-asked // QUERIES_AT_ONCE)), 1)
    cells = blocks * groups
    # Blocks go by id and vector, so that rows of one id spread too; cell = block * groups + group.
    candidates = rows.selectExpr(
        f"explode(transform(sequence(0, {groups - 1}), "
        f"g -> cast(pmod(xxhash64(name, cells), {blocks}) * {groups} + g as int))) as cell",
        "false as asks", "name", "0L as which", "cells",
    )
    queries = (
        rows.where(asking)
        .dropDuplicates()
        .selectExpr(
            f"explode(transform(sequence(0, {blocks - 1}), "
            f"b -> cast(b * {groups} + pmod(xxhash64(cells, name), {groups}) as int))) as cell",
            "true as asks", "name", "xxhash64(cells) as which", "cells",
        )
    )
    found = (
        candidates.union(queries)
        .repartitionById(cells, F.col("cell"))
        .sortWithinPartitions("cell", "asks")
        .mapInArrow(lambda batches: _search(batches, k), "query_id long, which long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best rows for every hundredth vector, against all vectors."""
    return search(read(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.c, r.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id
  WHERE q.vec_id % 100 = 0),
t AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 10
"""

QUERIES = {"op7_exact_topk": (op7_exact_topk, SQL)}
