"""Repeated rows and identifiers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (
    RowKey, col, key_columns, key_struct, key_text, quoted,
)
from plumbline.functions.storage import pin

HASH = "__row_hash"
#: Up to so many repeated hashes are looked up; beyond them rows are grouped as they are.
FEW_HASHES = 500_000
#: First repeats are looked for in these shares of a table of more rows than HEAD_ROWS, in row order.
HEAD_SHARES = (1 / 64, 1 / 16, 1 / 4)
HEAD_ROWS = 200_000
HEAD_SAMPLE = 4096


def row_hash(names: Sequence[str]) -> Column:
    """64-bit hash of the given columns; null flags keep (1, null) and (null, 1) apart."""
    cells = [f"{quoted(c)}, {quoted(c)} is null" for c in names]
    return F.expr(f"xxhash64({', '.join(cells)})")


def repeat_candidates(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows whose hash occurs more than once.

    Only the 8-byte hash of each row is shuffled for the count; the wide rows
    move only if they may be duplicates, and not at all where the repeated
    hashes are few enough for the optimizer to broadcast them.
    """
    hashed = df.withColumn(HASH, row_hash(names))
    repeated = hashed.groupBy(HASH).count().filter("count > 1").select(HASH)
    return hashed.join(repeated, HASH, "left_semi").drop(HASH)


def _narrow(df: DataFrame, names: Sequence[str]) -> bool:
    """True if the columns take no more room than their hash and a flag or two would."""
    kinds = [df.schema[c].dataType for c in names]
    return len(names) <= 2 and all(
        isinstance(k, T.NumericType | T.BooleanType | T.DateType | T.TimestampType) for k in kinds
    )


def repeat_groups(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each value combination that occurs more than once, with its count ``n``.

    Where repeated hashes are few, only their rows are grouped. Where they are many, moving the rows
    to their hashes would cost as much as grouping all, which puts equal rows together before the shuffle.
    """
    columns = [quoted(c) for c in names]
    wanted = df.select(*columns)
    if not _narrow(df, names):
        hashed = wanted.withColumn(HASH, row_hash(names))
        repeated = pin(hashed.groupBy(HASH).count().filter("count > 1").select(HASH))
        if repeated.count() <= FEW_HASHES:
            wanted = hashed.join(repeated, HASH, "left_semi").drop(HASH)
    return wanted.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def repeat_count(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: how many rows repeat an earlier one (missing equals missing)."""
    return repeat_groups(df, names).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("affected_rows")
    )


def _heads(df: DataFrame, row_key: RowKey) -> Iterator[DataFrame]:
    """Ever longer beginnings of the table in row order, at last all of it.

    They end between two values of the row key's first column, so with a row they hold all before it.
    """
    keys = key_columns(row_key)
    first, kind = col(keys[0]), df.schema[keys[0]].dataType
    rows = 0 if isinstance(kind, T.StructType | T.ArrayType) else df.count()
    if rows > HEAD_ROWS:
        scale = 1 << 30
        picked = F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(scale)) < scale * (HEAD_SAMPLE / rows)
        drawn = [r[0] for r in df.filter(picked).select(first).orderBy(first).limit(2 * HEAD_SAMPLE).collect()]
        for share in HEAD_SHARES:
            end = drawn[int(share * len(drawn))] if drawn else None
            if end is not None:
                yield df.filter(first.isNull() | (first <= F.lit(end).cast(kind)))
    yield df


def first_repeats(
    df: DataFrame, names: Sequence[str], row_key: RowKey, limit: int, value: Column | None = None,
    repeats: int | None = None,
) -> DataFrame:
    """The first ``limit`` repeating rows in row order: (rank, row_key, value).

    Whether a row repeats an earlier one shows in any beginning of the table that holds it, so a
    beginning with ``limit`` repeats has them all, or with ``repeats``, the number of all. The first
    ``limit`` repeats of a table lie within the first ``limit + 1`` rows of their group, and that
    rank limit is applied before the shuffle, so one huge group costs no more than any other.
    """
    keys = key_columns(row_key)
    wanted = df.select(*[col(c) for c in dict.fromkeys([*keys, *names])])
    order = [col(k) for k in keys]
    place = F.row_number().over(Window.partitionBy(*[col(c) for c in names]).orderBy(*order))
    shown = value if value is not None else F.lit(None).cast("string")
    enough = limit if repeats is None else min(limit, repeats)
    for head in _heads(wanted, row_key):
        first = pin(
            repeat_candidates(head, names)
            .withColumn("__place", place)
            .filter((F.col("__place") <= limit + 1) & (F.col("__place") > 1))
            .select(
                key_struct(row_key).alias("__key"),
                key_text(row_key).alias("row_key"),
                shown.cast("string").alias("value"),
            )
            .orderBy("__key")
            .limit(limit)
        )
        if first.count() >= enough:
            break
    rank = F.row_number().over(Window.orderBy("__key"))
    return first.select(rank.cast("int").alias("rank"), "row_key", "value")


def keep_one_per_row(
    df: DataFrame, names: Sequence[str], row_key: RowKey, keep: str = "first"
) -> DataFrame:
    """Drop repeated rows, keeping the first or last in row order.

    Only the row key is aggregated, by the compared columns; hot rows combine map-side. Columns
    that are not compared, of any type, come back by the kept keys.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    pick = F.min if keep == "first" else F.max
    keys = key_columns(row_key)
    # The least of one number stays in the hash aggregate.
    own = col(keys[0]) if len(keys) == 1 else key_struct(row_key)
    kept = df.groupBy(*[col(c) for c in names]).agg(pick(own).alias("__kept"))
    if len(keys) == 1 and set(df.columns) == {*names, *keys}:
        return kept.select(*[F.col("__kept").alias(c) if c == keys[0] else col(c) for c in df.columns])
    return df.join(kept.select("__kept"), own.eqNullSafe(F.col("__kept")), "left_semi")


def keep_first_per_id(df: DataFrame, id_column: str, row_key: RowKey) -> DataFrame:
    """Keep the first row of each identifier; the rank limit runs before the shuffle too."""
    order = [col(k) for k in key_columns(row_key)]
    place = F.row_number().over(Window.partitionBy(col(id_column)).orderBy(*order))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")
