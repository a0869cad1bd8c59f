"""Multivariate anomalies: Isolation Forest and Local Outlier Factor, alone and agreeing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import QualityConfig
from plumbline.functions.columns import (
    RowKey, col, data_columns, key_columns, key_struct, key_text, nan_to_null, number_columns,
)
from plumbline.functions.quantiles import medians, percentiles
from plumbline.functions.storage import pin, spread, together
from plumbline.operators.isolation import isolation_scores
from plumbline.operators.neighbours import local_outlier_factor

METHODS = ("Isolation Forest", "Local Outlier Factor (LOF)")


def present_counts(df: DataFrame, names: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Number of rows, and of present values per column."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(names)],
    ).first()
    return row["rows"], {c: row[f"c{i}"] for i, c in enumerate(names)}


def gate(rows: int, columns: int, config: QualityConfig) -> str:
    """"run", "small" (too little data to say anything) or "large" (above the caller's limit)."""
    if columns < config.anomaly_min_columns or rows < config.anomaly_min_rows:
        return "small"
    limit = config.max_data_points_for_ml
    return "large" if limit is not None and rows * columns > limit else "run"


def fill_for_anomalies(
    df: DataFrame, row_key: RowKey, names: Sequence[str], sizes: dict[str, int], rows: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Row key and numeric columns as doubles, empty columns dropped, gaps filled with medians.

    With the number of ``rows`` no median is looked for where nothing is missing.
    """
    kept = [c for c in names if sizes[c] > 0]
    middle = medians(df, [c for c in kept if sizes[c] != rows], sizes=sizes)
    cells = [
        (F.coalesce(col(c).cast("double"), F.lit(middle[c])) if c in middle else col(c).cast("double")).alias(c)
        for c in kept
    ]
    return df.select(*[col(k) for k in key_columns(row_key)], *cells), kept


def anomaly_input(df: DataFrame, row_key: RowKey) -> tuple[DataFrame, list[str], int]:
    """Filled numeric data, its columns and its number of rows."""
    clean = nan_to_null(df)
    names = number_columns(clean, data_columns(clean, row_key))
    rows, sizes = present_counts(clean, names)
    filled, kept = fill_for_anomalies(clean, row_key, names, sizes, rows)
    return filled, kept, rows


def lof_by_location(
    filled: DataFrame, names: Sequence[str], rows: int, config: QualityConfig, leaf_rows: int | None = None
) -> DataFrame:
    """(x0.., lof) of the distinct rows."""
    return local_outlier_factor(
        filled, names, config.anomaly_neighbours, rows, leaf_rows, config.anomaly_neighbour_search
    )


def with_lof(filled: DataFrame, names: Sequence[str], located: DataFrame) -> DataFrame:
    """Add ``lof_score``. Rows meet the score of their location by value; the optimizer
    broadcasts few locations, and splits a location holding many rows otherwise."""
    renamed = located.select(
        *[F.col(f"x{i}").alias(f"__x{i}") for i in range(len(names))],
        F.col("lof").alias("lof_score"),
    )
    same = [col(c) == F.col(f"__x{i}") for i, c in enumerate(names)]
    return filled.join(renamed, same).drop(*[f"__x{i}" for i in range(len(names))])


def lof_scores(
    filled: DataFrame, names: Sequence[str], rows: int, config: QualityConfig, leaf_rows: int | None = None
) -> DataFrame:
    """``filled`` with ``lof_score``."""
    return with_lof(filled, names, lof_by_location(filled, names, rows, config, leaf_rows))


def flag_lowest(scored: DataFrame, scores: Sequence[str], rows: int, share: float) -> DataFrame:
    """Add ``<score>_flag`` for rows below the given percentile of each score."""
    cuts = percentiles(scored, scores, share, sizes={s: rows for s in scores})
    flags = {f"{s.removesuffix('_score')}_flag": F.col(s) < F.lit(cuts[s]) for s in scores}
    offsets = {f"{s}_cut": F.lit(cuts[s]) for s in scores}
    return scored.withColumns({**flags, **offsets})


def anomaly_scores(
    df: DataFrame, row_key: RowKey, config: QualityConfig, lof: bool = True
) -> DataFrame:
    """Row key, filled columns, ``iso_score``, ``iso_flag``, ``lof_score``, ``lof_flag``.

    ``iso_score`` is relative to its cut-off here: negative means flagged. Without LOF its score
    is null and it flags nothing.
    """
    filled, names, rows = anomaly_input(df, row_key)
    filled = pin(spread(filled, rows))
    forest = lambda: isolation_scores(filled, names, row_key, rows, config)
    if lof:
        # Trees are fitted while neighbours are looked for.
        factors = lambda: lof_by_location(filled, names, rows, config)
        scored, located = together(df.sparkSession, forest, factors)
        scored, scores = with_lof(scored, names, located), ["iso_score", "lof_score"]
    else:
        scored, scores = forest(), ["iso_score"]
    flagged = flag_lowest(pin(scored), scores, rows, config.anomaly_contamination)
    if not lof:
        none = F.lit(None).cast("double")
        flagged = flagged.withColumns(
            {"lof_score": none, "lof_flag": F.lit(False), "lof_score_cut": none}
        )
    return flagged.withColumn("iso_score", F.col("iso_score") - F.col("iso_score_cut")).drop(
        "iso_score_cut", "lof_score_cut"
    )


def consensus(scored: DataFrame) -> DataFrame:
    """Rows both methods flag."""
    return scored.filter(F.col("iso_flag") & F.col("lof_flag"))


def single_flags(scored: DataFrame, config: QualityConfig) -> DataFrame:
    """Rows exactly one method flags; none at all where they are more than a limit asked for."""
    one = scored.filter(F.col("iso_flag") != F.col("lof_flag"))
    if config.potential_anomaly_max_rows is None:
        return one
    found = one.agg(F.count(F.lit(1)).alias("__n")).filter(
        F.col("__n") <= config.potential_anomaly_max_rows
    )
    # The right side is a single row or none.
    return one.join(F.broadcast(found.select("__n")), F.lit(True), "left_semi")


def anomaly_examples(
    found: DataFrame, row_key: RowKey, names: Sequence[str], limit: int
) -> DataFrame:
    """First rows in row order with scores and their first five values."""
    values = F.map_from_arrays(
        F.array(*[F.lit(c) for c in names[:5]]), F.array(*[col(c) for c in names[:5]])
    )
    flagged_by = F.array_compact(
        F.array(F.when(F.col("iso_flag"), F.lit("Isolation Forest")), F.when(F.col("lof_flag"), F.lit("LOF")))
    )
    return (
        found.select(
            key_struct(row_key).alias("__key"),
            key_text(row_key).alias("row_key"),
            F.bround("iso_score", 3).alias("iso_score"),
            F.bround("lof_score", 3).alias("lof_score"),
            flagged_by.alias("flagged_by"),
            values.alias("values"),
        )
        .orderBy("__key")
        .limit(limit)
    )
