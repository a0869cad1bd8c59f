"""Reshape many columns into (column, value) rows so that one grouped aggregate serves them all.

A wide ``agg`` with eight expressions per column leaves code generation beyond
a dozen columns; the long form keeps one small aggregate whatever the width.
Each map task emits at most one partial row per column, so a column name being
the grouping key is no hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spark generates code for stack() up to 50 output rows.
STACK_WIDTH = 40


def stack(
    df: DataFrame,
    entries: Sequence[Sequence[Column]] | Sequence[str],
    names: Sequence[str],
    keep: Sequence[Column] = (),
) -> DataFrame:
    """One output row per input row and entry; ``keep`` columns are repeated.

    An entry is a list of columns, or the SQL text of its cells, which is much
    faster to build for tables with hundreds of columns.
    """
    parts = []
    for start in range(0, len(entries), STACK_WIDTH):
        batch = entries[start : start + STACK_WIDTH]
        if isinstance(batch[0], str):
            cells = F.expr(f"stack({len(batch)}, {', '.join(batch)})")
        else:
            cells = F.stack(F.lit(len(batch)), *[cell for entry in batch for cell in entry])
        parts.append(df.select(*keep, cells.alias(*names)))
    return reduce(DataFrame.unionByName, parts)
