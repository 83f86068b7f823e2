"""Exclusive running sums without a global sort or a one-task window.

Rows are ordered by one or more *cell* columns and then by ``order``.  Cells
are bounded integers: their sums are small tables, so the windows over them are
small; the only window over rows stands inside the finest cell.  Callers build
the finest cell from a hash, so that no key fills one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(
    df: DataFrame,
    group: list[str],
    cells: list[str],
    order: list[Column | str],
    value: str,
    out: str,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows of the group before this one.

    ``group`` and ``cells`` must hold no nulls.  Rows that tie in ``order`` get
    some order among themselves.
    """
    finest = [*group, *cells]
    totals = df.groupBy(*finest).agg(F.sum(value).alias("_v"))
    offsets, before = totals, F.lit(0).cast("long")
    for depth in range(len(cells)):
        outer, cell = [*group, *cells[:depth]], cells[depth]
        if depth < len(cells) - 1:
            level = totals.groupBy(*outer, cell).agg(F.sum("_v").alias("_v"))
        else:
            level = totals
        window = Window.partitionBy(*outer).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(
            *outer, cell, F.coalesce(F.sum("_v").over(window), F.lit(0)).alias(f"_o{depth}")
        )
        offsets = level if depth == 0 else offsets.join(level, outer)
        before = before + F.col(f"_o{depth}")
    offsets = offsets.select(*finest, before.alias("_before"))
    inside = Window.partitionBy(*finest).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offsets, finest)
        .withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_before")
    )
