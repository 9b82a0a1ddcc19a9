"""Positions and predecessors inside groups of any size.

A window partitioned by a group key sorts that whole group in one task.  When one
server can hold a third of all rows, that task is the job.  Both operators here
cut a group into cells along its own sort order, work inside cells, and carry
one number or row per cell across them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_WIDTH = 1 << 16


def rank_within(df: DataFrame, keys: list[str], major: Column, minor: Column, name: str,
                width: int = CELL_WIDTH) -> DataFrame:
    """Add the 1-based position of each row in its group, ordered by (major, minor).

    ``major`` is any sortable value, ``minor`` a whole number that is distinct inside
    a group, such as a list position.  A cell is one ``major`` value and one range of
    ``width`` minors, so no window partition holds more than ``width`` rows; the
    windows above it run over one row per cell or per distinct ``major``.
    """
    cell = keys + ["_major", "_range"]
    rows = df.withColumn("_major", major).withColumn("_minor", minor)
    rows = rows.withColumn("_range", F.floor(F.col("_minor") / width))

    counts = rows.groupBy(*cell).agg(F.count("*").alias("_n"))
    before = (Window.unboundedPreceding, -1)
    by_major = (counts.groupBy(*keys, "_major").agg(F.sum("_n").alias("_m"))
                .withColumn("_above", F.coalesce(
                    F.sum("_m").over(Window.partitionBy(*keys).orderBy("_major").rowsBetween(*before)), F.lit(0)))
                .drop("_m"))
    by_range = counts.withColumn("_ahead", F.coalesce(
        F.sum("_n").over(Window.partitionBy(*keys, "_major").orderBy("_range").rowsBetween(*before)), F.lit(0)))
    offsets = (by_range.join(by_major, keys + ["_major"])
               .select(*cell, (F.col("_above") + F.col("_ahead")).alias("_offset")))

    local = F.row_number().over(Window.partitionBy(*cell).orderBy("_minor"))
    return (rows.withColumn("_local", local).join(offsets, cell)
            .withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
            .drop("_major", "_minor", "_range", "_local", "_offset"))


def previous_within(df: DataFrame, keys: list[str], order: list[str], cells: list[Column],
                    value: Column, name: str) -> DataFrame:
    """Add the ``value`` of the preceding row of the group in ``order``; NULL for the first.

    ``cells`` go from fine to coarse, each inside the next, and none may decrease along
    ``order``.  Rows look back inside their finest cell; the first row of a cell takes the last
    row of the nearest earlier one, found in the same way among one row per cell.
    """
    around = [f"_around{len(cells)}_{k}" for k in range(len(cells) - 1)]
    cell, own, tail, carried = (f"{c}{len(cells)}" for c in ("_cell", "_value", "_tail", "_carried"))
    rows = df.withColumns({cell: cells[0], own: value, **dict(zip(around, cells[1:]))})
    group = [*keys, cell]
    local = Window.partitionBy(*group).orderBy(*order)
    tails = rows.groupBy(*group, *around).agg(F.max_by(own, F.struct(*order)).alias(tail))
    if around:
        tails = previous_within(tails, keys, [cell], [F.col(c) for c in around], F.col(tail), carried)
    else:
        tails = tails.withColumn(carried, F.lag(tail).over(Window.partitionBy(*keys).orderBy(cell)))
    return (rows.drop(*around).withColumn("_prev", F.lag(own).over(local))
            .withColumn("_first", F.row_number().over(local) == 1)
            .join(tails.select(*group, carried), group)
            .withColumn(name, F.when(F.col("_first"), F.col(carried)).otherwise(F.col("_prev")))
            .drop(cell, own, "_prev", "_first", carried))
