"""Ranks and running sums within a group without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column in a block.
BLOCK = 8192
#: Cells of a running sum: so many to a unit of the order column, and to each of these.
CELLS = 4096


def ranked(df: DataFrame, group: str, order: str, name: str = "nth", block: int = BLOCK) -> DataFrame:
    """df with name: the row's number from 0 in its group by an integer order column, unique in the group.

    A window ranks within blocks of order values; a running sum over block counts gives what comes before.
    """
    rows = df.withColumn("_blk", F.floor(F.col(order) / block))
    counts = rows.groupBy(group, "_blk").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select(group, "_blk", F.coalesce(before, F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(group, "_blk").orderBy(order)) - 1
    return rows.withColumn("_own", own).join(base, [group, "_blk"]).withColumn(name, (F.col("_base") + F.col("_own")).cast("long")).drop("_blk", "_own", "_base")


def summed_before(df: DataFrame, group: str, order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """df with name: the sum of value over the group's rows before this one by an integer order column, unique in the group; nulls add nothing.

    A window sums within blocks of order values, and one over the blocks' sums gives what comes
    before, so a task holds the rows of a block or the blocks of a group. Null groups are one group.
    """
    rows = df.withColumns({"_blk": F.floor(F.col(order) / block), "_v": value})
    before = F.sum("_s").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    base = rows.groupBy(F.col(group).alias("_g"), F.col("_blk").alias("_b")).agg(F.sum("_v").alias("_s")).withColumn("_base", F.coalesce(before, F.lit(0))).drop("_s")
    own = F.sum("_v").over(Window.partitionBy(group, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    met = rows.withColumn("_own", F.coalesce(own, F.lit(0))).join(base, F.col(group).eqNullSafe(F.col("_g")) & F.col("_blk").eqNullSafe(F.col("_b")))
    return met.select(*df.columns, (F.col("_base") + F.col("_own")).cast("long").alias(name))


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, str], cells: int = CELLS) -> DataFrame:
    """df with name: the sum of a column over the rows of the keys up to this one by order, for each name: column of sums.

    order is a double without nulls, one row a value and keys. A window runs within small cells of
    the order column; sums over small cells of a large one, and over large cells, give what comes
    before. A task so holds the rows of a small cell, or the occupied cells of the level above.
    """
    rows = df.withColumn("_wide", F.floor(F.col(order) * cells)).withColumn("_fine", F.floor(F.col(order) * cells * cells))

    def before(table: DataFrame, within: list[str], by: str, prefix: str) -> DataFrame:
        w = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return table.withColumns({f"_{prefix}_{n}": F.coalesce(F.sum(f"_{n}").over(w), F.lit(0)) for n in sums})

    fine = rows.groupBy(*keys, "_wide", "_fine").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    wide = fine.groupBy(*keys, "_wide").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in sums))
    wide = before(wide, keys, "_wide", "w").drop(*(f"_{n}" for n in sums))
    fine = before(fine, [*keys, "_wide"], "_fine", "f").drop(*(f"_{n}" for n in sums))
    base = fine.join(wide, [*keys, "_wide"])
    own = Window.partitionBy(*keys, "_wide", "_fine").orderBy(order)
    out = rows.withColumns({f"_o_{n}": F.sum(c).over(own) for n, c in sums.items()}).join(base, [*keys, "_wide", "_fine"])
    return out.select(*df.columns, *((F.col(f"_o_{n}") + F.col(f"_f_{n}") + F.col(f"_w_{n}")).alias(n) for n in sums))
