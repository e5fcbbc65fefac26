"""Joins whose hot keys are dealt over tasks, and places in an order that no task holds whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.folders import stored

#: Rows of one key that one task takes; a key with more is dealt over as many tasks as it needs.
HOT = 1_000_000


def dealt(rows: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", most: int = HOT) -> DataFrame:
    """rows joined with right, which has in `n` the number of rows that have its key.

    Rows of a hot key are dealt by their place; right repeats its rows of those keys alone. There is at most one hot key for
    each `most` rows, so their table is small enough to broadcast.
    """
    hot = F.broadcast(right.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("_salts")).distinct())
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int")).drop("_salts")
    parts = F.greatest(F.ceil(F.col("n") / most), F.lit(1)).cast("int")
    every = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return left.join(every, [*keys, "_salt"], how).drop("_salt")


def running(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], name: str) -> DataFrame:
    """rows with, for each of `sums`, the total of that value over all rows of the group that come before in the order.

    The order must be total within a group. Rows are stored by ranges of (group, order), so a hot group is as many ranges as
    its share of the rows; totals run within a range, and each range's start comes from the totals of the ranges, a row
    each. No task sorts more than a range.
    """
    ranged = stored(rows.repartitionByRange(*group, *order).withColumn("_piece", F.spark_partition_id()).withColumns({f"_v_{k}": v for k, v in sums.items()}), name)
    totals = ranged.groupBy(*group, "_piece").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    ahead = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_piece", *(F.coalesce(F.sum(f"_t_{k}").over(ahead), F.lit(0)).alias(f"_s_{k}") for k in sums))
    before = Window.partitionBy(*group, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = ranged.select("*", *(F.coalesce(F.sum(f"_v_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums))
    placed = here.join(starts, [*group, "_piece"])
    return placed.select(*rows.columns, *((F.col(f"_s_{k}") + F.col(f"_b_{k}")).cast("long").alias(k) for k in sums))
