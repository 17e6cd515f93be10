"""Ranks and running minima over a whole table, dealt by ranges: no task holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.sources.kept import kept

#: Rows of a task that sorts or gathers them by key.
ROWS = 1 << 19


def tasks_for(df: DataFrame, rows: int = ROWS) -> int:
    """As many tasks as have some rows each; a fixed number of them would each have more of a larger table to sort."""
    return max(df.count() // rows + 1, df.sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame, by: list[str], rows: int = ROWS) -> DataFrame:
    """df dealt by the columns to tasks of some rows each."""
    return df.repartition(tasks_for(df, rows), *by)


def global_rank(df: DataFrame, order: list[str], rank: str, count: str, part: str) -> DataFrame:
    """df with its rows' places from 1 in the order of the columns, the number of rows, and the range that a row is in.

    Rows are sorted within ranges; the numbers of rows of the ranges before are added from a table of a row for each range."""
    dealt = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    # the upper bits of the id are the range, the lower 33 the row in it
    dealt = dealt.withColumn(part, F.shiftright("_at", 33))
    runs = dealt.groupBy(part).agg(F.min("_at").alias("_first"), F.count("*").alias("_own"))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    runs = runs.select(part, (F.coalesce(F.sum("_own").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"), F.sum("_own").over(W.partitionBy()).alias(count))
    return dealt.join(F.broadcast(runs), part).withColumn(rank, F.col("_at") + F.col("_shift")).drop("_at", "_shift")


def least_from_here(ranked: DataFrame, value: str, rank: str, part: str, out: str) -> DataFrame:
    """ranked with the least value of a row and all behind it: that within its range, and that of the ranges behind."""
    later = W.orderBy(F.desc(part)).rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    behind = ranked.groupBy(part).agg(F.min(value).alias("_m")).select(part, F.min("_m").over(later).alias("_behind"))
    own = F.min(value).over(W.partitionBy(part).orderBy(F.desc(rank)))
    return ranked.withColumn("_own", own).join(F.broadcast(behind), part).withColumn(out, F.least("_own", "_behind")).drop("_own", "_behind")


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with the sum of value over a row and all before it in the order of the columns: that within its range, and those of
    the ranges before."""
    ranked = global_rank(df, order, "_k", "_n", "_part")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    sums = ranked.groupBy("_part").agg(F.sum(value).alias("_s")).select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_ahead"))
    own = F.sum(value).over(W.partitionBy("_part").orderBy("_k"))
    return ranked.withColumn("_own", own).join(F.broadcast(sums), "_part").withColumn(out, F.col("_own") + F.col("_ahead")).drop("_k", "_n", "_part", "_own", "_ahead")
