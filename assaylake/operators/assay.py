"""Quantification and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def percent_spliced_in(x: DataFrame) -> DataFrame:
    """psi: included reads over all reads of a feature."""
    s = x.groupBy("feature").agg(F.sum(F.when(F.col("included"), F.col("reads")).otherwise(0.0)).alias("i"), F.sum("reads").alias("a"))
    return s.select("feature", F.when(F.col("a") != 0, F.try_divide("i", "a")).alias("psi"))


def rpkm(x: DataFrame, feature: str, sample: str, count: str, size: str) -> DataFrame:
    """Counts for each thousand bases of size and million counts of the sample."""
    total = x.groupBy(sample).agg(F.sum(count).alias("_total"))
    return x.join(total, sample).select(feature, sample, (F.col(count) * 1e9 / (F.col(size) * F.col("_total"))).alias("rpkm"))


def call_by_share(rows: DataFrame, unit: str, tag: str, least: float) -> DataFrame:
    """A unit's most frequent tag if it has the least share of its rows, else 'mixed'; ties to the smaller tag."""
    n = rows.groupBy(unit, tag).agg(F.count("*").alias("n"))
    best = n.groupBy(unit).agg(F.sum("n").alias("all"), F.min(F.struct(-F.col("n"), tag)).alias("b"))
    return best.select(unit, F.when(-F.col("b.col1") / F.col("all") >= least, F.col(f"b.{tag}")).otherwise("mixed").alias("call"))


def best_group(x: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """(key, group): of each key the group of the largest sum; ties to the smaller group. Keys that come dealt to tasks stay where they are."""
    s = x.groupBy(key, group).agg(F.sum(value).alias("_v"))
    return s.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_v"), group))).where("_k = 1").select(key, group)
