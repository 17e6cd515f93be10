"""Operators on long matrices (feature, sample, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def row_center(m: DataFrame) -> DataFrame:
    """Values less the feature's mean."""
    return m.withColumn("value", F.col("value") - F.avg("value").over(W.partitionBy("feature")))


def relative_fold(m: DataFrame, control: Column) -> DataFrame:
    """log2 of values over the feature's mean in the control samples."""
    return m.withColumn("value", F.log2("value") - F.log2(F.avg(F.when(control, F.col("value"))).over(W.partitionBy("feature"))))


def fill_missing(m: DataFrame, samples: DataFrame) -> DataFrame:
    """Every feature with every sample; what is missing gets the feature's median. The samples are the matrix's columns, so
    they go to all tasks as one array."""
    medians = m.groupBy("feature").agg(F.median("value").alias("_m"))
    every = samples.agg(F.collect_set("sample").alias("_all"))
    grid = medians.join(F.broadcast(every)).select("feature", "_m", F.explode("_all").alias("sample"))
    return grid.join(m, ["feature", "sample"], "left").select("feature", "sample", F.coalesce("value", "_m").alias("value"))


def max_filter(m: DataFrame, least: float) -> DataFrame:
    """Features whose largest value is above least."""
    return m.groupBy("feature").agg(F.max("value").alias("top")).where(F.col("top") > least)


def kth_largest(m: DataFrame, k: int) -> DataFrame:
    """The k-th largest value of features that have k."""
    k_th = F.row_number().over(W.partitionBy("feature").orderBy(F.desc("value")))
    return m.where("value IS NOT NULL").withColumn("_k", k_th).where(F.col("_k") <= k).where(F.col("_k") == k).select("feature", F.col("value").alias("kth"))


def quantile_normalise(m: DataFrame) -> DataFrame:
    """Values replaced by the mean over samples of the values of equal rank; ties by feature."""
    ranked = m.withColumn("_k", F.row_number().over(W.partitionBy("sample").orderBy("value", "feature")))
    means = ranked.groupBy("_k").agg(F.avg("value").alias("_mean"))
    return ranked.join(means, "_k").select("feature", "sample", F.col("_mean").alias("value"))


def presence_filter(rows: DataFrame, feature: str, sample: str, least: int) -> DataFrame:
    return rows.groupBy(feature).agg(F.countDistinct(sample).alias("n")).where(F.col("n") >= least)


def translate_ids(rows: DataFrame, names: DataFrame, key: str, name_key: str, name: str, item: str, out: str) -> DataFrame:
    """Items gathered under translated ids, in order and joined by bars; those of ids without a translation under ''."""
    joined = rows.join(names, F.col(key) == F.col(name_key), "left").withColumn(name, F.coalesce(name, F.lit("")))
    return joined.groupBy(name).agg(F.array_join(F.array_sort(F.collect_list(item)), "|").alias(out))


def merge(parts: dict[str, DataFrame], how: str) -> DataFrame:
    """Several (feature, value) tables side by side: of all features (outer) or those of every table (inner)."""
    return reduce(lambda a, b: a.join(b, "feature", how), [p.withColumnRenamed("value", name) for name, p in parts.items()])
