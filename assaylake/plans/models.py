"""Queries of fitted models; those of iterative fits have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.operators import models
from assaylake.plans.bindings import bound
from assaylake.sources.tables import table


@bound("")
def kmeans(spark, d):
    return models.k_means(table(spark, d, "embeddings").where("embedding IS NOT NULL"), "vec_id", "embedding", 8)


@bound("")
def svd_scores(spark, d):
    x = models.components(table(spark, d, "embeddings"), "vec_id", "embedding", 4)
    return x.select("vec_id", *[F.col("scores")[i].alias(f"c{i + 1}") for i in range(4)])


@bound("SELECT feature, batch, sample, round(value - avg(value) OVER (PARTITION BY feature, batch), 6) + 0.0 AS value FROM (SELECT CAST(l_partkey AS BIGINT) AS feature, l_returnflag AS batch, CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS sample, CAST(l_quantity AS DOUBLE) AS value FROM lineitem)")
def batch_center(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("feature"), F.col("l_returnflag").alias("batch"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample"), F.col("l_quantity").cast("double").alias("value"))
    return models.center_batches(x)


@bound("")
def dispersion_fit(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.avg(F.col("l_quantity").cast("double")).alias("m"), F.var_pop(F.col("l_quantity").cast("double")).alias("v"))
    return spark.createDataFrame([models.dispersion_curve(x, "m", "v")], "c0 double, c1 double, c2 double")
