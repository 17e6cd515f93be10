"""Sinks: wide text matrices, sparse triplets, results by comparison, interaction lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators.ranks import global_rank


def wide(m: DataFrame, samples: list[str]) -> DataFrame:
    """(feature, sample, value) with a column for each named sample, in that order."""
    return m.groupBy("feature").pivot("sample", samples).agg(F.first("value")).select("feature", *[F.col(f"`{s}`") for s in samples])


def chosen(m: DataFrame, samples: list[str], missing: str = "drop") -> DataFrame:
    """wide() of the samples on a list, in its order. One that the matrix lacks is left out ('drop'), a column of nulls ('include')
    or an error ('error'). What comes to the driver are the names of those that it has."""
    if missing not in ("drop", "include", "error"):
        raise ValueError(f"no such mode: {missing}")
    have = {r["sample"] for r in m.where(F.col("sample").isin(*samples)).select("sample").distinct().collect()}
    if missing == "error" and (lack := [s for s in samples if s not in have]):
        raise ValueError(f"no samples named {', '.join(lack)}")
    return wide(m, samples if missing == "include" else [s for s in samples if s in have])


def write_matrix(m: DataFrame, samples: list[str], path: str) -> None:
    wide(m, samples).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="")


def triplets(m: DataFrame) -> DataFrame:
    """(row, column, count) of the cells that aren't zero, numbered from 1 in the order of names; counts are 2^x - 1, cut to
    whole numbers. Names are numbered by ranges, so that no task holds them all."""
    numbered = lambda c, n: global_rank(m.select(c).distinct(), [c], n, "_n", "_part").select(c, n)
    x = m.where("value != 0").join(numbered("feature", "row"), "feature").join(numbered("sample", "column"), "sample")
    return x.select("row", "column", (F.pow(F.lit(2.0), "value") - 1).cast("long").alias("count"))


def write_by_comparison(results: DataFrame, path: str, comparison: str = "comparison") -> None:
    """One folder for each comparison."""
    results.write.mode("overwrite").partitionBy(comparison).option("header", True).option("sep", "\t").csv(path)


def write_interactions(edges: DataFrame, path: str) -> None:
    edges.select("a", "kind", "b").write.mode("overwrite").csv(path, sep="\t")


def write_lists(calls: DataFrame, path: str, comparison: str = "comparison") -> None:
    """A folder for each comparison and direction with the ids that are called so, and one with all ids as the denominator."""
    every = calls.select(F.lit("denominator").alias(comparison), F.lit("all").alias("call"), "feature").distinct()
    called = calls.where("call <> 'none'").select(comparison, "call", "feature")
    called.unionByName(every).write.mode("overwrite").partitionBy(comparison, "call").csv(path, sep="\t")


def clustered(m: DataFrame, samples: list[tuple[str, int]]) -> DataFrame:
    """(feature, row_cluster, place, sample, value) as a clustered matrix: a column for each sample in the given order, row
    clusters first, and the samples' clusters as a row of their own; rows by place."""
    names = [s for s, _ in samples]
    body = m.groupBy("feature", "row_cluster", "place").pivot("sample", names).agg(F.first("value"))
    cells = [F.col(f"`{s}`").cast("string").alias(s) for s in names]
    body = body.select("place", F.col("feature").alias("UID"), F.col("row_cluster").cast("string").alias("row_clusters-flat"), *cells)
    top = m.sparkSession.range(1).select(F.lit(0).cast("long").alias("place"), F.lit("column_clusters-flat").alias("UID"), F.lit("").alias("row_clusters-flat"), *[F.lit(str(c)).alias(s) for s, c in samples])
    return top.unionByName(body.withColumn("place", F.col("place").cast("long"))).orderBy("place").drop("place")


def write_clustered(m: DataFrame, samples: list[tuple[str, int]], path: str) -> None:
    clustered(m, samples).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="")
