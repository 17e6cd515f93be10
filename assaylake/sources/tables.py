"""Sources: Parquet tables, and matrices kept as delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A text matrix (features in rows, samples in columns) as (feature, sample, value): quotes and the version of ENSG ids go,
    lines that begin with # or ! are comments, what is no number is null. Only the header line comes to the driver."""
    lines = spark.read.text(path).where(~F.col("value").rlike("^[#!]") & (F.trim("value") != ""))
    head = lines.first()
    if head is None:
        return spark.createDataFrame([], "feature string, sample string, value double")
    names = head[0].replace('"', "").rstrip("\r").split(sep)
    cells = F.split(F.regexp_replace("value", '["\r]', ""), sep, -1)
    header = spark.createDataFrame([(names,)], "n array<string>")  # one row, whatever the samples
    rows = lines.where(F.col("value") != head[0]).select(cells.alias("c")).join(F.broadcast(header))
    pairs = rows.select(F.regexp_replace(F.col("c")[0], r"^(ENSG\d+)\.\d+$", "$1").alias("feature"), F.explode(F.slice(F.arrays_zip("n", "c"), 2, max(len(names) - 1, 0))).alias("p"))
    return pairs.select("feature", F.col("p.n").alias("sample"), F.col("p.c").try_cast("double").alias("value"))


def clustered_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A clustered heat map: column 1 after the ids is row_clusters-flat, row 2 column_clusters-flat. Returns (feature, sample,
    row_cluster, column_cluster, value)."""
    m = spark.read.text(path)
    long = matrix(spark, path)
    rows = long.where("sample = 'row_clusters-flat'").select("feature", F.col("value").cast("long").alias("row_cluster"))
    second = m.where(F.col("value").startswith("column_clusters-flat")).first()
    names = m.where(F.col("value").contains("row_clusters-flat")).first()
    pairs = list(zip(names[0].split("\t"), second[0].split("\t")))[2:] if second and names else []
    labels = spark.createDataFrame([(n, c) for n, c in pairs], "sample string, column_cluster string")
    values = long.where("sample != 'row_clusters-flat' AND feature NOT IN ('column_clusters-flat', 'EWEIGHT')")
    return values.join(rows, "feature", "left").join(labels, "sample", "left").select("feature", "sample", "row_cluster", F.col("column_cluster").try_cast("long").alias("column_cluster"), "value")


def clustered_tree_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A .cdt file: (feature, sample, value) without the columns of ids, names and weights that come before the samples, nor the
    rows of array ids and weights."""
    m = matrix(spark, path)
    return m.where(~F.col("sample").isin("CLID", "GID", "NAME", "GWEIGHT", "UNIQID") & ~F.col("feature").isin("AID", "EWEIGHT", "GID"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an interval file: chrom, start, end, and name, score and strand where present. Headers are left out."""
    cols = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike("^(track|browser|#)") & (F.size(cols) >= 3))
    return rows.select(cols[0].alias("chrom"), cols[1].cast("long").alias("start"), cols[2].cast("long").alias("end"), F.get(cols, F.lit(3)).alias("name"), F.get(cols, F.lit(4)).try_cast("double").alias("score"), F.get(cols, F.lit(5)).alias("strand"))
