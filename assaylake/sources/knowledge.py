"""Sources of sets, ontologies and interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gene_sets(spark: SparkSession, path: str, prefix: str = "GO:") -> DataFrame:
    """(element, gene_set) of a file with a header: set names in the third column, or two columns whose second is an ontology
    number, padded to seven digits and prefixed."""
    c = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    lines = spark.read.text(path)
    head = lines.first()
    rows = lines.where(F.col("value") != (head[0] if head else "")).where(F.size(c) >= 2)
    number = F.regexp_replace(c[1], f"^{prefix}", "")
    return rows.select(c[0].alias("element"), F.when(F.size(c) >= 3, F.get(c, F.lit(2))).otherwise(F.concat(F.lit(prefix), F.lpad(number, 7, "0"))).alias("gene_set")).distinct()


def gmt(spark: SparkSession, path: str) -> DataFrame:
    """(element, gene_set) of lines: name, description, elements."""
    c = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    return spark.read.text(path).where(F.size(c) > 2).select(c[0].alias("gene_set"), F.explode(F.slice(c, F.lit(3), F.size(c))).alias("element")).where("element != ''").select("element", "gene_set").distinct()


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, namespace, parents) of an OBO file's terms; stanzas are the records."""
    t = spark.read.text(path, lineSep="\n[").where(F.col("value").rlike(r"^\[?Term\]"))
    first = lambda key: F.nullif(F.regexp_extract("value", rf"(?m)^{key}: ([^\r\n]*)", 1), F.lit(""))
    obsolete = F.col("value").rlike(r"(?m)^is_obsolete: true")
    return t.where(~obsolete).select(first("id").alias("id"), first("name").alias("name"), first("namespace").alias("namespace"), F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), F.lit(1)).alias("parents")).where("id IS NOT NULL")


def parents(terms: DataFrame) -> DataFrame:
    """(child, parent) edges of ontology(), as closure() takes them."""
    return terms.select(F.col("id").alias("child"), F.explode("parents").alias("parent"))


def interactions(spark: SparkSession, path: str) -> DataFrame:
    """(a, kind, b) of SIF lines; a line of several targets gives a row for each."""
    c = F.split(F.trim(F.regexp_replace("value", "\r$", "")), "\t")
    return spark.read.text(path).where(F.size(c) >= 3).select(c[0].alias("a"), c[1].alias("kind"), F.explode(F.slice(c, F.lit(3), F.size(c))).alias("b")).where("b != ''")


def pathway_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(pathway file, label, id, database) of the data nodes of GPML files."""
    schema = "_TextLabel string, Xref struct<_ID: string, _Database: string>"
    x = spark.read.format("xml").option("rowTag", "DataNode").schema(schema).load(path)
    return x.select(F.input_file_name().alias("file"), F.trim("_TextLabel").alias("label"), F.col("Xref._ID").alias("id"), F.col("Xref._Database").alias("database"))
