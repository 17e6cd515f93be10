"""Sources of assays: junction counts in their dialects, sparse counts, feature files, sample groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JUNCTIONS = "chrom string, left long, right long, strand string, reads double"


def _fields(spark: SparkSession, path: str, least: int, sep: str = "\t") -> DataFrame:
    c = F.split(F.regexp_replace("value", "\r$", ""), sep, -1)
    return spark.read.text(path).where(~F.col("value").rlike("^(track|browser|#)")).select(c.alias("c"), F.input_file_name().alias("file")).where(F.size("c") >= least)


def _n(i: int) -> Column:
    return F.col("c")[i].try_cast("long")


def junctions(spark: SparkSession, path: str, dialect: str, least: float = 0.0) -> DataFrame:
    """(chrom, left, right, strand, reads, file): left is the last base of the exon before the gap, right the first base
    after it, counted from 1. Rows whose numbers don't parse are left out, as are those of fewer reads than least.

    'bed12': block sizes give the overhangs. 'star': nine columns with the gap's own first and last base; unique and multiple
    reads count. 'tcga': "chr:pos:strand,chr:pos:strand" and a count. 'coverage': ten columns of an exon's coverage, whose ends
    stand for left and right. 'hmm' and 'splicemap' are bed12 with the reads in the name, behind "|junc=" or in brackets before it;
    names without them are left out. 'bioscope_exon': nine columns, of which rows of kind exon count, with left and right one base
    inside. 'bioscope_junction': 22 columns; paired and single reads count."""
    if dialect in ("bed12", "hmm", "splicemap"):
        sizes = F.split(F.col("c")[10], ",")
        counted = {"bed12": F.col("c")[4], "hmm": F.regexp_extract(F.col("c")[3], r"\|junc=([0-9.]+)$", 1), "splicemap": F.regexp_extract(F.col("c")[3], r"^\(([0-9.]+)\)", 1)}[dialect]
        t = _fields(spark, path, 12).select(F.col("c")[0].alias("chrom"), (_n(1) + sizes[0].try_cast("long")).alias("left"), (_n(2) - F.get(sizes, F.lit(1)).try_cast("long") + 1).alias("right"), F.col("c")[5].alias("strand"), counted.try_cast("double").alias("reads"), "file")
    elif dialect == "bioscope_exon":
        t = _fields(spark, path, 9).where(F.col("c")[2] == "exon").select(F.col("c")[0].alias("chrom"), (_n(3) + 1).alias("left"), (_n(4) - 1).alias("right"), F.col("c")[6].alias("strand"), F.col("c")[5].try_cast("double").alias("reads"), "file")
    elif dialect == "bioscope_junction":
        whole = lambda i: F.floor(F.col("c")[i].try_cast("double"))
        t = _fields(spark, path, 22).select(F.col("c")[1].alias("chrom"), _n(4).alias("left"), _n(8).alias("right"), F.col("c")[2].alias("strand"), (whole(17) + whole(19)).cast("double").alias("reads"), "file")
    elif dialect == "star":
        strand = F.when(F.col("c")[3] == "1", "+").when(F.col("c")[3] == "2", "-").otherwise(".")
        t = _fields(spark, path, 9).select(F.col("c")[0].alias("chrom"), (_n(1) - 1).alias("left"), (_n(2) + 1).alias("right"), strand.alias("strand"), (_n(6) + _n(7)).cast("double").alias("reads"), "file")
    elif dialect == "tcga":
        ends = F.split(F.regexp_replace(F.col("c")[0], ",", ":"), ":")
        t = _fields(spark, path, 2).where(F.size(ends) == 6).select(ends[0].alias("chrom"), F.least(ends[1].try_cast("long"), ends[4].try_cast("long")).alias("left"), F.greatest(ends[1].try_cast("long"), ends[4].try_cast("long")).alias("right"), ends[2].alias("strand"), F.col("c")[1].try_cast("double").alias("reads"), "file")
    elif dialect == "coverage":
        t = _fields(spark, path, 10).select(F.col("c")[0].alias("chrom"), (_n(1) + 1).alias("left"), _n(2).alias("right"), F.col("c")[5].alias("strand"), F.col("c")[6].try_cast("double").alias("reads"), "file")
    else:
        raise ValueError(f"no such dialect: {dialect}")
    return t.where(F.col("left").isNotNull() & F.col("right").isNotNull() & (F.col("reads") >= least))


def sparse_counts(spark: SparkSession, matrix: str, features: str, barcodes: str) -> DataFrame:
    """(feature, sample, value) of coordinate triplets with their name files. A name's number is its line's, so each of the two
    name files is read as one text; the triplets are read in parallel."""

    def named(path: str, name: str) -> DataFrame:
        whole = spark.read.text(path, wholetext=True)
        lines = whole.select(F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("_i", "line"))
        return lines.select((F.col("_i") + 1).cast("long").alias(f"_{name}"), F.split("line", "\t")[0].alias(name))

    c = F.split(F.trim("value"), " +")
    body = spark.read.text(matrix).where(~F.col("value").startswith("%")).select(*[c[i].try_cast("double").alias(n) for i, n in enumerate(("_feature", "_sample", "value"))])
    names = [named(features, "feature"), named(barcodes, "sample")]
    body = body.select(F.col("_feature").cast("long").alias("_feature"), F.col("_sample").cast("long").alias("_sample"), "value")
    size = spark.read.text(matrix).where(~F.col("value").startswith("%")).first()  # the first line says the sizes
    rows, cols, filled = (int(x) for x in size[0].split()[:3]) if size else (0, 0, 0)
    sizes = (F.col("_feature") == rows) & (F.col("_sample") == cols) & (F.col("value") == float(filled))
    doubled = body.where(sizes).count() > 1  # a triplet may equal the line of sizes: then both are the same but for one
    out = body.where(~sizes) if not doubled else body.where(~sizes).unionByName(body.where(sizes).distinct())
    return out.join(names[0], "_feature").join(names[1], "_sample").select("feature", "sample", "value")


def features(spark: SparkSession, path: str) -> DataFrame:
    """GFF or GTF lines: (chrom, source, kind, start, end, score, strand, phase, attributes), attributes as a map of either
    key=value or key "value" parts; the first of repeated keys counts."""
    c = F.col("c")
    parts = F.transform(F.filter(F.split(c[8], ";"), lambda p: F.trim(p) != ""), lambda p: F.struct(F.regexp_extract(p, r"^\s*([^\s=]+)", 1).alias("key"), F.trim(F.regexp_replace(F.regexp_extract(p, r"^\s*[^\s=]+[\s=]+(.*)$", 1), '"', "")).alias("value")))
    first = F.filter(parts, lambda p, i: ~F.exists(F.slice(parts, F.lit(1), i), lambda q: q["key"] == p["key"]))
    t = _fields(spark, path, 9).select(c[0].alias("chrom"), c[1].alias("source"), c[2].alias("kind"), _n(3).alias("start"), _n(4).alias("end"), c[5].try_cast("double").alias("score"), c[6].alias("strand"), c[7].alias("phase"), F.map_from_entries(first).alias("attributes"))
    return t.where("start IS NOT NULL AND end IS NOT NULL")


def groups(spark: SparkSession, path: str, line_end: str | None = None) -> DataFrame:
    """(sample, group_id, group) of tab-separated lines without a header."""
    options = {"lineSep": line_end} if line_end else {}
    return spark.read.csv(path, sep="\t", schema="sample string, group_id int, `group` string", **options).where("sample IS NOT NULL")


def comparisons(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="experiment int, baseline int").where("experiment IS NOT NULL AND baseline IS NOT NULL")
