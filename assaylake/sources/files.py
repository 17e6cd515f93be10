"""Sources of binary and tool-made files: alignments, worksheets, databases, dumps and quantifier outputs."""

from __future__ import annotations

import io
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.sources.alignments import bam as bam

#: Rows of a database that are handed on at once.
ROWS = 20_000


def _bytes(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file with its content: a file of 2 GB at most, in one task."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def sam(spark: SparkSession, path: str) -> DataFrame:
    """The records of SAM text, read in parallel."""
    c = F.split("value", "\t")
    pairs = F.transform(F.slice(c, F.lit(12), F.greatest(F.size(c) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, F.lit(6), F.length(t)).alias("value")))
    t = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(c) >= 11))
    return t.select(F.input_file_name().alias("file"), c[0].alias("name"), c[1].try_cast("int").alias("flag"), F.nullif(c[2], F.lit("*")).alias("chrom"), c[3].try_cast("long").alias("pos"), c[5].alias("cigar"), c[9].alias("seq"), F.map_from_entries(pairs).alias("tags"))


def gaps(pos: Column, cigar: Column) -> Column:
    """The (left, right) bases around each skipped stretch of an alignment that begins at pos."""
    steps = F.regexp_extract_all(cigar, F.lit(r"(\d+[MDN=X])"), 1)
    start = F.struct(pos.cast("long").alias("at"), F.array().cast("array<struct<left:bigint,right:bigint>>").alias("found"))

    def step(acc, s):
        n = F.regexp_extract(s, r"^\d+", 0).cast("long")
        gap = F.struct((acc["at"] - 1).alias("left"), (acc["at"] + n).alias("right"))
        return F.struct((acc["at"] + n).alias("at"), F.when(s.endswith("N"), F.concat(acc["found"], F.array(gap))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(steps, start, step, lambda acc: acc["found"])


def spliced(alignments: DataFrame, least: int = 1) -> DataFrame:
    """(file, chrom, left, right, strand, reads): alignments over each gap, counted by its ends and strand tag (XS, or '.')."""
    g = alignments.where(F.col("chrom").isNotNull() & F.col("cigar").contains("N")).select("file", "chrom", F.coalesce(F.try_element_at("tags", F.lit("XS")), F.lit(".")).alias("strand"), F.explode(gaps(F.col("pos"), F.col("cigar"))).alias("g"))
    return g.groupBy("file", "chrom", F.col("g.left").alias("left"), F.col("g.right").alias("right"), "strand").agg(F.count("*").alias("reads")).where(F.col("reads") >= least)


def barcoded(alignments: DataFrame, barcode: str = "CB", umi: str = "UB", gene: str = "GX") -> DataFrame:
    """(barcode, umi, tag) of the alignments that carry all three tags."""
    own = lambda t: F.try_element_at("tags", F.lit(t))
    return alignments.select(own(barcode).alias("barcode"), own(umi).alias("umi"), own(gene).alias("tag")).dropna()


def fastq(spark: SparkSession, path: str, barcode: int, umi: int) -> DataFrame:
    """(file, barcode, umi, rest): reads whose first bases are a barcode and then a molecule's tag. What begins with '@'
    on a line of its own and has a plus line after its second is a read, whatever its qualities begin with; shorter ones are left
    out."""
    text = spark.read.option("lineSep", "\n@").text(path)
    line = F.split(F.regexp_replace("value", "\r", ""), "\n")
    seq = F.get(line, F.lit(1))
    t = text.where((F.size(line) >= 3) & F.get(line, F.lit(2)).startswith("+") & (F.length(seq) >= barcode + umi))
    return t.select(F.input_file_name().alias("file"), F.substring(seq, 1, barcode).alias("barcode"), F.substring(seq, barcode + 1, umi).alias("umi"), F.substring(seq, F.lit(barcode + umi + 1), F.length(seq)).alias("rest"))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref).group():
        n = n * 26 + ord(c) - 64
    return n


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row, cells) of a workbook, sheets by name and in order."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{ns}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in parts else []
        rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        sheets = [(s.get("name"), s.get(rel)) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{ns}sheet")]
        # a sheet's file is what its relation names: files keep their numbers when sheets are moved or deleted
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in parts else {}
        for i, (name, own) in enumerate(sheets, 1):
            target = targets.get(own, f"worksheets/sheet{i}.xml")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part not in parts:
                raise ValueError(f"the workbook has no file for its sheet {name}")
            if not part.startswith("xl/worksheets/"):
                continue  # a chart on a sheet of its own has no rows
            for row in ElementTree.fromstring(z.read(part)).iter(f"{ns}row"):
                cells: list[str | None] = []
                for c in row.iter(f"{ns}c"):
                    at = _column(c.get("r") or "") or len(cells) + 1
                    cells += [None] * (at - len(cells))
                    v = c.find(f"{ns}v")
                    if c.get("t") == "inlineStr":
                        cells[at - 1] = "".join(t.text or "" for t in c.iter(f"{ns}t"))
                    elif v is not None:
                        cells[at - 1] = shared[int(v.text)] if c.get("t") == "s" else v.text
                yield name, int(row.get("r") or 0), cells


def worksheets(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, cells) of workbooks (.xlsx); empty cells are null."""

    def read(frames):
        for frame in frames:
            for file, content in zip(frame["file"], frame["content"], strict=True):
                yield pd.DataFrame([(file, *r) for r in sheet_rows(content)], columns=["file", "sheet", "row", "cells"])

    return _bytes(spark, path).repartition("file").mapInPandas(read, "file string, sheet string, row int, cells array<string>")


def sqlite(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """The rows that a query gives in each of the SQLite files, in one task a file."""
    names = spark.createDataFrame([], schema).columns

    def read(frames):
        for frame in frames:
            for content in frame["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(content)
                cursor = db.execute(sql)
                while rows := cursor.fetchmany(ROWS):
                    yield pd.DataFrame(rows, columns=names)
                db.close()

    return _bytes(spark, path).repartition("file").select("content").mapInPandas(read, schema)


def dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A relational table's text dump: tabs between fields, \\\\N for null, no header and no quotes."""
    return spark.read.csv(path, sep="\t", schema=schema, nullValue="\\N", quote="", escape="", emptyValue="")


# fixed values: the columns of ids and values by tool
QUANTIFIERS = {"kallisto": ("target_id", "tpm"), "kallisto counts": ("target_id", "est_counts"), "rsem": ("gene_id", "TPM"), "rsem counts": ("gene_id", "expected_count"), "cufflinks": ("tracking_id", "FPKM"), "salmon": ("Name", "TPM")}


def quantified(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """(feature, sample, value) of quantifier outputs, a file or its folder for each sample; repeated ids are summed."""
    if tool not in QUANTIFIERS:
        raise ValueError(f"no such tool: {tool}")
    key, value = QUANTIFIERS[tool]
    t = spark.read.csv(path, sep="\t", header=True)
    return t.select(F.col(f"`{key}`").alias("feature"), F.input_file_name().alias("sample"), F.col(f"`{value}`").try_cast("double").alias("value")).groupBy("feature", "sample").agg(F.sum("value").alias("value"))


def scanner(spark: SparkSession, path: str, probe: str = "ProbeName", signal: str = "gProcessedSignal") -> DataFrame:
    """(feature, sample, value) of feature-extraction text: the columns are named in the line that begins with FEATURES, values
    in those that begin with DATA; probes that repeat are averaged."""
    c = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    t = spark.read.text(path).select(F.input_file_name().alias("sample"), c.alias("c"))
    head = t.where(F.col("c")[0] == "FEATURES").groupBy("sample").agg(F.min("c").alias("head"))
    at = lambda n: F.get("c", (F.array_position("head", n) - 1).cast("int"))
    rows = t.where(F.col("c")[0] == "DATA").join(F.broadcast(head), "sample")  # a row for each file
    return rows.select(at(probe).alias("feature"), "sample", at(signal).try_cast("double").alias("value")).groupBy("feature", "sample").agg(F.avg("value").alias("value"))
