"""A corpus from documents: toxic documents go, boilerplate lines go, near copies go, benchmark leaks go, ids come out.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All but the last return the
columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm import lines, near, pieces, toxicity, winnow
from assaylake.llm.common import keep, read

#: Words in a shingle of the near-dedup stage, and the least share of shingles that links two documents.
SHINGLE, SIMILARITY = 5, 0.8


def rowed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row, _row, written so that it stays the same however often it is read."""
    return keep(docs.withColumn("_row", F.monotonically_increasing_id()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of documents and labels in sf_dir scores below one half."""
    scored = toxicity.score(docs, toxicity.trained(spark, sf_dir), carry=tuple(docs.columns))
    return scored.where(F.col("toxicity") < 0.5).drop("toxicity")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that ten sources or more carry, each line's first occurrence apart; n_chars follows the
    text. A document that loses every line holds nothing of its own and goes."""
    out = lines.drop_boilerplate(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"\S")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(~emptied | F.col("text").isNull()).withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (an identical set of shingles, or a Jaccard similarity of SIMILARITY or more,
    linked through any others; found by segment tables, verified on whole sets): that of the smallest doc_id, any id before null; of rows with that id, the
    one of the smallest hash of its text. Rows count one by one, whether their doc_id repeats or is null."""
    rows = rowed(docs)
    found = keep(near.near_copies(rows, "_row", size=SHINGLE, least=SIMILARITY))
    many = found.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1").select("component")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_row")
    held = keep(rows.select("_row", order.alias("_order")).join(found.join(many, "component"), "_row"))
    stay = keep(held.groupBy("component").agg(F.min("_order").alias("_stay")))
    gone = held.join(stay, "component").where(F.col("_order") > F.col("_stay")).select("_row")
    return rows.join(keep(gone), "_row", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. That is a matter of the text alone, so documents go by 128 bits of hash
    of theirs, whether their doc_id repeats or is null."""
    rows = docs.withColumns({"_h1": F.xxhash64("text"), "_h2": F.xxhash64("text", F.lit("second"))})
    found = winnow.hits(rows.select(F.struct("_h1", "_h2").alias("_key"), "text"), read(spark, sf_dir, "benchmark"), "_key")
    leaks = keep(found.where(F.size("hit") > 0).select("_key._h1", "_key._h2").distinct())
    return rows.join(leaks, ["_h1", "_h2"], "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    return pieces.encode(docs, carry=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: Trained scores, XXH64 fingerprints and a tokenizer aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each written to the shared folder and read back as the next one's input."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = keep(docs) if i < len(STAGES) - 1 else docs
    return docs
