"""Line dedup: lines that many sites carry are boilerplate. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, keep, read

#: Sites that a line must be on to count as boilerplate, registers of a sketch (2**LG_K), and how far from the threshold
#: an estimate may lie, as a share of it, to be counted anew (twelve standard errors of such a sketch).
MIN_SITES, LG_K, BAND = 10, 12, 0.2


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_rows(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """One row for each line that holds more than spaces: its document, place, site, and 128 bits of hash."""
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_text"), F.col(site).cast("string").alias("_site"), F.posexplode(split_lines(F.col(text))).alias("_pos", "_line"))
    line = F.trim("_line")
    return rows.where(line != "").select("_id", "_text", "_site", "_pos", F.xxhash64(line).alias("_h1"), F.xxhash64(line, F.lit("second")).alias("_h2"))


def spread_lines(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes of the lines on min_sites distinct sites or more.

    A sketch for each line and task is merged by the aggregation. Estimates well above the threshold stand; lines near it
    are counted exactly. A sketch of 2**12 registers errs by 1.6 %, so a band of 20 % leaves nothing to chance."""
    about = keep(
        rows.groupBy("_h1", "_h2").agg(F.hll_sketch_agg("_site", LG_K).alias("_sketch"))
        .select("_h1", "_h2", F.hll_sketch_estimate("_sketch").alias("_sites"))
        .where(F.col("_sites") >= min_sites * (1 - BAND))
    )
    high = min_sites * (1 + BAND)
    near = about.where(F.col("_sites") <= high).select("_h1", "_h2")
    exact = rows.select("_h1", "_h2", "_site").join(near, ["_h1", "_h2"]).groupBy("_h1", "_h2").agg(F.countDistinct("_site").alias("_sites")).where(F.col("_sites") >= min_sites)
    return about.where(F.col("_sites") > high).select("_h1", "_h2").unionByName(exact.select("_h1", "_h2"))


def drop_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with text without its boilerplate lines, and n_lines and n_removed.

    A line (without spaces at its ends) on min_sites distinct sites or more is boilerplate; its first occurrence, in the
    order of key and place, stays, so that no content leaves the corpus. Lines of spaces alone always stay. A null site is
    no site. A null text stays null with no lines, an empty text is one line. Rows that are repeated with key and text
    count as one place and lose the same lines. Texts are taken whole, however long; an empty table gives no row. Other columns
    pass through; one named as a result or as one of the operator's own (_text, _gid, _gtext, _gone) gets an underscore behind its name.
    """
    names = apart(docs.columns, ["n_lines", "n_removed", "_text", "_gid", "_gtext", "_gone"])
    now = dict(zip(docs.columns, names, strict=True))
    docs, key, text, site = docs.toDF(*names), now[key], now[text], now[site]
    rows = line_rows(docs, key, text, site)
    spread = keep(spread_lines(rows, min_sites))
    hits = keep(rows.join(spread, ["_h1", "_h2"]).select("_h1", "_h2", F.struct("_id", "_pos", "_text").alias("_place")))
    first = keep(hits.groupBy("_h1", "_h2").agg(F.min("_place").alias("_first")))
    gone = (
        hits.join(first, ["_h1", "_h2"]).where(F.col("_place") > F.col("_first"))
        .select(F.col("_place._id").alias("_gid"), F.col("_place._text").alias("_gtext"), F.col("_place._pos").alias("_pos"))
        .groupBy("_gid", "_gtext").agg(F.collect_set("_pos").alias("_gone"))
    )
    joined = docs.withColumn("_text", F.xxhash64(text)).join(gone, F.col(key).eqNullSafe(F.col("_gid")) & (F.col("_text") == F.col("_gtext")), "left")
    lines = split_lines(F.col(text))
    rest = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_gone", i)), "\n"))
    return (
        joined.withColumns({"n_lines": F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.when(F.col("_gone").isNotNull(), F.size("_gone")), F.lit(0)).cast("long")})
        .withColumn(text, rest).drop("_text", "_gid", "_gtext", "_gone")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op7: documents without the lines that ten sources or more carry."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return drop_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.col("text").alias("clean_text"))


ORACLE_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, pos, trim(lines[pos]) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)
), spread AS (
  SELECT line FROM rows WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
), hits AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS k FROM rows JOIN spread USING (line)
), gone AS (
  SELECT doc_id, list(pos) AS drop_at FROM hits WHERE k > 1 GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(drop_at), 0) AS BIGINT) AS n_removed,
       CASE WHEN drop_at IS NULL THEN text ELSE array_to_string(
         [string_split(text, chr(10))[i] for i in range(1, len(string_split(text, chr(10))) + 1) if NOT list_contains(drop_at, i)], chr(10)) END AS clean_text
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id
"""
