"""Reads' stretches are worked out once, intervals aren't broadcast, and genes are sampled in tasks of some genes each."""

from pyspark.sql import functions as F

from assaylake.operators import intervals, isoforms, reads


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_once_a_read(spark):
    rows = [(5, "10M5N3D2I4M"), (5, "5N10M"), (7, "3S4M2N0M1N2M"), (9, "7=2X3N4="), (9, "4I"), (None, "5M"), (3, None), (1, "10M")]
    at = spark.createDataFrame(rows, "pos long, cigar string").select(F.lit("c").alias("chrom"), "pos", "cigar")
    got = {(r.pos, r.cigar): [tuple(b) for b in r.blocks] for r in reads.placed(at).collect()}
    assert got == {(5, "10M5N3D2I4M"): [(5, 14), (20, 26)], (5, "5N10M"): [(10, 19)], (7, "3S4M2N0M1N2M"): [(7, 10), (14, 15)], (9, "7=2X3N4="): [(9, 17), (21, 24)], (1, "10M"): [(1, 10)]}
    plan = executed(reads.placed(at).select("start", "end", "blocks"))
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan


def test_bins_are_not_broadcast(spark):
    x = spark.range(50).select(F.lit("c").alias("chrom"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 12).alias("end"), F.col("id").alias("key"))
    found = intervals.overlaps(x, x, ["chrom"], 8)
    assert "BroadcastHashJoin" not in executed(found) and found.count() == 50 + 2 * 49


def test_genes_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(isoforms, "GENES", 10)
    sizes = spark.range(75).select(F.col("id").alias("gene"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("isoform"), F.lit(50).cast("long").alias("length"))
    classes = spark.range(75).select(F.col("id").alias("gene"), F.array(F.lit("a")).alias("isoforms"), F.lit(3).cast("long").alias("reads"))
    found = isoforms.sampled(classes, sizes)
    assert found.rdd.getNumPartitions() == 8 and found.count() == 150
