"""Features of proteins on the genome: stretches of residues through the coding exons onto regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaylake.operators import intervals


def coding_pieces(exons: DataFrame) -> DataFrame:
    """(transcript, chrom, strand, start, end, first, last): coding exons (transcript, chrom, strand, start, end: the coding part
    alone) with the places, from 1, of their first and last base in the coding sequence, which runs backwards on strand '-'."""
    length = F.col("end") - F.col("start") + 1
    order = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    last = F.sum(length).over(W.partitionBy("transcript").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return exons.withColumn("last", last).withColumn("first", F.col("last") - length + 1).select("transcript", "chrom", "strand", "start", "end", "first", "last")


def on_genome(features: DataFrame, exons: DataFrame) -> DataFrame:
    """(feature, transcript, chrom, strand, start, end): features (feature, transcript, from_residue, to_residue; residues from 1)
    as stretches of the genome, one for each coding exon that they reach into. What lies behind the sequence's end is cut off."""
    a, b = (F.col("from_residue") - 1) * 3 + 1, F.col("to_residue") * 3
    met = features.join(coding_pieces(exons), "transcript").where((F.col("first") <= b) & (F.col("last") >= a))
    low, high = F.greatest("first", a) - F.col("first"), F.least("last", b) - F.col("first")
    back = F.col("strand") == "-"
    start = F.when(back, F.col("end") - high).otherwise(F.col("start") + low)
    end = F.when(back, F.col("end") - low).otherwise(F.col("start") + high)
    return met.select("feature", "transcript", "chrom", "strand", start.alias("start"), end.alias("end"))


def on_regions(features: DataFrame, exons: DataFrame, regions: DataFrame, width: int = 256) -> DataFrame:
    """(region, feature, bases): how many bases of each feature lie in regions (region, gene, chrom, start, end) of its own gene.
    features and exons as for on_genome, features with a gene."""
    pieces = on_genome(features, exons).join(features.select("feature", "gene").distinct(), "feature")
    met = intervals.meet(regions.select("gene", "chrom", "start", "end", "region"), pieces.select("gene", "chrom", "start", "end", "feature"), ["gene", "chrom"], width)
    shared = F.least("a.end", "b.end") - F.greatest("a.start", "b.start") + 1
    return met.groupBy(F.col("a.region").alias("region"), F.col("b.feature").alias("feature")).agg(F.sum(shared).cast("long").alias("bases"))


def changed(on: DataFrame, regions: DataFrame) -> DataFrame:
    """(feature, lost, kept): of each feature on regions (see on_regions) the bases in regions that are left out (region, spliced_out) and in
    those that stay; features that lose none are left out."""
    s = on.join(regions.select("region", "spliced_out"), "region").groupBy("feature").agg(F.sum(F.when(F.col("spliced_out"), F.col("bases")).otherwise(0)).alias("lost"), F.sum(F.when(F.col("spliced_out"), 0).otherwise(F.col("bases"))).alias("kept"))
    return s.where("lost > 0")
