"""Splicing: shares of inclusion, exon regions, retention, indices, directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.operators import intervals


def delta_psi(x: DataFrame, one: str, two: str, reads: float = 9.0, least: float = 0.15) -> DataFrame:
    """(feature, grp, included, reads): psi of both groups and their difference, of features with that many reads in both
    groups and a difference over least."""
    s = x.where(F.col("grp").isin(one, two)).groupBy("feature").agg(*[F.sum(F.when((F.col("grp") == g) & p, F.col("reads")).otherwise(0.0)).alias(n) for g, i in ((one, 1), (two, 2)) for n, p in ((f"i{i}", F.col("included")), (f"a{i}", F.lit(True)))])
    s = s.where((F.col("a1") >= reads) & (F.col("a2") >= reads)).select("feature", F.try_divide("i1", "a1").alias("psi_one"), F.try_divide("i2", "a2").alias("psi_two"))
    return s.withColumn("dpsi", F.col("psi_one") - F.col("psi_two")).where(F.abs("dpsi") > least)


def overlap_psi(j: DataFrame, width: float) -> DataFrame:
    """(gene, junction, start, end, reads): each junction's reads over its own and those of all junctions of its gene that
    share a point with it, ends included."""
    own = j.select("gene", "start", "end", "junction", "reads")
    met = intervals.meet(own, own, ["gene"], width).where(F.col("a.junction") != F.col("b.junction"))
    against = met.groupBy("gene", F.col("a.junction").alias("junction")).agg(F.sum("b.reads").alias("_r"))
    total = F.col("reads") + F.coalesce("_r", F.lit(0.0))
    return j.join(against, ["gene", "junction"], "left").select("gene", "junction", F.when(total > 0, F.try_divide("reads", total)).alias("psi"))


def clusters(x: DataFrame, by: list[str]) -> DataFrame:
    """x with cluster, numbered from 1 in each group: intervals [start, end] with a common point, directly or through
    others, are together. One sort: a cluster begins where the start is beyond every earlier end."""
    w = W.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    opened = x.withColumn("_new", F.when(before >= F.col("start"), 0).otherwise(1))
    return opened.withColumn("cluster", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def regions(x: DataFrame, by: list[str]) -> DataFrame:
    """(by, cluster, region, start, end): the pieces between the sorted distinct ends of a cluster's intervals."""
    c = clusters(x, by)
    cuts = c.select(*by, "cluster", F.explode(F.array("start", "end")).alias("start")).distinct()
    w = W.partitionBy(*by, "cluster").orderBy("start")
    return cuts.withColumn("end", F.lead("start").over(w)).withColumn("region", F.row_number().over(w)).where("end IS NOT NULL")


def retained(x: DataFrame, least: float = 9.0) -> DataFrame:
    """(gene, kind, reads): the share of a gene's junction reads that cross into introns; null where they are least or
    fewer, 0 where the intron reads are."""
    s = x.groupBy("gene").agg(F.sum(F.when(F.col("kind") == "intron", F.col("reads")).otherwise(0.0)).alias("_i"), F.sum("reads").alias("_a"))
    return s.select("gene", F.when(F.col("_a") <= least, None).when(F.col("_i") <= least, 0.0).otherwise(F.col("_i") / F.col("_a")).alias("share"))


def splicing_index(exons: DataFrame, genes: DataFrame) -> DataFrame:
    """(feature, gene, sample, value) less its gene's value in the sample, both logarithms."""
    return exons.join(genes.select("gene", "sample", F.col("value").alias("_g")), ["gene", "sample"]).select("feature", "gene", "sample", (F.col("value") - F.col("_g")).alias("value"))


def direction(x: DataFrame) -> DataFrame:
    """(start, end, other_start, other_end): 'inclusion' where the junction is the shorter of the two, else 'exclusion'."""
    own, other = F.abs(F.col("end") - F.col("start")), F.abs(F.col("other_end") - F.col("other_start"))
    return x.withColumn("direction", F.when(own < other, "inclusion").when(own > other, "exclusion"))


def predominant(x: DataFrame) -> DataFrame:
    """(gene, isoform, sample, value): each isoform's share of its gene in the sample, and whether it is the largest."""
    w = W.partitionBy("gene", "sample")
    share = F.try_divide("value", F.sum("value").over(w))
    first = F.row_number().over(w.orderBy(F.desc("value"), "isoform")) == 1
    return x.select("gene", "isoform", "sample", share.alias("share"), first.alias("main"))


def aspire(before_in: Column, after_in: Column, before_out: Column, after_out: Column) -> Column:
    """The change of inclusion from two reciprocal junctions' levels before and after: the mean of the change of the share, and
    of what the two ratios of change solve for; null where they can't be solved."""
    rise_in, rise_out = F.try_divide(before_in, after_in), F.try_divide(before_out, after_out)
    solved = F.try_divide((rise_out - 1.0) - (rise_out - 1.0) * rise_in, rise_out - rise_in)
    share = F.try_divide(after_in, after_in + after_out) - F.try_divide(before_in, before_in + before_out)
    return (solved + share) / 2.0


def event_kind(one: Column, two: Column) -> Column:
    """The kind of event that two junctions 'E<exon>.<region>-E<exon>.<region>' make."""
    part = lambda j, i: F.regexp_extract(j, r"E(\d+)\.(\d+)[^-]*-E(\d+)\.(\d+)", i).cast("int")
    (a, ra, b, _), (c, rc, d, _) = ([part(j, i) for i in (1, 2, 3, 4)] for j in (one, two))
    first = one.contains("E1.")
    return (
        F.when((a == c) & (b == d), F.when(ra == rc, "alt-3'").otherwise("alt-5'")).when(a == c, "cassette-exon")
        .when(b == d, F.when(first, "altPromoter").otherwise("cassette-exon")).when(first | two.contains("E1.1"), "altPromoter").otherwise("cassette-exon")
    )


def uncover(pairs: DataFrame, one: str, two: str, by: str) -> DataFrame:
    """Levels less the smallest that a pair's two sides have in common, sample by sample: of sides that overlap, what both
    count is taken off once."""
    low = F.min(F.least(one, two)).over(W.partitionBy(by))
    return pairs.withColumn("_low", low).withColumns({one: F.col(one) - F.col("_low"), two: F.col(two) - F.col("_low")}).drop("_low")


def reciprocal(junctions: DataFrame) -> DataFrame:
    """(gene, outer, inner, side): pairs of a gene's junctions (junction, left, right) that share one end, the longer one being
    what leaves out. Only junctions of one end meet."""
    out = None
    for side, far in (("left", "right"), ("right", "left")):
        a, b = (junctions.select("gene", side, F.col("junction").alias(n), F.col(far).alias(f"_{n}")) for n in ("outer", "inner"))
        longer = F.col("_outer") > F.col("_inner") if side == "left" else F.col("_outer") < F.col("_inner")
        met = a.join(b, ["gene", side]).where(longer).select("gene", "outer", "inner", F.lit(side).alias("side"))
        out = met if out is None else out.unionByName(met)
    return out


def isoform_junctions(exons: DataFrame, counts: DataFrame) -> DataFrame:
    """(gene, left, right, reads): counts of isoforms summed over the junctions between their exons that follow each other."""
    after = F.lead("start").over(W.partitionBy("isoform").orderBy("start", "end"))
    j = exons.withColumn("right", after).where("right IS NOT NULL").select("gene", "isoform", F.col("end").alias("left"), "right")
    return j.join(counts, "isoform").groupBy("gene", "left", "right").agg(F.sum("reads").alias("reads"))


def novel_ranked(m: DataFrame, over: float, samples: int) -> DataFrame:
    """(gene, feature, top, place): features above a level in more than so many samples, by their largest value within their
    gene; ties by feature."""
    s = m.groupBy("gene", "feature").agg(F.max("value").alias("top"), F.count_if(F.col("value") > over).alias("_n")).where(F.col("_n") > samples).drop("_n")
    return s.withColumn("place", F.row_number().over(W.partitionBy("gene").orderBy(F.desc("top"), "feature")))


def counted_kinds(events: DataFrame, least: dict[str, int]) -> DataFrame:
    """Events (event, kind, one, two) whose two counts together reach the least of their kind; kinds without one stay."""
    bound = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in least.items()], F.lit(0))
    return events.where(F.col("one") + F.col("two") >= bound)
