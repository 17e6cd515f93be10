"""Interval and neighbour joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Levels of bins, and how many times wider a level's are than those of the level below. The last level is one bin.
LEVELS, WIDER = 11, 8


def _own_level(width: float):
    """The level whose bins are as wide as an interval, the lowest if it is shorter than those."""
    length = F.greatest((F.col("end") - F.col("start")) / F.lit(float(width)), F.lit(1.0))
    return F.least(F.ceil(F.ln(length) / F.lit(math.log(WIDER))), F.lit(LEVELS - 1)).cast("int")


def _spread(t: DataFrame, side: str, by: list[str], width: float, present: DataFrame) -> DataFrame:
    """(by, side, _level, _bin, _longer): t's rows, as a struct, under the bins of their own level, as the longer ones (side a: _longer 0, and
    equals count; side b: 1), if the other side has such lower ones, and as the shorter ones under those of its levels above: two bins of a
    level at most, however long an interval is. present: the other side's levels, _levels."""
    # one bin holds the last level
    at = lambda c: F.when(F.col("_level") == LEVELS - 1, F.lit(0)).otherwise(F.floor(F.col(c) / (F.lit(float(width)) * F.pow(F.lit(float(WIDER)), F.col("_level")))))
    names, own = t.columns, F.col("_at")
    less, above, longer = (lambda v: v <= own, lambda v: v > own, 0) if side == "a" else (lambda v: v < own, lambda v: v >= own, 1)
    of = lambda levels, kind: F.transform(levels, lambda v: F.struct(v.alias("level"), F.lit(kind).alias("longer")))
    longest = F.when(F.exists("_levels", less), F.array(own)).otherwise(F.array().cast("array<int>"))
    emitted = F.concat(of(longest, longer), of(F.filter("_levels", above), 1 - longer))
    levelled = t.withColumn("_at", _own_level(width)).join(F.broadcast(present)).withColumn("_x", F.explode(emitted)).withColumns({"_level": F.col("_x.level"), "_longer": F.col("_x.longer")})
    binned = levelled.withColumn("_bin", F.explode(F.sequence(at("start").cast("long"), at("end").cast("long"))))
    return binned.select(*by, F.struct(*names).alias(side), "_level", "_longer", "_bin")


def meet(one: DataFrame, two: DataFrame, by: list[str], width: float, touch: bool = True) -> DataFrame:
    """(by, a, b): the rows of one and two, as structs, whose intervals (start, end) share a point and the keys. touch: both ends
    belong to an interval; else its end doesn't.

    Of two intervals the longer one is under its own level's bins and the shorter one is there too, so each pair meets; it counts
    in the bin of its common part's start. Which side has the longer level is part of the key (of one: 0, equal ones included; of two: 1),
    and a row is under a level only if the other side has such intervals there: so it is one join, and a table is dealt out once. An
    interval makes at most two rows for each level that some interval has as its own, one more for its own, of LEVELS at most, whatever
    its length; and intervals only meet where one of them is as long as the bin."""
    # one row of LEVELS numbers at most
    levels = lambda t: t.agg(F.collect_set(_own_level(width)).alias("_levels"))
    a, b = _spread(one, "a", by, width, levels(two)), _spread(two, "b", by, width, levels(one))
    over = (lambda x, y: x <= y) if touch else (lambda x, y: x < y)
    start = F.greatest("a.start", "b.start")
    first = F.when(F.col("_level") == LEVELS - 1, F.lit(0)).otherwise(F.floor(start / (F.lit(float(width)) * F.pow(F.lit(float(WIDER)), F.col("_level")))))
    # sized by the rows before explode, either side would be broadcast though it is many times larger
    met = a.hint("merge").join(b, [*by, "_level", "_longer", "_bin"])
    return met.where(over(F.col("a.start"), F.col("b.end")) & over(F.col("b.start"), F.col("a.end")) & (F.col("_bin") == first)).select(*by, "a", "b")


def self_overlaps(x: DataFrame, by: list[str], key: str, width: float) -> DataFrame:
    """Pairs i < j of intervals [start, end) with a common point."""
    own = x.select(*by, "start", "end", F.col(key).alias("_key"))
    return meet(own, own, by, width, touch=False).where("a._key < b._key").select(*by, F.col("a._key").alias("i"), F.col("b._key").alias("j"))


def points_in(points: DataFrame, bands: DataFrame, by: list[str], at: str) -> DataFrame:
    """Points inside their group's band [lo, hi]."""
    return points.join(bands, by).where((F.col(at) >= F.col("lo")) & (F.col(at) <= F.col("hi")))


def neighbours(x: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return x.select(key, F.lag(key).over(w).alias("before"), F.lead(key).over(w).alias("after"))


def overlaps(one: DataFrame, two: DataFrame, by: list[str], width: int) -> DataFrame:
    """(i, j): the keys of two tables of intervals [start, end], both ends in, that share a point and the columns in by."""
    return meet(one, two, by, width).select(F.col("a.key").alias("i"), F.col("b.key").alias("j"))


def matched(one: DataFrame, two: DataFrame, by: list[str], width: int) -> DataFrame:
    """(key, n, least): for every interval of one how many of two overlap it, none included, and the smallest key of those. Keys of
    one are unique."""
    found = overlaps(one, two, by, width).groupBy(F.col("i").alias("key")).agg(F.count("*").alias("n"), F.min("j").alias("least"))
    return one.select("key").join(found, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"), "least")


def genes_of(segments: DataFrame, genes: DataFrame, width: int) -> DataFrame:
    """(key, gene, other): segments (key, chr, start, end) by the first gene (by its start, then its name) that both ends are in;
    where there is none, the first genes of either end, if they differ: a segment from one gene to another. Both null: in no
    gene."""
    at = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("start").alias("at")), F.struct(F.lit(1).alias("side"), F.col("end").alias("at"))))
    ends = segments.select("key", "chr", F.col("start").alias("_s"), F.col("end").alias("_e"), at.alias("x")).withColumns({"start": F.col("x.at"), "end": F.col("x.at")})
    met = meet(ends, genes.select("chr", "gene", "start", "end"), ["chr"], width).select("a.key", "a.x", "a._s", "a._e", "b.gene", F.col("b.start").alias("_gs"), F.col("b.end").alias("_ge"))
    order = F.struct("_gs", "gene")
    both = F.when((F.col("_gs") <= F.col("_s")) & (F.col("_ge") >= F.col("_e")), order)
    s = met.groupBy("key").agg(F.min(both).alias("_b"), F.min(F.when(F.col("x.side") == 0, order)).alias("_l"), F.min(F.when(F.col("x.side") == 1, order)).alias("_r"))
    one, two = F.col("_l.gene"), F.col("_r.gene")
    first = F.coalesce(F.col("_b.gene"), one, two)
    s = s.select("key", first.alias("gene"), F.when(F.col("_b").isNull() & one.isNotNull() & two.isNotNull() & (one != two), two).alias("other"))
    return segments.select("key").join(s, "key", "left")
