"""Sets: over-representation and Venn counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.operators import draws


def over_representation(every: DataFrame, hit: DataFrame, members: DataFrame) -> DataFrame:
    """gene_set, n, r, z: a set's measured and selected elements and the hypergeometric z score."""
    sets = set_counts(every, hit, members)
    n, r, tn = F.col("n"), F.col("r"), F.col("tn")
    p = F.col("tr") / tn
    z = F.try_divide(r - n * p, F.sqrt(n * p * (1 - p) * (1 - (n - 1.0) / (tn - 1.0))))
    return sets.select("gene_set", "n", "r", F.when((tn > 1) & (n < tn) & (F.col("tr") > 0), z).alias("z"))


def venn(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """part, n: elements in exactly the named sets."""
    tagged = reduce(DataFrame.unionByName, [s.select(key, F.lit(name).alias("_s")) for name, s in sets.items()])
    return tagged.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("_s")), "&").alias("part")).groupBy("part").agg(F.count("*").alias("n"))


def set_counts(every: DataFrame, hit: DataFrame, members: DataFrame) -> DataFrame:
    """gene_set, n, r, tn, tr: a set's measured and selected elements, and those of the whole list."""
    marked = every.join(hit.withColumn("_hit", F.lit(1)), "element", "left")
    sets = marked.join(members, "element").groupBy("gene_set").agg(F.count("*").alias("n"), F.count("_hit").alias("r"))
    return sets.join(F.broadcast(marked.agg(F.count("*").alias("tn"), F.count("_hit").alias("tr"))))


def raise_zeros(t: DataFrame, value: str) -> DataFrame:
    """Zeros replaced by the smallest value above zero."""
    least = t.agg(F.min(F.when(F.col(value) > 0, F.col(value))).alias("_least"))
    return t.join(F.broadcast(least)).withColumn(value, F.when(F.col(value) == 0, F.coalesce("_least", value)).otherwise(F.col(value))).drop("_least")


def permuted(every: DataFrame, hit: DataFrame, members: DataFrame, rounds: int, seed: int = 42) -> DataFrame:
    """gene_set, n, r, z, p: the share of rounds in which a random list exactly as long as hit gives a set a z as far from 0.

    A round's list is the elements of the smallest hashes of (seed, round, element); members meet the last hash of each round's list, and
    a set that no list meets in a round has r = 0 there. Elements are unique."""
    own = over_representation(every, hit, members)
    sizes = set_counts(every, hit, members).select("gene_set", "n", "r", "tn", "tr")
    last = draws.limits(every.select("element"), F.col("element"), hit.agg(F.count("*").alias("_tr")), "_tr", rounds, seed)
    met = members.join(every.select("element"), "element").join(F.broadcast(last), draws.within(F.col("element"), seed)).groupBy("gene_set", "_round").agg(F.count("*").alias("_x"))
    tally = met.groupBy("gene_set", "_x").agg(F.count("*").alias("_rounds"))
    seen = tally.groupBy("gene_set").agg(F.sum("_rounds").alias("_seen"))
    zero = sizes.join(seen, "gene_set", "left").select("gene_set", F.lit(0).cast("long").alias("_x"), (F.lit(rounds) - F.coalesce("_seen", F.lit(0))).alias("_rounds"))
    n, x, tn = F.col("n"), F.col("_x"), F.col("tn")
    share = F.col("tr") / tn
    z = F.try_divide(x - n * share, F.sqrt(n * share * (1 - share) * (1 - (n - 1.0) / (tn - 1.0))))
    every_z = tally.unionByName(zero).join(sizes.drop("r"), "gene_set").withColumn("_z", z)
    far = own.join(every_z.select("gene_set", "_z", "_rounds"), "gene_set").groupBy("gene_set", own["n"], "r", "z")
    return far.agg((F.sum(F.when(F.abs("_z") >= F.abs("z") - 1e-9, F.col("_rounds")).otherwise(0)) / F.lit(float(rounds))).alias("p"))


def redundant(members: DataFrame, least: float) -> DataFrame:
    """(a, b, shared, contained): sets a of whose elements b holds at least that share."""
    m = members.distinct()
    sizes = m.groupBy(F.col("gene_set").alias("a")).agg(F.count("*").alias("_n"))
    met = m.select(F.col("gene_set").alias("a"), "element").join(m.select(F.col("gene_set").alias("b"), "element"), "element").where("a != b")
    shared = met.groupBy("a", "b").agg(F.count("*").alias("shared")).join(sizes, "a")
    return shared.withColumn("contained", F.col("shared") / F.col("_n")).where(F.col("contained") >= least).drop("_n")


def concordance(one: DataFrame, two: DataFrame) -> DataFrame:
    """(event, score) lists: shared events of one and of opposite direction, their share of the shorter list, and the share
    of equal directions, one half where fewer than ten are shared."""
    a, b = (t.where("score != 0").select("event", F.signum(F.col("score").cast("double")).alias(n)) for t, n in ((one, "_a"), (two, "_b")))
    c = a.join(b, "event", "full_outer").agg(F.count("_a").alias("na"), F.count("_b").alias("nb"), F.count_if(F.col("_a") == F.col("_b")).alias("same"), F.count_if(F.col("_a") != F.col("_b")).alias("opposite"))
    both = F.col("same") + F.col("opposite")
    return c.select("same", "opposite", F.try_divide(both, F.least("na", "nb")).alias("share"), F.when(both < 10, 0.5).otherwise(F.try_divide(F.col("same"), both)).alias("concordance"))


def inherited(members: DataFrame, closed: DataFrame) -> DataFrame:
    """(element, gene_set) with the members of a term's descendants as its own; closed is (child, ancestor)."""
    up = members.join(closed, F.col("gene_set") == F.col("child")).select("element", F.col("ancestor").alias("gene_set"))
    return members.select("element", "gene_set").unionByName(up).distinct()


def pruned(terms: DataFrame, closed: DataFrame, score: str) -> DataFrame:
    """terms (gene_set and score) without redundant ones: a term that scores no less than all its scored descendants stands for
    them, one that a descendant outdoes goes, and of those that stand only the ones below none that stands are kept."""
    own = terms.select("gene_set", F.col(score).alias("_s"))
    below = closed.join(own.withColumnRenamed("gene_set", "child"), "child").groupBy(F.col("ancestor").alias("gene_set")).agg(F.max("_s").alias("_best"))
    stands = own.join(below, "gene_set", "left").where(F.col("_best").isNull() | (F.col("_s") >= F.col("_best"))).select("gene_set")
    covered = closed.join(stands, F.col("ancestor") == F.col("gene_set")).select(F.col("child").alias("gene_set")).distinct()
    return terms.join(stands, "gene_set", "left_semi").join(covered, "gene_set", "left_anti")


def genes_of_terms(hit: DataFrame, members: DataFrame, terms: DataFrame) -> DataFrame:
    """(element, n, terms): the query's elements in any of the terms, how many those are, and their names in order."""
    return hit.join(members, "element").join(terms.select("gene_set"), "gene_set", "left_semi").groupBy("element").agg(F.countDistinct("gene_set").alias("n"), F.array_join(F.array_sort(F.collect_set("gene_set")), "|").alias("terms"))


def set_by_set(one: DataFrame, two: DataFrame, every: DataFrame) -> DataFrame:
    """(a, b, r, n, tr, tn, sensitivity, specificity, z): sets of samples one (name, sample) against sets two, in a universe of
    samples: common ones r, of b's n and a's tr. Pairs without a common sample have no row."""
    a, b = one.select(F.col("name").alias("a"), "sample").distinct(), two.select(F.col("name").alias("b"), "sample").distinct()
    tn = every.select("sample").distinct().agg(F.count("*").alias("tn"))
    r = a.join(b, "sample").groupBy("a", "b").agg(F.count("*").alias("r"))
    r = r.join(b.groupBy("b").agg(F.count("*").alias("n")), "b").join(a.groupBy("a").agg(F.count("*").alias("tr")), "a").join(F.broadcast(tn))
    share = F.col("tr") / F.col("tn")
    z = F.try_divide(F.col("r") - F.col("n") * share, F.sqrt(F.col("n") * share * (1 - share) * (1 - (F.col("n") - 1.0) / (F.col("tn") - 1.0))))
    rest = F.col("tn") - F.col("tr")
    return r.select("a", "b", "r", "n", "tr", "tn", (F.col("r") / F.col("tr")).alias("sensitivity"), F.try_divide(rest - F.col("n") + F.col("r"), rest).alias("specificity"), z.alias("z"))


def fixed_universe(sets: DataFrame, tn: int, least_z: float, more: int) -> DataFrame:
    """(gene_set, n, r, tr): z in a universe of a fixed size, of sets beyond that z with more than so many selected."""
    share = F.col("tr") / F.lit(float(tn))
    z = F.try_divide(F.col("r") - F.col("n") * share, F.sqrt(F.col("n") * share * (1 - share) * (1 - (F.col("n") - 1.0) / F.lit(tn - 1.0))))
    return sets.withColumn("z", z).where((F.col("z") > least_z) & (F.col("r") > more))


def coincident(m: DataFrame, pairs: DataFrame, over: float, least_z: float, more: int) -> DataFrame:
    """(feature, sample, grp, value) and pairs (a, b): the group in which samples with both features over a threshold are most
    frequent against all groups, where its z is above least_z and it has more than so many; ties to the smaller group."""
    high = m.where(F.col("value") > over).select("feature", "sample", "grp").distinct()
    both = pairs.join(high.select(F.col("feature").alias("a"), "sample", "grp"), "a").join(high.select(F.col("feature").alias("b"), "sample"), ["b", "sample"])
    r = both.groupBy("a", "b", "grp").agg(F.count("*").alias("r"))
    sizes = m.select("sample", "grp").distinct().groupBy("grp").agg(F.count("*").alias("n"))
    w = W.partitionBy("a", "b")
    s = r.join(F.broadcast(sizes), "grp").withColumn("tr", F.sum("r").over(w)).join(F.broadcast(sizes.agg(F.sum("n").alias("tn"))))
    share = F.col("tr") / F.col("tn")
    z = F.try_divide(F.col("r") - F.col("n") * share, F.sqrt(F.col("n") * share * (1 - share) * (1 - (F.col("n") - 1.0) / (F.col("tn") - 1.0))))
    s = s.withColumn("z", z).where((F.col("z") > least_z) & (F.col("r") > more))
    top = s.groupBy("a", "b").agg(F.min(F.struct((-F.col("z")).alias("d"), "grp", "r")).alias("x"))
    return top.select("a", "b", F.col("x.grp").alias("grp"), F.col("x.r").alias("r"), (-F.col("x.d")).alias("z"))


def best_terms(tests: DataFrame, group: str, term: str, p: str, within: float) -> DataFrame:
    """Each group's terms whose -log10 p is less than `within` below its best, and their places; ties by name."""
    score = -F.log10(F.greatest(F.col(p), F.lit(1e-300)))
    s = tests.withColumn("_s", score).withColumn("_top", F.max("_s").over(W.partitionBy(group))).where(F.col("_top") - F.col("_s") < within)
    return s.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(p, term))).drop("_s", "_top")
