"""Profiles: marker templates, centroids, nearest profiles, agreement of labels, cell calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.operators.ranks import running_total
from assaylake.operators.stats import correlation


def template_rho(m: DataFrame) -> DataFrame:
    """(feature, grp, rho): Pearson's r of a feature's values with each group's 0/1 template, from the groups' sums."""
    v = F.col("value")
    g = m.groupBy("feature", "grp").agg(F.count(v).alias("c"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    w = W.partitionBy("feature")
    g = g.select("feature", "grp", "c", "s", F.sum("c").over(w).alias("n"), F.sum("s").over(w).alias("t"), F.sum("q").over(w).alias("q"))
    mean, p = F.col("t") / F.col("n"), F.col("c") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    rho = (F.col("s") / F.col("c") - mean) / sd * F.sqrt(p / (1 - p))
    return g.where("c < n").select("feature", "grp", F.when(sd > 1e-9, rho).alias("rho"))


def top_markers(rhos: DataFrame, n: int, least: float) -> DataFrame:
    """Each group's n features of the largest rho over least; ties by feature."""
    k = F.row_number().over(W.partitionBy("grp").orderBy(F.desc("rho"), "feature"))
    return rhos.where(F.col("rho") > least).withColumn("place", k).where(F.col("place") <= n)


def consolidated_markers(cells: DataFrame, groupings: DataFrame, n: int, least: float) -> DataFrame:
    """(grouping, direction, grp, feature, rho, place, kept): the n best markers, up and down, of each group of every grouping.

    cells are (feature, sample, value), groupings (grouping, sample, grp): all groupings are one aggregation, a feature's
    sums by group. rho is the correlation with the group's 0/1 template, its sign turned for down, and over least, to six places; ties by
    feature. A feature that marks several groups is kept where its rho is largest (ties: by grouping, direction, group)."""
    v = F.col("value").cast("double")
    g = cells.where("value is not null").join(groupings, "sample").groupBy("grouping", "feature", "grp").agg(F.count("*").alias("c"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    w = W.partitionBy("grouping", "feature")
    g = g.select("grouping", "feature", "grp", "c", "s", F.sum("c").over(w).alias("n"), F.sum("s").over(w).alias("t"), F.sum("q").over(w).alias("q"))
    mean, p = F.col("t") / F.col("n"), F.col("c") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    rho = F.round((F.col("s") / F.col("c") - mean) / sd * F.sqrt(p / (1 - p)), 6)
    both = F.explode(F.array(F.struct(F.lit("up").alias("direction"), F.col("r").alias("rho")), F.struct(F.lit("down").alias("direction"), (-F.col("r")).alias("rho"))))
    x = g.where("c < n").where(sd > 1e-9).select("grouping", "feature", "grp", rho.alias("r")).select("grouping", "grp", "feature", both.alias("x")).select("grouping", "x.direction", "grp", "feature", "x.rho").where(F.col("rho") > least)
    place = F.row_number().over(W.partitionBy("grouping", "direction", "grp").orderBy(F.desc("rho"), "feature"))
    first = F.row_number().over(W.partitionBy("feature").orderBy(F.desc("rho"), "grouping", "direction", "grp"))
    return x.withColumn("place", place).where(F.col("place") <= n).withColumn("kept", first == 1)


def _pearson(x: Column, y: Column) -> Column:
    n = F.size(x).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    product = lambda a, b: total(F.zip_with(a, b, lambda u, v: u * v))
    sx, sy = total(x), total(y)
    below = F.sqrt((product(x, x) - sx * sx / n) * (product(y, y) - sy * sy / n))
    return F.try_divide(product(x, y) - sx * sy / n, below)


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): means by coordinate."""
    x = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return x.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid"))


def nearest_profile(vectors: DataFrame, profiles: DataFrame, key: str, vector: str, label: str, least: float = -1.0, most: int = 4096) -> DataFrame:
    """key with the label of the best correlated profile and its r, of r least or more; ties to the smaller label.

    A profile is one row for each label. They are counted first, and only as many as `most` are sent to every task; more of
    them meet the vectors in a plain join, whose strategy is the optimizer's."""
    few = profiles.count() <= most
    other = profiles.select(F.col(label).alias("best"), "centroid")
    met = vectors.select(key, F.transform(vector, lambda v: v.cast("double")).alias("_v")).crossJoin(F.broadcast(other) if few else other)
    scored = met.where(F.size("_v") == F.size("centroid")).select(key, "best", F.round(_pearson(F.col("_v"), F.col("centroid")), 6).alias("r")).where(F.col("r") >= least)
    first = scored.groupBy(key).agg(F.min(F.struct((-F.col("r")).alias("d"), "best")).alias("m"))
    return first.select(key, F.col("m.best").alias("best"), (-F.col("m.d")).alias("r"))


def adjusted_rand(rows: DataFrame, one: str, two: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings, from their contingency counts."""
    c = rows.groupBy(F.col(one).alias("a"), F.col(two).alias("b")).agg(F.count("*").cast("double").alias("c"))
    pairs = lambda x: x * (x - 1) / 2
    both = c.agg(F.sum(pairs(F.col("c"))).alias("s"), F.sum("c").alias("n"))
    side = lambda k, name: c.groupBy(k).agg(F.sum("c").alias("c")).agg(F.sum(pairs(F.col("c"))).alias(name))
    t = both.join(F.broadcast(side("a", "sa"))).join(F.broadcast(side("b", "sb")))
    expected = F.col("sa") * F.col("sb") / pairs(F.col("n"))
    return t.select(F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected).alias("ari"))


def demultiplex(x: DataFrame, unit: str, tag: str, count: str, singlet: float = 0.6, multiplet: float = 0.33) -> DataFrame:
    """The tag of a unit whose share of its counts is over singlet; 'multiplet' where two tags or more are over multiplet;
    else 'none'."""
    share = F.col(count) / F.sum(count).over(W.partitionBy(unit))
    s = x.groupBy(unit, tag).agg(F.sum(count).alias(count)).withColumn("_s", share)
    g = s.groupBy(unit).agg(F.max(F.struct("_s", tag)).alias("_m"), F.count_if(F.col("_s") > multiplet).alias("_n"))
    return g.select(unit, F.when(F.col("_n") >= 2, "multiplet").when(F.col("_m._s") > singlet, F.col(f"_m.{tag}")).otherwise("none").alias("call"))


def demultiplex_scaled(x: DataFrame, unit: str, tag: str, count: str) -> DataFrame:
    """demultiplex() of counts scaled by tag to 10,000 (multiplets over 0.3); multiplets of the unscaled counts stay."""
    s = x.groupBy(unit, tag).agg(F.sum(count).cast("double").alias(count))
    scaled = s.withColumn(count, F.when(F.col(count) == 0, 0.0).otherwise(F.log2(F.col(count) * 10000.0 / F.sum(count).over(W.partitionBy(tag)) + 1)))
    first = demultiplex(s, unit, tag, count).withColumnRenamed("call", "_first")
    both = first.join(demultiplex(scaled, unit, tag, count, 0.6, 0.3), unit)
    return both.select(unit, F.when(F.col("_first") == "multiplet", "multiplet").otherwise(F.col("call")).alias("call"))


def single_guide(x: DataFrame, unit: str, tag: str, count: str, total: int = 20, share: float = 0.3) -> DataFrame:
    """The one tag over the share, for units of more than total counts with exactly one such tag."""
    s = x.groupBy(unit, tag).agg(F.sum(count).alias("_c")).withColumn("_all", F.sum("_c").over(W.partitionBy(unit)))
    over = F.col("_c") / F.col("_all") > share
    g = s.where(F.col("_all") > total).groupBy(unit).agg(F.count_if(over).alias("_n"), F.max(F.when(over, F.col(tag))).alias("call"))
    return g.where("_n = 1").select(unit, "call")


def contrast_call(m: DataFrame, group: str, plus: str, minus: str) -> DataFrame:
    """The sign of the mean of one group's features less that of another's: its name, or 'unknown' at zero or if one lacks."""
    mean = lambda g: F.avg(F.when(F.col(group) == g, F.col("value")))
    s = m.groupBy("sample").agg((mean(plus) - mean(minus)).alias("diff"))
    return s.select("sample", "diff", F.when(F.col("diff") > 0, plus).when(F.col("diff") < 0, minus).otherwise("unknown").alias("call"))


def state_frequency(m: DataFrame, over: float) -> DataFrame:
    """(feature, grp, freq): the share of a group's values over the threshold."""
    return m.groupBy("feature", "grp").agg(F.avg(F.when(F.col("value") > over, 1.0).otherwise(0.0)).alias("freq"))


def profile_z(rhos: DataFrame, sample: str, rho: str, top: int = 2) -> DataFrame:
    """rhos with z: less the mean and over the deviation of each sample's `top` largest, of all samples together."""
    k = F.row_number().over(W.partitionBy(sample).orderBy(F.desc(rho)))
    best = rhos.withColumn("_k", k).where(F.col("_k") <= top).agg(F.avg(rho).alias("_m"), F.stddev_samp(rho).alias("_sd"))
    return rhos.join(F.broadcast(best)).withColumn("z", F.try_divide(F.col(rho) - F.col("_m"), F.col("_sd"))).drop("_m", "_sd")


def profile_rhos(vectors: DataFrame, profiles: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, r) of every vector with every profile of as many numbers. Vectors are exploded to coordinates and meet the
    profiles' coordinates; sums of products are what is shuffled."""
    x = vectors.select(key, F.size(vector).alias("_n"), F.posexplode(vector).alias("_i", "_x"))
    y = profiles.select(label, F.size("centroid").alias("_n"), F.posexplode("centroid").alias("_i", "_y"))
    return x.join(F.broadcast(y) if profiles.count() <= 4096 else y, ["_n", "_i"]).groupBy(key, label).agg(correlation(F.col("_x").cast("double"), F.col("_y").cast("double")).alias("r"))


def like_profiles(profiles: DataFrame, label: str, over: float) -> DataFrame:
    """(a, b, r), a < b: pairs of profiles that correlate above a bound. Profiles are few: one for each cluster."""
    y = profiles.select(label, F.posexplode("centroid").alias("_i", "_y"))
    a, b = y.select(F.col(label).alias("a"), "_i", F.col("_y").alias("_a")), y.select(F.col(label).alias("b"), "_i", F.col("_y").alias("_b"))
    return a.join(b, "_i").where("a < b").groupBy("a", "b").agg(correlation("_a", "_b").alias("r")).where(F.col("r") > over)


def row_blocks(m: DataFrame, order: str, rho: float, same: float) -> DataFrame:
    """(order, sample, value): blocks of rows that follow each other: a row that correlates with the one before it above rho is
    in its block, any other begins one; a row above `same` is dropped. Rows are numbered from 1 without gaps."""
    before = m.select((F.col(order) + 1).alias(order), "sample", F.col("value").alias("_v"))
    r = m.join(before, [order, "sample"]).groupBy(order).agg(correlation("value", "_v").alias("_r"))
    rows = m.select(order).distinct().join(r, order, "left").withColumn("_r", F.coalesce(F.nanvl("_r", F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("_new", F.when(F.col("_r") > rho, 0).otherwise(1))
    return running_total(rows, [order], "_new", "block").where(F.col("_r") <= same).select(order, "block", F.col("_r").alias("r"))


def depleted(m: DataFrame, signatures: DataFrame, most: float) -> DataFrame:
    """Features of (feature, sample, value) whose |r| with the mean profile of every signature (name, feature) is below most; one
    without an r counts as 0. Mean profiles are few and go
    to the features, which are dealt out once, so that no row of feature, signature and sample is."""
    means = m.join(signatures, "feature").groupBy("name", "sample").agg(F.avg("value").alias("_y"))
    r = m.repartition("feature").join(F.broadcast(means), "sample").groupBy("feature", "name").agg(correlation("value", "_y").alias("r"))
    return r.groupBy("feature").agg(F.max(F.abs(F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)))).alias("closest")).where(F.col("closest") < most)


def best_regulator(events: DataFrame, regulators: DataFrame, over: float, more: int) -> DataFrame:
    """(feature, regulator, r): of the regulators (few) the one of the largest |r| with an event over the samples that both have,
    0 where these are not more than so many, if |r| is over a bound; ties to the smaller. The r is rounded, so that ties are ties.
    Regulators go to the events, which are dealt out once."""
    y = regulators.select(F.col("feature").alias("regulator"), "sample", F.col("value").alias("_y"))
    r = events.where("value IS NOT NULL").repartition("feature").join(F.broadcast(y.where("_y IS NOT NULL")), "sample").groupBy("feature", "regulator").agg(F.count("*").alias("_n"), correlation("value", "_y").alias("_r"))
    r = r.withColumn("r", F.round(F.when(F.col("_n") > more, F.coalesce(F.nanvl("_r", F.lit(0.0)), F.lit(0.0))).otherwise(0.0), 6)).where(F.abs("r") > over)
    top = r.groupBy("feature").agg(F.min(F.struct((-F.abs("r")).alias("d"), "regulator", "r")).alias("x"))
    return top.select("feature", F.col("x.regulator").alias("regulator"), F.col("x.r").alias("r"))


def own_and_other(scores: DataFrame, sample: str, grp: str, state: str, score: str, times: float = 1.0) -> DataFrame:
    """(sample, grp, state, score): samples whose own state's score stands out from the best other one as much as half of their
    group's do: singlet where 2**(own - other) is above both times its value at the group's medians and times."""
    own = F.max(F.when(F.col(state) == F.col(grp), F.col(score)))
    other = F.max(F.when(F.col(state) != F.col(grp), F.col(score)))
    s = scores.groupBy(sample, grp).agg(own.alias("own"), other.alias("other")).where("own IS NOT NULL AND other IS NOT NULL")
    w = W.partitionBy(grp)
    two = F.lit(2.0)
    bound = F.pow(two, F.median("own").over(w) - F.median("other").over(w)) * times
    far = F.pow(two, F.col("own") - F.col("other"))
    return s.withColumn("singlet", (far > bound) & (far > times))
