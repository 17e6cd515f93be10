"""Statistics of paired values, distributions, tables and regressions: long tables in, one row a feature out.

A feature with too few rows has no row in the result; a statistic whose divisor is zero is null."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.functions import tails
from assaylake.operators import draws
from assaylake.operators.ranks import dealt
from assaylake.operators.stats import _two, anova_f, average_rank, correlation, mann_whitney_u, pooled_t, step_up, tie_share, welch
from assaylake.sources.kept import kept


def paired_t(pairs: DataFrame) -> DataFrame:
    """(feature, a, b): n, mean difference, t of the differences, and its two-sided p."""
    d = F.col("a") - F.col("b")
    s = pairs.groupBy("feature").agg(F.count(d).alias("n"), F.avg(d).alias("diff"), F.stddev_samp(d).alias("sd")).where("n > 1")
    s = s.select("feature", "n", "diff", F.when(F.col("sd") > 0, F.col("diff") / (F.col("sd") / F.sqrt("n"))).alias("t"))
    return s.withColumn("p", tails.t_two_sided(F.col("t"), F.col("n") - 1))


def signed_rank(pairs: DataFrame) -> DataFrame:
    """Wilcoxon's sums of the ranks of |a - b|, zeros left out, of rises and of falls; w is the smaller,
    z its distance from what chance gives, p the two-sided one."""
    d = pairs.select("feature", (F.col("a") - F.col("b")).alias("d")).where("d != 0").withColumn("m", F.abs("d"))
    r = average_rank(d, ["feature"], "m", "rk")
    s = r.groupBy("feature").agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rk")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("rk")).otherwise(0.0)).alias("down"))
    n = F.col("n").cast("double")
    s = s.withColumn("w", F.least("up", "down")).withColumn("z", F.abs(F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    return s.withColumn("p", tails.normal_two_sided(F.col("z")))


def sign_test(pairs: DataFrame) -> DataFrame:
    """z of the number of rises among the pairs that differ, and the two-sided p."""
    s = pairs.where("a != b").groupBy("feature").agg(F.count("*").alias("n"), F.count_if(F.col("a") > F.col("b")).alias("up"))
    s = s.select("feature", "n", "up", ((F.col("up") - F.col("n") / 2) / (F.sqrt("n") / 2)).alias("z"))
    return s.withColumn("p", tails.normal_two_sided(F.col("z")))


def rank_sums(m: DataFrame, one: str, two: str) -> DataFrame:
    """z of the first group's rank sum, with the variance of both group sizes, and the two-sided p."""
    r = average_rank(dealt(m.where(F.col("grp").isin(one, two)), ["feature"]), ["feature"], "value", "rk")
    s = r.groupBy("feature").agg(F.count_if(F.col("grp") == one).alias("n1"), F.count_if(F.col("grp") == two).alias("n2"), F.sum(F.when(F.col("grp") == one, F.col("rk"))).alias("r1")).where("n1 > 0 AND n2 > 0")
    n1, n2 = F.col("n1"), F.col("n2")
    s = s.select("feature", ((F.col("r1") - n1 * (n1 + n2 + 1) / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)).alias("z"))
    return s.withColumn("p", tails.normal_two_sided(F.col("z")))


def ks_two_sample(m: DataFrame, one: str, two: str) -> DataFrame:
    """The largest distance of the two groups' distribution functions, and its p by Kolmogorov's distribution. Values are counted before they are ordered."""
    c = m.where(F.col("grp").isin(one, two)).groupBy("feature", "value").agg(F.count_if(F.col("grp") == one).alias("c1"), F.count_if(F.col("grp") == two).alias("c2"))
    w, every = W.partitionBy("feature").orderBy("value"), W.partitionBy("feature")
    s = c.select("feature", F.sum("c1").over(w).alias("s1"), F.sum("c2").over(w).alias("s2"), F.sum("c1").over(every).alias("n1"), F.sum("c2").over(every).alias("n2"))
    s = s.where("n1 > 0 AND n2 > 0").groupBy("feature").agg(F.max(F.abs(F.col("s1") / F.col("n1") - F.col("s2") / F.col("n2"))).alias("d"), F.max(F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))).alias("en"))
    return s.select("feature", "d", tails.kolmogorov_tail((F.col("en") + 0.12 + F.lit(0.11) / F.col("en")) * F.col("d")).alias("p"))


def variance_ratio(m: DataFrame, one: str, two: str) -> DataFrame:
    """The ratio of the two groups' variances, and the chance of a larger one."""
    s = _two(m, one, two).where("v2 > 0").select("feature", "n1", "n2", (F.col("v1") / F.col("v2")).alias("f"))
    return s.select("feature", "f", tails.f_tail(F.col("f"), F.col("n1") - 1, F.col("n2") - 1).alias("p"))


def r_probability(r: Column, n: Column) -> Column:
    """The two-sided p of a correlation of n pairs; 0 for one of 1 or -1."""
    df = (n - 2).cast("double")
    rest = 1 - r * r
    return F.when(rest <= 0, 0.0).otherwise(tails.t_two_sided(r * F.sqrt(F.try_divide(df, rest)), df))


def pearson(xy: DataFrame) -> DataFrame:
    """(feature, x, y): Pearson's r and its two-sided p; both null where x or y doesn't vary."""
    s = xy.where("x IS NOT NULL AND y IS NOT NULL").groupBy("feature").agg(F.count("*").alias("n"), correlation("x", "y").alias("r"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy")).where("n > 2")
    s = s.withColumn("r", F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.greatest(F.least("r", F.lit(1.0)), F.lit(-1.0))))
    return s.select("feature", "r", r_probability(F.col("r"), F.col("n")).alias("p"))


def point_biserial(m: DataFrame, one: str, two: str) -> DataFrame:
    """The correlation of a value with being in the second group rather than the first, and its two-sided p."""
    g = m.where(F.col("grp").isin(one, two) & F.col("value").isNotNull()).select("feature", F.col("value").alias("x"), F.when(F.col("grp") == two, 1.0).otherwise(0.0).alias("y"))
    return pearson(g)


def friedman(blocks: DataFrame) -> DataFrame:
    """(feature, block, grp, value), one value of each group in a block: Friedman's chi-square of ranks within blocks, corrected
    for ties, and its p. Only blocks with all groups of the feature count."""
    k = blocks.groupBy("feature").agg(F.countDistinct("grp").alias("k"))
    own = blocks.where("value IS NOT NULL").withColumn("_n", F.count("*").over(W.partitionBy("feature", "block"))).join(k, "feature").where("_n = k AND k > 1")
    r = average_rank(own, ["feature", "block"], "value", "rk").withColumn("_tie", tie_share("rk", "value", ["feature", "block"]))
    g = r.groupBy("feature", "grp", "k").agg(F.count("*").alias("n"), F.sum("rk").alias("rs"), F.sum("_tie").alias("tie"))
    s = g.groupBy("feature", "k").agg(F.max("n").cast("double").alias("n"), F.sum(F.col("rs") * F.col("rs")).alias("s"), F.sum("tie").alias("tie"))
    k, n = F.col("k").cast("double"), F.col("n")
    share = 1 - F.col("tie") / (n * (k * k * k - k))
    s = s.withColumn("chi2", F.when(share > 0, (F.lit(12.0) / (n * k * (k + 1)) * F.col("s") - 3 * n * (k + 1)) / share).otherwise(0.0))
    return s.select("feature", F.greatest("chi2", F.lit(0.0)).alias("chi2"), tails.chi_square_tail(F.greatest("chi2", F.lit(0.0)), k - 1).alias("p"))


def cochran_q(blocks: DataFrame) -> DataFrame:
    """(feature, block, grp, value of 0 or 1): Cochran's Q of the groups' shares, and its p. Only blocks with all groups of the
    feature count."""
    k = blocks.groupBy("feature").agg(F.countDistinct("grp").alias("k"))
    own = blocks.where("value IS NOT NULL").withColumn("_n", F.count("*").over(W.partitionBy("feature", "block"))).join(k, "feature").where("_n = k AND k > 1")
    row = F.sum("value").over(W.partitionBy("feature", "block"))
    g = own.withColumn("_row", row.cast("double")).groupBy("feature", "grp", "k").agg(F.sum("value").cast("double").alias("c"), F.sum(F.col("_row") * F.col("_row") / F.col("k")).alias("r2"))
    s = g.groupBy("feature", "k").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("c2"), F.sum("r2").alias("r2"))
    k = F.col("k").cast("double")
    q = F.try_divide((k - 1) * (k * F.col("c2") - F.col("t") * F.col("t")), k * F.col("t") - F.col("r2"))
    return s.withColumn("q", q).select("feature", "q", tails.chi_square_tail(F.col("q"), k - 1).alias("p"))


def one_sample_t(m: DataFrame, mean: float) -> DataFrame:
    """t of a feature's mean against a given one, and the two-sided p; and the chi-square of its variance against 1."""
    s = m.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd")).where("n > 1")
    t = F.when(F.col("sd") > 0, (F.col("m") - mean) / (F.col("sd") / F.sqrt("n")))
    s = s.select("feature", "n", t.alias("t"), ((F.col("n") - 1) * F.col("sd") * F.col("sd")).alias("variance_chi2"))
    return s.withColumn("p", tails.t_two_sided(F.col("t"), F.col("n") - 1))


def spearman(xy: DataFrame) -> DataFrame:
    """(feature, x, y): Pearson's r of the average ranks, and its two-sided p."""
    r = average_rank(average_rank(dealt(xy, ["feature"]), ["feature"], "x", "rx"), ["feature"], "y", "ry")
    r = r.groupBy("feature").agg(F.count("*").alias("n"), correlation("rx", "ry").alias("rho")).where("n > 2").withColumn("rho", F.nanvl("rho", F.lit(None).cast("double")))
    return r.select("feature", "rho", r_probability(F.when(F.col("rho").isNotNull(), F.greatest(F.least("rho", F.lit(1.0)), F.lit(-1.0))), F.col("n")).alias("p"))


def kendall_tau(xy: DataFrame) -> DataFrame:
    """tau-b, its z and two-sided p, from the cells of equal (x, y): rows are counted into cells first, so the pairs met are pairs of cells."""
    c = xy.where("x IS NOT NULL AND y IS NOT NULL").groupBy("feature", "x", "y").agg(F.count("*").cast("double").alias("c"))
    o = c.select("feature", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("c").alias("c2"))
    both = F.col("c") * F.col("c2")
    s = c.join(o, "feature").groupBy("feature").agg(
        F.sum(both * F.signum((F.col("x") - F.col("x2")).cast("double")) * F.signum((F.col("y") - F.col("y2")).cast("double"))).alias("s"),
        F.sum(F.when(F.col("x") != F.col("x2"), both).otherwise(0.0)).alias("dx"),
        F.sum(F.when(F.col("y") != F.col("y2"), both).otherwise(0.0)).alias("dy"), F.sum(both).alias("nn"),
    )
    n = F.sqrt("nn")
    s = s.select("feature", F.when((F.col("dx") > 0) & (F.col("dy") > 0), F.col("s") / F.sqrt(F.col("dx") * F.col("dy"))).alias("tau"), n.alias("n"))
    s = s.withColumn("z", F.col("tau") / F.sqrt((4 * F.col("n") + 10) / (9 * F.col("n") * (F.col("n") - 1))))
    return s.select("feature", "tau", "z", tails.normal_two_sided(F.col("z")).alias("p"))


def chi_square(x: DataFrame, row: str, col: str) -> DataFrame:
    """(feature, row, col): the statistic of independence, its degrees of freedom, and p."""
    c = x.groupBy("feature", row, col).agg(F.count("*").cast("double").alias("c"))
    f = W.partitionBy("feature")
    c = c.select("feature", row, col, "c", F.sum("c").over(f).alias("n"), F.sum("c").over(W.partitionBy("feature", row)).alias("r"), F.sum("c").over(W.partitionBy("feature", col)).alias("k"))
    s = c.groupBy("feature").agg((F.first("n") * (F.sum(F.col("c") * F.col("c") / (F.col("r") * F.col("k"))) - 1)).alias("chi2"), ((F.countDistinct(row) - 1) * (F.countDistinct(col) - 1)).alias("df"))
    return s.select("feature", "chi2", "df", tails.chi_square_tail(F.greatest("chi2", F.lit(0.0)), F.col("df")).alias("p"))


def ln_choose(n: Column, k: Column) -> Column:
    return tails.ln_gamma(n + 1.0) - tails.ln_gamma(k + 1.0) - tails.ln_gamma(n - k + 1.0)


#: Counts of a tail that are summed at once.
STRETCH = 512


def _ln_chance(k: np.ndarray, n: np.ndarray, tr: np.ndarray, tn: np.ndarray) -> np.ndarray:
    choose = lambda a, b: tails._lgamma(a + 1) - tails._lgamma(b + 1) - tails._lgamma(a - b + 1)
    return choose(tr, k) + choose(tn - tr, n - k) - choose(tn, n)


def _as_unlikely(r: float, n: float, tr: float, tn: float) -> float:
    """The sum of the chances that are no larger than r's. Chances rise to their mode and fall behind it: the counts as unlikely on the
    other side of it begin where bisection finds them, and both tails are summed outwards until nothing changes."""
    lo, hi = max(0.0, n + tr - tn), min(n, tr)
    chance = lambda k: _ln_chance(np.asarray(k, dtype=float), n, tr, tn)
    most = float(chance(r)) + 1e-7
    mode = min(max(float(np.floor((n + 1) * (tr + 1) / (tn + 2))), lo), hi)
    if float(chance(mode)) <= most:
        return 1.0

    def tail(edge: float) -> float:
        """From the last count towards the mode that is as unlikely to the edge; 0 if the edge is likelier."""
        if float(chance(edge)) > most:
            return 0.0
        far, near = edge, mode
        while abs(near - far) > 1:
            mid = float(np.floor((far + near) / 2))
            far, near = (mid, near) if float(chance(mid)) <= most else (far, mid)
        step, total = np.sign(edge - mode), 0.0
        for at in np.arange(far, edge + step, step * STRETCH):
            k = at + step * np.arange(min(STRETCH, abs(edge - at) + 1))
            more = float(np.exp(chance(k)).sum())
            if total + more == total:
                break
            total += more
        return total

    return min(tail(lo) + tail(hi), 1.0)


def fisher_two_sided(t: DataFrame) -> DataFrame:
    """(r, n, tr, tn), all counts: t with p, the chance of a table as unlikely as r of a set's n among tr of tn. A row takes time by the width of
    its distribution, not by its counts, and no list of them."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series, tr: pd.Series, tn: pd.Series) -> pd.Series:
        return pd.Series([np.nan if any(map(pd.isna, x)) else _as_unlikely(*x) for x in zip(*(c.astype(float) for c in (r, n, tr, tn)), strict=True)])

    return t.withColumn("p", F.nanvl(p("r", "n", "tr", "tn"), F.lit(None).cast("double")))


def regression(xy: DataFrame) -> DataFrame:
    """Least squares of y on x with r squared, and the slope through the origin."""
    x, y = F.col("x"), F.col("y")
    s = xy.where("x IS NOT NULL AND y IS NOT NULL").groupBy("feature").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.try_divide(F.sum(x * y), F.sum(x * x)).alias("origin_slope"))
    return s.where("n > 2")


def step_up_by(p: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """Benjamini-Hochberg inside each comparison; a missing p counts as 1."""
    filled = p.withColumn(value, F.coalesce(value, F.lit(1.0)))
    ranked = filled.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(value, key))).withColumn("_n", F.count("*").over(W.partitionBy(by)))
    q = F.min(F.least(F.col(value) * F.col("_n") / F.col("_k"), F.lit(1.0))).over(W.partitionBy(by).orderBy(F.desc("_k")))
    return ranked.withColumn("q", q).drop("_k", "_n")


def storey_pi0(p: DataFrame, value: str) -> float:
    """The share of true nulls: a cubic spline through the shares of p above each point of the grid 0 to 0.89, read at the last
    point. A spline goes through its points, so that is the share there. Fewer than 100 values: 1."""
    last = 0.89
    row = p.where(F.col(value).isNotNull()).agg(F.count("*").alias("m"), F.count_if(F.col(value) > last).alias("above")).first()
    if row["m"] < 100:
        return 1.0
    return float(min(max(row["above"] / (row["m"] * (1 - last)), 1e-8), 1.0))


def q_values(p: DataFrame, key: str, value: str) -> DataFrame:
    """Storey's q: Benjamini-Hochberg times the share of true nulls."""
    pi0 = storey_pi0(p, value)
    return step_up(p, key, value).withColumn("q", F.col("q") * pi0)


def moderated_t(m: DataFrame, one: str, two: str) -> DataFrame:
    """Student's t with variances shrunk to a common prior. The prior's two numbers come from one aggregation over the
    features' log variances, adjusted for their degrees of freedom; the statistic is an expression."""
    s = _two(m, one, two).withColumn("df", (F.col("n1") + F.col("n2") - 2).cast("double"))
    s = s.withColumn("s2", ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / F.col("df"))
    found = prior(s, "s2", "df")
    log_fold = F.col("m1") - F.col("m2")
    if found is None:
        mean = s.agg(F.avg(F.when(F.col("s2") > 0, F.ln("s2") - tails.digamma(F.col("df") / 2) + F.ln(F.col("df") / 2)))).first()[0]
        shrunk, df = F.lit(float(np.exp(mean or 0.0))), F.lit(1e10)
    else:
        s0, d0 = found
        shrunk, df = (F.lit(d0 * s0) + F.col("df") * F.col("s2")) / (F.lit(d0) + F.col("df")), F.col("df") + F.lit(d0)
    t = F.try_divide(log_fold, F.sqrt(shrunk * (1 / F.col("n1") + 1 / F.col("n2"))))
    out = s.select("feature", log_fold.alias("log_fold"), t.alias("t"), df.alias("df"))
    return out.withColumn("p", tails.t_two_sided(F.col("t"), F.col("df")))


#: Tests of two groups by name; each gives a p for a feature.
TESTS = {
    "unpaired t-test": lambda m, one, two: pooled_t(m, one, two),
    "Welch": lambda m, one, two: welch(m, one, two),
    "moderated t-test": lambda m, one, two: moderated_t(m, one, two),
    "moderated Welch": lambda m, one, two: moderated_welch(m, one, two),
    "Mann Whitney": lambda m, one, two: mann_whitney_u(m, one, two),
    "Rank Sums": lambda m, one, two: rank_sums(m, one, two),
    "Kolmogorov Smirnov": lambda m, one, two: ks_two_sample(m, one, two),
}


def compare(m: DataFrame, one: str, two: str, test: str) -> DataFrame:
    """(feature, p) by the named test, for every feature with a value in both groups; p is 1 where a group has a single value or the
    test gives none."""
    if test not in TESTS:
        raise ValueError(f"no such test: {test}")
    have = lambda g: F.count(F.when(F.col("grp") == g, F.col("value")))
    sizes = m.groupBy("feature").agg(F.least(have(one), have(two)).alias("_n")).where("_n > 0")
    p = TESTS[test](m, one, two).select("feature", "p")
    return sizes.join(p, "feature", "left").select("feature", F.when(F.col("_n") > 1, F.coalesce("p", F.lit(1.0))).otherwise(1.0).alias("p"))


def prior(s: DataFrame, variance: str, df: str) -> tuple[float, float] | None:
    """The common variance and its degrees of freedom that features' variances are shrunk to; None if they show no spread. One
    aggregation over the features' log variances, adjusted for their degrees of freedom."""
    h = F.col(df) / 2
    e = F.when(F.col(variance) > 0, F.ln(variance) - tails.digamma(h) + F.ln(h))
    row = s.agg(F.avg(e).alias("mean"), F.var_samp(e).alias("var"), F.avg(F.when(F.col(variance) > 0, tails.trigamma(h))).alias("noise")).first()
    spread = (row["var"] or 0.0) - (row["noise"] or 0.0)
    if row["mean"] is None or spread <= 0:
        return None
    d0 = 2 * tails.trigamma_inverse(spread)
    return float(np.exp(row["mean"] + tails.digamma_of(d0 / 2) - np.log(d0 / 2))), d0


def moderated_welch(m: DataFrame, one: str, two: str) -> DataFrame:
    """Welch's t with both groups' variances of the mean shrunk to a common prior."""
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    df = F.try_divide((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    s = _two(m, one, two).withColumns({"a": a, "b": b, "df": F.coalesce(df, F.lit(1.0))}).withColumn("s2", F.col("a") + F.col("b"))
    found = prior(s, "s2", "df")
    s0, d0 = found or (0.0, 0.0)
    shrunk = lambda c: (F.lit(d0 * s0) + F.col("df") * F.col(c)) / (F.lit(d0) + F.col("df"))
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(shrunk("a") + shrunk("b")))
    return s.select("feature", t.alias("t"), "df").withColumn("p", tails.t_two_sided(F.col("t"), F.col("df")))


def pairwise_groups(m: DataFrame, least: float, most_p: float) -> DataFrame:
    """(feature, driver, hits): features whose groups differ (one-way p below most_p), with the group in most pairs that differ
    by least in their means and have a t-test's p below most_p; ties to the smaller name."""
    g = m.groupBy("feature", "grp").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")).where("n > 1")
    a, b = (g.select("feature", *[F.col(c).alias(f"{c}{i}") for c in ("grp", "n", "m", "v")]) for i in (1, 2))
    pairs = a.join(b, "feature").where("grp1 < grp2")  # a feature's groups, not its values
    df = (F.col("n1") + F.col("n2") - 2).cast("double")
    se = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / df * (1 / F.col("n1") + 1 / F.col("n2")))
    t = F.when(se > 0, (F.col("m1") - F.col("m2")) / se)
    far = pairs.where(F.abs(F.col("m1") - F.col("m2")) > least).withColumn("_p", tails.t_two_sided(t, df)).where(F.col("_p") < most_p)
    hits = far.select("feature", F.explode(F.array("grp1", "grp2")).alias("grp")).groupBy("feature", "grp").agg(F.count("*").alias("hits"))
    top = hits.groupBy("feature").agg(F.min(F.struct((-F.col("hits")).alias("d"), "grp")).alias("x"))
    whole = anova_f(m).where(F.col("p") < most_p).select("feature", "p")
    return whole.join(top, "feature").select("feature", "p", F.col("x.grp").alias("driver"), (-F.col("x.d")).alias("hits"))


def best_part(m: DataFrame, parts: DataFrame, most_p: float) -> DataFrame:
    """(gene, f, feature): of each gene's parts whose groups differ with a p below most_p, the one of the largest F; ties to the
    smaller."""
    f = anova_f(m).where((F.col("p") < most_p) & F.col("f").isNotNull()).join(parts, "feature")
    return f.groupBy("gene").agg(F.min(F.struct((-F.col("f")).alias("d"), "feature")).alias("x")).select("gene", (-F.col("x.d")).alias("f"), F.col("x.feature").alias("feature"))


def bayes_factor(draws: DataFrame, smoothing: float = 0.3, least: float = 0.009, most: float = 1e12) -> DataFrame:
    """(feature, one, two) posterior draws: the prior density of no difference, 1, over the posterior's at 0, by a Gaussian kernel
    of smoothing times the standard deviation; 0 where the mean absolute difference is least or less, or all are equal."""
    d = F.col("one") - F.col("two")
    x = draws.select("feature", d.alias("d"))
    s = x.groupBy("feature").agg(F.count("*").alias("n"), F.avg(F.abs("d")).alias("_a"), F.stddev_samp("d").alias("_sd"))
    h = F.col("_sd") * smoothing
    k = x.join(s, "feature").groupBy("feature").agg(F.max("_a").alias("_a"), F.max("_sd").alias("_sd"), F.avg(F.when(F.col("_sd") > 0, F.exp(-F.col("d") * F.col("d") / (2 * h * h)) / (h * (2 * np.pi) ** 0.5))).alias("density"))
    flat = (F.col("_a") <= least) | F.col("_sd").isNull() | (F.col("_sd") == 0)
    return k.select("feature", F.when(flat, 0.0).otherwise(F.least(F.coalesce(F.try_divide(F.lit(1.0), F.col("density")), F.lit(most)), F.lit(most))).alias("bayes_factor"))


#: Values of a feature up to which one row holds them, and numbers that its rounds make at once.
WHOLE, AT_ONCE = 4096, 1 << 20


def label_permutation(m: DataFrame, one: str, two: str, rounds: int, seed: int = 42, whole: int = WHOLE) -> DataFrame:
    """(feature, diff, p): the share of rounds in which as many values drawn at random for the first group give a difference of
    means as far from 0. A round's draw is the smallest hashes of (seed, round, feature, row).

    A feature of whole values or fewer is one row, and its rounds are gone through where it is, so that nothing is shuffled for a round.
    Larger ones are counted and summed by parts of the hashes' range (draws.sums), so a feature may have any number of values; both draw
    the same."""
    own = kept(m.where(F.col("grp").isin(one, two) & F.col("value").isNotNull()).select("feature", "grp", F.col("value").cast("double").alias("value")).withColumn("_i", F.monotonically_increasing_id()))
    first = F.col("grp") == one
    size = own.groupBy("feature").agg(F.count_if(first).alias("_n1"), F.count("*").alias("_n"), F.sum("value").alias("_all"), F.sum(F.when(first, F.col("value"))).alias("_one")).where("_n1 > 0 AND _n > _n1")
    size = kept(size)
    small, large = size.where(F.col("_n") <= whole), size.where(F.col("_n") > whole)
    sums = _drawn_sums(own.join(small, "feature"), rounds, seed)
    if not large.isEmpty():
        rows = own.join(large.select("feature"), "feature")
        far = draws.sums(rows, ["feature"], F.col("_i"), large, "_n1", "value", rounds, seed).join(large, "feature")
        sums = sums.unionByName(far.groupBy("feature", "_n1", "_n", "_all", "_one").agg(F.collect_list("_sum").alias("_sums")))
    away = lambda s: s / F.col("_n1") - (F.col("_all") - s) / (F.col("_n") - F.col("_n1"))
    beyond = F.size(F.filter("_sums", lambda s: F.abs(away(s)) >= F.abs(F.col("diff")) - 1e-12))
    return sums.withColumn("diff", away(F.col("_one"))).select("feature", "diff", (beyond / F.lit(float(rounds))).alias("p"))


def _drawn_sums(rows: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(feature, _n1, _n, _all, _one, _sums): the sum of what each round draws of a feature's rows (_i, value), which are gathered."""
    names = ["feature", "_n1", "_n", "_all", "_one"]
    seeds = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.xxhash64(F.lit(seed), r, "feature"))
    gathered = rows.groupBy(*names).agg(F.collect_list("_i").alias("_keys"), F.collect_list("value").alias("_values")).withColumn("_seeds", seeds)

    def summed(it):
        for batch in it:
            columns = [batch.column(c) for c in ("_n1", "_keys", "_values", "_seeds")]
            out = []
            for i in range(len(batch)):
                n, keys, values, turns = columns[0][i].as_py(), *(c[i].values.to_numpy(zero_copy_only=False) for c in columns[1:])
                step = max(1, AT_ONCE // len(keys))
                own = []
                for a in range(0, len(turns), step):
                    h = draws.hashes(keys, turns[a : a + step])
                    own.append((h <= np.partition(h, n - 1, axis=1)[:, n - 1 : n]) @ values)
                out.append(np.concatenate(own))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.list_(pa.float64()))], [*names, "_sums"])

    kinds = dict(gathered.dtypes)
    return gathered.mapInArrow(summed, ", ".join(f"{c} {kinds[c]}" for c in names) + ", _sums array<double>")
