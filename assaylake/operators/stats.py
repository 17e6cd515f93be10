"""Tests on long tables (feature, grp, value), multiple testing, ranks and correlation. One aggregation each where possible."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.functions import tails
from assaylake.operators.ranks import dealt, global_rank, least_from_here
from assaylake.sources.kept import kept


def _two(m: DataFrame, one: str, two: str) -> DataFrame:
    cols = []
    for i, g in ((1, one), (2, two)):
        v = F.when(F.col("grp") == g, F.col("value"))
        cols += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.var_samp(v).alias(f"v{i}")]
    return m.where(F.col("grp").isin(one, two)).groupBy("feature").agg(*cols).where("n1 > 1 AND n2 > 1")


def pooled_t(m: DataFrame, one: str, two: str) -> DataFrame:
    """feature, n1, n2, log_fold, t, p: means' difference, Student's statistic of features with two values in both groups, and
    its two-sided p."""
    se = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2) * (1 / F.col("n1") + 1 / F.col("n2")))
    fold = F.col("m1") - F.col("m2")
    s = _two(m, one, two).select("feature", "n1", "n2", fold.alias("log_fold"), F.when(se > 0, F.try_divide(fold, se)).alias("t"))
    return s.withColumn("p", tails.t_two_sided(F.col("t"), F.col("n1") + F.col("n2") - 2))


def welch(m: DataFrame, one: str, two: str) -> DataFrame:
    """feature, t, df and two-sided p without the assumption of equal variances."""
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    se = F.sqrt(a + b)
    s = _two(m, one, two).select("feature", F.when(se > 0, F.try_divide(F.col("m1") - F.col("m2"), se)).alias("t"), F.when(se > 0, F.try_divide(F.pow(se, 4), a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))).alias("df"))
    return s.withColumn("p", tails.t_two_sided(F.col("t"), F.col("df")))


def criterion(folds: DataFrame, least_fold: float, most_p: float) -> DataFrame:
    """call of (log_fold, p): up or down where the fold is beyond least_fold and p below most_p. Where no feature's p is
    below 1, so that none could be tested, a p of 1 calls by the fold alone."""
    tested = folds.agg(F.min("p").alias("_least"))
    strong = (F.abs("log_fold") > least_fold) & ((F.col("p") < most_p) | ((F.col("p") == 1) & (F.col("_least") == 1)))
    call = F.when(strong & (F.col("log_fold") > 0), "up").when(strong, "down").otherwise("none")
    return folds.join(F.broadcast(tested)).withColumn("call", call).drop("_least")


def anova_f(m: DataFrame) -> DataFrame:
    """One-way F over the groups of each feature, and its p."""
    g = m.groupBy("feature", "grp").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("ss"))
    s = g.groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.pow(F.sum(F.col("n") * F.col("mean")), 2) / F.sum("n")).alias("ssb"), F.sum("ss").alias("ssw"))
    s = s.where("k > 1 AND n > k").withColumn("f", F.when(F.col("ssw") > 0, F.try_divide(F.greatest("ssb", F.lit(0.0)) / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k")))))
    return s.select("feature", "f", tails.f_tail(F.col("f"), F.col("k") - 1, F.col("n") - F.col("k")).alias("p"))


def average_rank(rows: DataFrame, by: list[str], value: str, out: str = "avg_rank") -> DataFrame:
    """Ranks from 1 with ties at their mean."""
    rank = F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / F.lit(2.0)
    return rows.withColumn(out, rank)


def tie_share(rank: str, value: str, by: list[str]) -> Column:
    """What a row adds to the sum of t**3 - t over groups of t equal values: t**2 - 1."""
    t = F.count("*").over(W.partitionBy(*by, value))
    return (t * t - 1).cast("double")


def kruskal_h(m: DataFrame) -> DataFrame:
    """The Kruskal-Wallis statistic, corrected for ties, and p by chi-square; 0 and 1 where all values are equal."""
    r = average_rank(dealt(m, ["feature"]), ["feature"], "value", "rk").withColumn("_tie", tie_share("rk", "value", ["feature"]))
    g = r.groupBy("feature", "grp").agg(F.count("*").alias("n"), F.sum("rk").alias("rs"), F.sum("_tie").alias("tie"))
    s = g.groupBy("feature").agg(F.sum("n").alias("n"), F.sum(F.col("rs") * F.col("rs") / F.col("n")).alias("s"), F.count("*").alias("k"), F.sum("tie").alias("tie")).where("k > 1")
    n = F.col("n").cast("double")
    share = 1 - F.col("tie") / (n * n * n - n)
    h = (F.lit(12.0) / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / share
    s = s.select("feature", "k", F.when(share > 0, F.greatest(h, F.lit(0.0))).otherwise(0.0).alias("h"))
    return s.select("feature", "h", tails.chi_square_tail(F.col("h"), F.col("k") - 1).alias("p"))


def mann_whitney_u(m: DataFrame, one: str, two: str) -> DataFrame:
    """U of the first group, |z| with the correction for ties, and the one-sided p; both null where all values are equal."""
    r = average_rank(dealt(m.where(F.col("grp").isin(one, two)), ["feature"]), ["feature"], "value", "rk").withColumn("_tie", tie_share("rk", "value", ["feature"]))
    s = r.groupBy("feature").agg(F.count_if(F.col("grp") == one).alias("n1"), F.count_if(F.col("grp") == two).alias("n2"), F.sum(F.when(F.col("grp") == one, F.col("rk"))).alias("r1"), F.sum("_tie").alias("tie")).where("n1 > 0 AND n2 > 0")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    share = 1 - F.col("tie") / (n * n * n - n)
    u = F.col("r1") - n1 * (n1 + 1) / F.lit(2.0)
    z = F.abs(u - n1 * n2 / 2) / F.sqrt(share * n1 * n2 * (n + 1) / 12)
    s = s.select("feature", u.alias("u"), F.when(share > 0, z).alias("z"))
    return s.withColumn("p", tails.normal_two_sided(F.col("z")) / 2)


def step_up(p: DataFrame, key: str, value: str) -> DataFrame:
    """Benjamini-Hochberg: p * n / rank, with the running minimum from the largest. Rows are dealt by ranges of p; ranks and
    minima inside a range meet in a table of a row for each range."""
    ranked = global_rank(p, [value, key], "_k", "_n", "_part")
    raw = ranked.withColumn("_q", F.least(F.col(value) * F.col("_n") / F.col("_k"), F.lit(1.0)))
    return least_from_here(raw, "_q", "_k", "_part", "q").drop("_k", "_n", "_q", "_part")


def bonferroni(p: DataFrame, value: str) -> DataFrame:
    n = p.agg(F.count("*").alias("_n"))
    return p.join(F.broadcast(n)).withColumn("adjusted", F.least(F.col(value) * F.col("_n"), F.lit(1.0))).drop("_n")


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's r of the rows that have both, as F.corr; null where x or y doesn't vary, which F.corr takes for an error."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def describe(m: DataFrame) -> DataFrame:
    return m.groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.median("value").alias("median"), F.min("value").alias("low"), F.max("value").alias("high"))


#: Features of a block, at most; cells of a block, by which features are fewer; features held against a block at once.
BLOCK, CELLS, ROWS = 2048, 1 << 21, 256


def _pair(x: list[np.ndarray], y: list[np.ndarray]) -> float:
    """r of one pair from counts, sums and squares by sample, by its own means; nan where either doesn't vary."""
    at = (x[0] > 0) & (y[0] > 0)
    (cx, sx, qx), (cy, sy, qy) = ([c[at] for c in z] for z in (x, y))
    mx, my, n = sx / cx, sy / cy, cx * cy
    mx, my = mx - mx[0], my - my[0]
    dx, dy = mx - (n * mx).sum() / n.sum(), my - (n * my).sum() / n.sum()
    vx, vy = (cy * np.maximum(qx - sx * sx / cx, 0) + n * dx * dx).sum(), (cx * np.maximum(qy - sy * sy / cy, 0) + n * dy * dy).sum()
    return float((n * dx * dy).sum() / (np.sqrt(vx) * np.sqrt(vy))) if vx > 0 and vy > 0 else np.nan


def _block_pairs(table: pa.Table, least: int) -> Iterator[pa.Table]:
    """(a, b, r) of the features of one block (_side 0) against those of the other (1), or among themselves if there is no other."""
    samples, at = np.unique(table.column("_s").combine_chunks().flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    sizes = pc.list_value_length(table.column("_s")).to_numpy()
    whole = np.zeros((4, len(sizes), len(samples)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    for i, name in enumerate(("_c", "_x", "_q", "_n")):
        whole[i][row, at] = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    names, side = table.column("feature").to_numpy(), table.column("_side").to_numpy()
    kind = table.schema.field("feature").type
    one = np.flatnonzero(side == 0)
    two = np.flatnonzero(side == 1) if (side == 1).any() or table.column("_i")[0] != table.column("_j")[0] else one
    cy, sy, qy, ny = (z[two] for z in whole)
    for i in range(0, len(one), ROWS):
        cx, sx, qx, nx = (z[one[i : i + ROWS]] for z in whole)
        a, b = names[one[i : i + ROWS]][:, None], names[two][None, :]
        take = (nx @ ny.T >= least) & ((a < b) if two is one else (a != b))
        n, x, y = cx @ cy.T, sx @ cy.T, cx @ sy.T
        xx, yy = n * (qx @ cy.T), n * (cx @ qy.T)
        vx, vy = xx - x * x, yy - y * y
        with np.errstate(all="ignore"):
            r = (n * (sx @ sy.T) - x * y) / (np.sqrt(vx) * np.sqrt(vy))
        # where little is left of a difference, the pair's own means tell
        for p, q in zip(*np.nonzero(take & ~((vx > 1e-6 * xx) & (vy > 1e-6 * yy)) & (n > 0)), strict=True):
            r[p, q] = _pair([cx[p], sx[p], qx[p]], [cy[q], sy[q], qy[q]])
        r[n == 0] = np.nan
        p, q = np.nonzero(take)
        first, second = names[one[i : i + ROWS]][p], names[two][q]
        swap = first > second
        first, second = np.where(swap, second, first), np.where(swap, first, second)
        yield pa.table({"a": pa.array(first, kind), "b": pa.array(second, kind), "r": pa.array(r[p, q], from_pandas=True)})


def correlate_pairs(m: DataFrame, least: int) -> DataFrame:
    """Pearson's r of every two features that share at least that many samples; null where either doesn't vary there.

    Features are dealt into blocks, and every two blocks meet in a task, which multiplies their matrices of samples: a feature is sent once for
    each block, and no table of pairs and samples is made. Sums are of values less their feature's mean."""
    m = m.where("feature IS NOT NULL AND sample IS NOT NULL")
    sample = F.col("sample").cast("long") if dict(m.dtypes)["sample"] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("sample")
    mean = F.avg("value").over(W.partitionBy("feature"))
    v = F.col("value").cast("double")
    cells = m.withColumn("value", v - mean).groupBy("feature", sample.alias("s")).agg(F.count("value").cast("double").alias("c"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("x"), F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0)).alias("q"), F.count("*").cast("double").alias("n"))
    own = F.collect_list(F.struct("s", "c", "x", "q", "n")).alias("_l")
    rows = kept(cells.groupBy("feature").agg(own).select("feature", *(F.col("_l")[k].alias(f"_{k}") for k in "scxqn")))
    size = rows.agg(F.count("*").alias("f"), F.coalesce(F.sum(F.size("_s")), F.lit(0)).alias("c")).first()
    block = max(min(BLOCK, CELLS * size.f // max(size.c, 1)), 1)
    k, many = F.pmod(F.xxhash64("feature"), F.lit(-(-size.f // block) or 1)), -(-size.f // block) or 1
    met = rows.withColumn("_k", k).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    met = met.withColumns({"_i": F.least("_k", "_o"), "_j": F.greatest("_k", "_o"), "_side": (F.col("_k") > F.col("_o")).cast("int")}).drop("_k", "_o")
    kind = dict(m.dtypes)["feature"]

    def pairs(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _block_pairs(pa.Table.from_batches(list(tables)), least):
            yield from found.to_batches()

    return met.groupBy("_i", "_j").applyInArrow(pairs, f"a {kind}, b {kind}, r double")
