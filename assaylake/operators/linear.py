"""Linear models of features over designed samples, step-down permutation tests, and median polish."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaylake.functions import tails
from assaylake.operators.neighbours import _matrix
from assaylake.operators.ranks import dealt
from assaylake.sources.kept import dropped, kept

#: Rounds of relabelling that a task holds at once.
SOME = 512
#: Numbers of a design matrix that is sent to every task.
CELLS = 1 << 20


def contrasts(cells: DataFrame, design: DataFrame, names: dict[str, Sequence[float]]) -> DataFrame:
    """(feature, contrast, estimate, t, p, f, f_p): linear models of cells (feature, sample, value) on design (sample, x: its row of
    the design matrix, as an array), and contrasts of their coefficients by name.

    A feature's normal equations are sums over its cells, so a feature may lack values at some samples; equations are solved some
    features at a time. f tests all contrasts together. Features whose own rows of the design don't determine all coefficients, or leave
    no degree of freedom, are left out; those without any residual have null t, f and p. Null values take no part."""
    p, c = len(next(iter(names.values()))), np.array(list(names.values()), float)
    rank = int(np.linalg.matrix_rank(c))
    x = lambda i: F.col("x")[i]
    v = F.col("value")
    own = cells.select("feature", "sample", F.col("value").cast("double").alias("value")).where("value is not null")
    rows = design.select("sample", F.transform("x", lambda e: e.cast("double")).alias("x"))
    if design.count() * p <= CELLS:
        # few samples would be few keys of a join, and few tasks
        own = dealt(own, ["feature"]).join(F.broadcast(rows), "sample")
    else:
        own = dealt(own.join(rows, "sample"), ["feature"])
    sums = own.groupBy("feature").agg(
        F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("yy"),
        F.array(*(F.sum(x(i) * x(j)) for i in range(p) for j in range(p))).alias("xx"), F.array(*(F.sum(x(i) * v) for i in range(p))).alias("xy"),
    )

    def solve(batches):
        for b in batches:
            xx, xy = _matrix(b.column("xx")).reshape(-1, p, p) if len(b) else np.zeros((0, p, p)), _matrix(b.column("xy")).reshape(-1, p) if len(b) else np.zeros((0, p))
            n, yy = np.asarray(b.column("n")).astype(float), np.asarray(b.column("yy"))
            ok = (n > p) & (np.linalg.matrix_rank(xx) == p if len(xx) else np.zeros(0, bool))
            xx, xy, n, yy = xx[ok], xy[ok], n[ok], yy[ok]
            inverse = np.linalg.inv(xx)
            beta = np.einsum("fij,fj->fi", inverse, xy)
            rss = np.maximum(yy - np.einsum("fi,fi->f", beta, xy), 0)
            rss[rss < 1e-12 * np.maximum(yy, 1e-300)] = 0
            s2 = rss / (n - p)
            est = beta @ c.T
            cov = np.einsum("ki,fij,lj->fkl", c, inverse, c)
            with np.errstate(all="ignore"):
                t = est / np.sqrt(s2[:, None] * np.einsum("fkk->fk", cov))
                f = np.einsum("fk,fkl,fl->f", est, np.linalg.pinv(cov), est) / rank / s2
            many = lambda a: pa.array([list(map(float, r)) for r in a], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("feature").filter(pa.array(ok)), pa.array(n - p), many(est), many(t), pa.array(f)], ["feature", "df", "est", "t", "f"])

    kind = dict(cells.dtypes)["feature"]
    found = sums.mapInArrow(solve, f"feature {kind}, df double, est array<double>, t array<double>, f double")
    finite = lambda e: F.when(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), e)
    each = F.explode(F.arrays_zip(F.lit(list(names)).alias("name"), F.col("est"), F.col("t"))).alias("z")
    rows = found.select("feature", "df", finite(F.col("f")).alias("f"), each).select("feature", "df", "f", F.col("z.name").alias("contrast"), F.col("z.est").alias("estimate"), finite(F.col("z.t")).alias("t"))
    return rows.select("feature", "contrast", "estimate", "t", tails.t_two_sided(F.col("t"), F.col("df")).alias("p"), "f", tails.f_tail(F.col("f"), F.lit(float(rank)), F.col("df")).alias("f_p"))


def _welch(y: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """|t| of unequal variances: features by values, relabellings by samples (1: first group) -> features by relabellings."""
    one = sides.astype(float).T
    n1, n2 = one.sum(axis=0), len(one) - one.sum(axis=0)
    s1, q1 = y @ one, (y * y) @ one
    s2, q2 = y.sum(axis=1)[:, None] - s1, (y * y).sum(axis=1)[:, None] - q1
    m1, m2 = s1 / n1, s2 / n2
    v1, v2 = np.maximum(q1 / n1 - m1 * m1, 0) * n1 / (n1 - 1), np.maximum(q2 / n2 - m2 * m2, 0) * n2 / (n2 - 1)
    with np.errstate(all="ignore"):
        return np.nan_to_num(np.abs(m1 - m2) / np.sqrt(v1 / n1 + v2 / n2), nan=0.0, posinf=np.inf)


def relabellings(n: int, first: int, rounds: int, seed: int) -> np.ndarray:
    """Random choices of first of n samples, one row a round, the real one (the first samples) in front."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rounds, n), bool)
    out[0, :first] = True
    for r in range(1, rounds):
        out[r, rng.choice(n, first, replace=False)] = True
    return out


def max_t(cells: DataFrame, groups: DataFrame, one: str, two: str, rounds: int, seed: int = 42) -> DataFrame:
    """(feature, t, p, adjusted): step-down tests by the largest t of relabelled samples. cells (feature, sample, value), groups
    (sample, grp). t is Welch's, without its sign.

    p is the share of relabellings (the real one is the first) with as large a t. For adjusted, features are ordered by their real t; in
    every relabelling each one is held against the largest t of itself and of those behind it, and it may not be below that of the one
    before. Features that lack a value are left out. A feature's values are one row; ranges of the order give their largest t of
    every relabelling, and so a range knows those behind it: a table of ranges by rounds, never of features by rounds."""
    own = groups.where(F.col("grp").isin(one, two)).select("sample", "grp")
    samples = own.orderBy(F.col("grp") != one, "sample").collect()  # an experiment's samples
    n, n1 = len(samples), sum(r["grp"] == one for r in samples)
    kind = dict(cells.dtypes)["feature"]
    if n1 < 2 or n - n1 < 2:
        return cells.sparkSession.createDataFrame([], f"feature {kind}, t double, p double, adjusted double")
    order = own.groupBy().agg(F.array_sort(F.collect_list(F.struct((F.col("grp") != one).alias("g"), "sample"))).alias("s")).select(F.posexplode("s").alias("at", "x")).select("at", "x.sample")
    rows = cells.join(F.broadcast(order), "sample").where("value is not null").groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("at", F.col("value").cast("double").alias("v")))).alias("y")).where(F.size("y") == n)
    sides = relabellings(n, n1, rounds, seed)

    def real(batches):
        for b in batches:
            y = _matrix(b.column("y"))
            t = _welch(y, sides[:1])[:, 0] if len(b) else np.zeros(0)
            yield b.append_column("t", pa.array(t))

    y = rows.select("feature", F.transform("y", lambda s: s["v"]).alias("y")).mapInArrow(real, f"feature {kind}, y array<double>, t double")
    by = [F.col("t").desc(), F.col("feature")]
    x = kept(y.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("_at", 33)))

    def tops(key, table):
        y, best = _matrix(table.column("y")), []
        for a in range(0, rounds, SOME):
            best += _welch(y, sides[a : a + SOME]).max(axis=0).tolist()
        return pa.table({"part": pa.array([key[0].as_py()] * rounds, pa.int64()), "round": pa.array(range(rounds), pa.int32()), "top": best})

    top = x.groupBy("part").applyInArrow(tops, "part long, round int, top double")
    behind = F.max("top").over(W.partitionBy("round").orderBy(F.col("part").desc()).rowsBetween(W.unboundedPreceding, -1))
    rest = top.withColumn("rest", behind).groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("round", F.coalesce("rest", F.lit(0.0)).alias("rest")))), lambda s: s["rest"]).alias("rest"))

    def shares(mine, others):
        mine = mine.sort_by("_at")
        y, t = _matrix(mine.column("y")), np.asarray(mine.column("t"))
        rest = _matrix(others.column("rest"))[0]
        own, step = np.zeros(len(t)), np.zeros(len(t))
        for a in range(0, rounds, SOME):
            d = _welch(y, sides[a : a + SOME])
            least = t[:, None] * (1 - 1e-12)
            own += (d >= least).sum(axis=1)
            u = np.maximum(np.maximum.accumulate(d[::-1], axis=0)[::-1], rest[a : a + SOME])
            step += (u >= least).sum(axis=1)
        return pa.table({"feature": mine.column("feature"), "_at": mine.column("_at"), "t": t, "p": own / rounds, "step": np.maximum.accumulate(step / rounds)})

    found = kept(x.groupBy("part").cogroup(rest.groupBy("part")).applyInArrow(shares, f"feature {kind}, _at long, t double, p double, step double"))
    before = found.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.max("step").alias("_m"))
    before = before.select("part", F.coalesce(F.max("_m").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_least"))
    return found.join(F.broadcast(before), F.shiftright("_at", 33) == F.col("part")).select("feature", "t", "p", F.greatest("step", "_least").alias("adjusted"))


def median_polish(cells: DataFrame, by: list[str], rounds: int = 10, least: float = 0.01) -> DataFrame:
    """cells (by, row, col, value) with overall, row_effect, col_effect and residual, by group: medians of rows and of columns are taken
    off in turn, until the sum of absolute residuals of all groups falls by a share of less than least, or rounds have passed.

    A round is two aggregations and joins of a written table, for all groups at once; null values take no part."""
    zero = F.lit(0.0)
    x = kept(cells.where("value is not null").select(*by, "row", "col", F.col("value").cast("double").alias("value")).select("*", F.col("value").alias("residual"), zero.alias("overall"), zero.alias("row_effect"), zero.alias("col_effect")))
    was = None
    for _ in range(rounds):
        y = x
        for one, other in (("row", "col"), ("col", "row")):
            # the group's level is the median of the other side's effects
            level = y.select(*by, other, f"{other}_effect").distinct().groupBy(*by).agg(F.median(f"{other}_effect").alias("_l"))
            own = y.groupBy(*by, one).agg(F.median("residual").alias("_m"))
            y = y.join(own, [*by, one]).join(level, by) if by else y.join(own, one).join(F.broadcast(level))
            y = y.withColumns({"residual": F.col("residual") - F.col("_m"), f"{one}_effect": F.col(f"{one}_effect") + F.col("_m"), f"{other}_effect": F.col(f"{other}_effect") - F.col("_l"), "overall": F.col("overall") + F.col("_l")}).drop("_m", "_l")
        y = kept(y.select(*x.columns))
        now = y.agg(F.sum(F.abs("residual"))).first()[0] or 0.0
        dropped(x)
        x = y
        if now == 0 or was is not None and abs(was - now) <= least * now:
            break
        was = now
    return x
