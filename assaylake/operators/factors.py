"""Factors of tables: sparse non-negative matrices by alternating least squares, independent components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators.neighbours import _matrix
from assaylake.sources.kept import dropped, kept


def _square(t: DataFrame, c: str, k: int) -> np.ndarray:
    """The sum of c's outer products: k by k numbers come to the driver."""
    row = t.agg(*(F.sum(F.col(c)[i] * F.col(c)[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k))).first()
    return np.array([[float(row[f"s{min(i, j)}_{max(i, j)}"] or 0.0) for j in range(k)] for i in range(k)])


def _times(t: DataFrame, c: str, by: np.ndarray):
    """c's arrays times a small matrix."""
    return F.transform(F.lit(by.T.tolist()), lambda col: F.aggregate(F.zip_with(c, col, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v))


def _across(cells: DataFrame, one: DataFrame, key: str, other: str, k: int) -> DataFrame:
    """(other, f): each other's sum of value times one's array."""
    return cells.join(one.select(key, F.col("f").alias("_f")), key).groupBy(other).agg(F.array(*(F.sum(F.col("value") * F.col("_f")[i]) for i in range(k))).alias("f"))


def _orthonormal(t: DataFrame, key: str, k: int) -> DataFrame:
    """t with arrays whose columns are orthonormal, by the square root of their products; directions without length become zero."""
    values, vectors = np.linalg.eigh(_square(t, "f", k))
    root = np.where(values > max(values.max(), 0) * 1e-14, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return t.select(key, _times(t, "f", vectors * root).alias("f"))


def _singular(cells: DataFrame, k: int, seed: int, power: int = 4) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(feature, f), (sample, f) and the values of the k leading singular directions of cells, by iterated random projections."""
    wide = k + 6
    u = lambda i: (F.xxhash64(F.lit(seed), "sample", F.lit(i)) % F.lit(1 << 20)).cast("double") / F.lit(float(1 << 20))
    right = cells.select("sample").distinct().select("sample", F.array(*(u(i) for i in range(wide))).alias("f"))
    for _ in range(power):
        left = kept(_orthonormal(kept(_across(cells, right, "sample", "feature", wide)), "feature", wide))
        right = kept(_orthonormal(kept(_across(cells, left, "feature", "sample", wide)), "sample", wide))
    b = kept(_across(cells, right, "sample", "feature", wide))
    values, vectors = np.linalg.eigh(_square(b, "f", wide))
    order = np.argsort(-values)[:k]
    s = np.sqrt(np.maximum(values[order], 0))
    turn = vectors[:, order]
    return b.select("feature", _times(b, "f", turn / np.where(s > 0, s, 1.0)).alias("f")), right.select("sample", _times(right, "f", turn).alias("f")), s


def _positive_start(cells: DataFrame, k: int, seed: int) -> DataFrame:
    """(feature, f): of every singular direction the positive or the negative part, whichever has more of it on both sides."""
    left, right, s = _singular(cells, k, seed)
    left, right = kept(left), kept(right)

    def norms(t):
        row = t.agg(*(F.sqrt(F.sum(F.pow(F.greatest(F.col("f")[i] * sign, F.lit(0.0)), F.lit(2.0)))).alias(f"n{i}_{j}") for i in range(k) for j, sign in ((0, 1.0), (1, -1.0)))).first()
        return np.array([[row[f"n{i}_{j}"] or 0.0 for j in (0, 1)] for i in range(k)])

    u, v = norms(left), norms(right)
    side = (u[:, 1] * v[:, 1] > u[:, 0] * v[:, 0]).astype(int)
    at = range(k)
    scale = np.sqrt(s * u[at, side] * v[at, side]) / np.where(u[at, side] > 0, u[at, side], 1.0)
    return left.select("feature", F.array(*(F.greatest(F.col("f")[i] * F.lit(1.0 if side[i] == 0 else -1.0), F.lit(0.0)) * F.lit(float(scale[i])) for i in at)).alias("f"))


def non_negative(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rows h >= 0 that make h gram h' / 2 - h right' least, one for each row of right, by active sets: of the free numbers each
    set is solved at once for all rows that share it."""
    k = len(gram)
    h, free = np.zeros_like(right), np.zeros(right.shape, bool)
    live = np.arange(len(right))
    for _ in range(30 * k):
        slope = right[live] - h[live] @ gram
        slope[free[live]] = -np.inf
        pick = slope.argmax(axis=1)
        open_ = slope[np.arange(len(live)), pick] > 1e-10 * (1 + np.abs(right[live]).max(axis=1, initial=0))
        live, pick = live[open_], pick[open_]
        if not len(live):
            break
        free[live, pick] = True
        inner = live
        while len(inner):
            masks, which = np.unique(free[inner], axis=0, return_inverse=True)
            z = np.zeros((len(inner), k))
            for m, mask in enumerate(masks):
                rows = np.flatnonzero(which.ravel() == m)
                if mask.any():
                    z[np.ix_(rows, mask)] = np.linalg.lstsq(gram[np.ix_(mask, mask)], right[inner[rows]][:, mask].T, rcond=None)[0].T
            bad = free[inner] & (z <= 1e-14)
            fine = ~bad.any(axis=1)
            h[inner[fine]] = z[fine]
            inner, z, bad = inner[~fine], z[~fine], bad[~fine]
            if not len(inner):
                break
            now = h[inner]
            with np.errstate(all="ignore"):
                step = np.where(bad, now / np.where(now - z == 0, 1e-300, now - z), np.inf).min(axis=1)
            now = now + np.clip(step, 0, 1)[:, None] * (z - now)
            out = free[inner] & (now <= 1e-14)
            # a set that doesn't shrink would be solved again for ever
            stuck = ~out.any(axis=1)
            out[stuck] = bad[stuck]
            now[out] = 0.0
            free[inner] &= ~out
            h[inner] = np.maximum(now, 0)
    return h


def sparse_nmf(cells: DataFrame, rank: int, rounds: int = 20, sparsity: float = 0.01, ridge: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame, list[float]]:
    """(feature, f), (sample, f) and the objective after each round: cells (feature, sample, value >= 0; no cell: 0) as a product of
    non-negative factors of that rank, the samples' ones sparse.

    The objective is half the squared error, plus ridge / 2 times the features' squared factors, plus sparsity / 2 times the squared
    sum of each sample's factors. ridge is the largest value if none is given. Each half of a round is a least-squares problem
    with h >= 0 for each sample or feature, of rank numbers, which is solved exactly; so the objective never rises. The features'
    start comes from singular directions. Factors stay tables, and only squares of rank by rank come to the driver."""
    x = kept(cells.select("feature", "sample", F.col("value").cast("double").alias("value")).where("value > 0"))
    square = x.agg(F.sum(F.col("value") * F.col("value")).alias("s"), F.max("value").alias("m")).first()
    eta = float(ridge if ridge is not None else square["m"] or 0.0)
    types = dict(cells.dtypes)

    def solved(one: DataFrame, key: str, other: str, more: np.ndarray) -> DataFrame:
        gram = _square(one, "f", rank) + more

        def rows(batches):
            for b in batches:
                h = non_negative(gram, _matrix(b.column("f")).reshape(-1, rank)) if len(b) else np.zeros((0, rank))
                yield pa.RecordBatch.from_arrays([b.column(other), b.column("f"), pa.array(h.tolist(), pa.list_(pa.float64()))], [other, "top", "f"])

        return kept(_across(x, one, key, other, rank).mapInArrow(rows, f"{other} {types[other]}, top array<double>, f array<double>"))

    w, h, seen = kept(_positive_start(x, rank, seed)), None, []
    for _ in range(rounds):
        h = solved(w, "feature", "sample", sparsity * np.ones((rank, rank)))
        after = solved(h, "sample", "feature", eta * np.eye(rank))
        dropped(w)
        w = after
        ww, hh = _square(w, "f", rank), _square(h, "f", rank)
        met = w.agg(F.sum(F.aggregate(F.zip_with("f", "top", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v))).first()[0] or 0.0
        seen.append(0.5 * ((square["s"] or 0.0) - 2 * met + float((ww * hh).sum())) + eta / 2 * float(np.trace(ww)) + sparsity / 2 * float(hh.sum()))
    return w.select("feature", "f"), h.select("sample", "f"), seen


def assigned(factors: DataFrame, key: str) -> DataFrame:
    """(key, cluster): the number, from 1, of the largest factor, ties to the smaller; null where all are 0."""
    top = F.array_max("f")
    return factors.select(key, F.when(top > 0, F.array_position("f", top).cast("int")).alias("cluster"))


def independent(vectors: DataFrame, key: str, vector: str, n: int, rounds: int = 200, least: float = 1e-6, seed: int = 7) -> DataFrame:
    """(key, sources): n independent components of the vectors, by fixed-point rounds (log cosh, all components at once).

    The vectors are centred and whitened by their covariance's leading directions, for which one square of coordinates comes to the
    driver. A round is one aggregation of n by n numbers over all vectors, and rounds end when no direction turns by more than
    least. Components are those of variance 1, ordered by no more than the start that seed draws. Null vectors, and those of another
    length than the longest, take no part; n may not be beyond the directions that have variance."""
    v = F.transform(vector, lambda e: e.cast("double"))
    width = vectors.agg(F.max(F.size(vector))).first()[0] or 0
    x = kept(vectors.where(F.size(vector) == width).select(key, v.alias("v")))

    def moments(batches):
        total, s, c = np.zeros((width, width)), np.zeros(width), 0
        for b in batches:
            if len(b):
                a = _matrix(b.column("v"))
                total, s, c = total + a.T @ a, s + a.sum(axis=0), c + len(a)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "row": total.tolist(), "s": s, "n": pa.array([c] * width, pa.int64())})

    parts = x.mapInArrow(moments, "i int, row array<double>, s double, n long")
    rows = parts.groupBy("i").agg(F.array(*(F.sum(F.col("row")[j]) for j in range(width))).alias("row"), F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    if not rows or not rows[0]["n"]:
        return x.select(key, F.array().cast("array<double>").alias("sources"))
    count = rows[0]["n"]
    mean = np.array([r["s"] for r in rows]) / count
    values, directions = np.linalg.eigh(np.array([r["row"] for r in rows]) / count - np.outer(mean, mean))
    lead = np.argsort(-values)[:n]
    if n > width or values[lead[-1]] <= values.max() * 1e-12:
        raise ValueError(f"the vectors vary in fewer than {n} directions")
    white = directions[:, lead] / np.sqrt(values[lead])

    def even(w: np.ndarray) -> np.ndarray:
        s, u = np.linalg.eigh(w @ w.T)
        return u @ np.diag(1 / np.sqrt(s)) @ u.T @ w

    w = even(np.random.default_rng(seed).standard_normal((n, n)))
    for _ in range(rounds):

        def turned(batches, w=w):
            top, slope = np.zeros((n, n)), np.zeros(n)
            for b in batches:
                if len(b):
                    z = (_matrix(b.column("v")) - mean) @ white
                    g = np.tanh(z @ w.T)
                    top, slope = top + g.T @ z, slope + (1 - g * g).sum(axis=0)
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(n), pa.int32()), "row": top.tolist(), "s": slope})

        sums = x.mapInArrow(turned, "i int, row array<double>, s double").groupBy("i").agg(F.array(*(F.sum(F.col("row")[j]) for j in range(n))).alias("row"), F.sum("s").alias("s")).orderBy("i").collect()
        new = even(np.array([r["row"] for r in sums]) / count - (np.array([r["s"] for r in sums]) / count)[:, None] * w)
        away = np.abs(np.abs((new * w).sum(axis=1)) - 1).max()
        w = new
        if away < least:
            break
    onto = white @ w.T
    shifted = F.zip_with("v", F.lit(mean.tolist()), lambda a, b: a - b)
    return x.select(key, shifted.alias("v")).select(key, _times(x, "v", onto).alias("sources"))
