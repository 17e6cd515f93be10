"""Fitted models of vectors: k-means, principal components, batch correction, dispersion curves."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def k_means(vectors: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    """(key, cluster), clusters numbered from 1 by size, the smallest first; ties by their first key."""
    x = vectors.select(key, array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("features"))
    found = KMeans(k=k, seed=seed, maxIter=20).fit(x).transform(x).select(key, "prediction")
    sizes = found.groupBy("prediction").agg(F.count("*").alias("n"), F.min(key).alias("first")).orderBy("n", "first").limit(k).collect()
    names = F.create_map(*[F.lit(v) for i, r in enumerate(sizes, 1) for v in (r["prediction"], i)])
    return found.select(key, names[F.col("prediction")].alias("cluster"))


def components(vectors: DataFrame, key: str, vector: str, n: int) -> DataFrame:
    """(key, scores): projections on the n leading singular directions of the values over their common standard deviation,
    not centred. The products of coordinates are summed on the executors; the driver gets one square of coordinates."""
    width = vectors.select(F.max(F.size(vector))).first()[0] or 0
    if width < 1:
        return vectors.select(key, F.array().cast("array<double>").alias("scores"))

    def products(batches):
        total, s, q, c = np.zeros((width, width)), 0.0, 0.0, 0
        for frame in batches:
            a = np.array(frame["v"].tolist(), dtype=np.float64)
            if len(a):
                total, s, q, c = total + a.T @ a, s + a.sum(), q + (a * a).sum(), c + a.size
        import pandas as pd

        yield pd.DataFrame({"i": range(width), "row": list(total), "s": [s] + [0.0] * (width - 1), "q": [q] + [0.0] * (width - 1), "c": [c] + [0] * (width - 1)})

    whole = vectors.where(F.size(vector) == width).select(F.transform(vector, lambda v: v.cast("double")).alias("v"))
    parts = whole.mapInPandas(products, "i int, row array<double>, s double, q double, c long")
    cells = parts.select("i", F.posexplode("row").alias("j", "x"), "s", "q", "c").groupBy("i", "j").agg(F.sum("x").alias("x"))
    gram = np.zeros((width, width))
    for r in cells.collect():
        gram[r["i"], r["j"]] = r["x"]
    t = parts.agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("c").alias("c")).first()
    sd = np.sqrt(max((t["q"] or 0) / max(t["c"] or 1, 1) - ((t["s"] or 0) / max(t["c"] or 1, 1)) ** 2, 0)) or 1.0
    values, directions = np.linalg.eigh(gram)
    lead = directions[:, np.argsort(values)[::-1][:n]]
    lead = lead * np.sign(lead[np.abs(lead).argmax(0), range(lead.shape[1])])  # the largest loading is positive
    score = lambda w: F.aggregate(F.zip_with(F.col("_v"), F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / F.lit(float(sd))
    return vectors.select(key, F.transform(vector, lambda v: v.cast("double")).alias("_v")).select(key, F.array(*[score(w) for w in lead.T]).alias("scores"))


def center_batches(m: DataFrame) -> DataFrame:
    """(feature, batch, sample, value) less the feature's mean in the batch."""
    mean = m.groupBy("feature", "batch").agg(F.avg("value").alias("_m"))
    return m.join(mean, ["feature", "batch"]).select("feature", "batch", "sample", (F.col("value") - F.col("_m")).alias("value"))


def dispersion_curve(points: DataFrame, x: str, y: str) -> tuple[float, float, float]:
    """Coefficients c0, c1, c2 of the least-squares parabola of y over x, from eight sums."""
    v = F.col(x).cast("double")
    r = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(*[F.sum(F.pow(v, F.lit(float(k)))).alias(f"p{k}") for k in range(5)], *[F.sum(F.pow(v, F.lit(float(k))) * F.col(y)).alias(f"q{k}") for k in range(3)]).first()
    if not r["p0"]:
        return 0.0, 0.0, 0.0
    a = np.array([[r[f"p{i + j}"] for j in range(3)] for i in range(3)])
    c = np.linalg.lstsq(a, np.array([r[f"q{i}"] for i in range(3)]), rcond=None)[0]
    return tuple(float(v) for v in c)


def combat(m: DataFrame, rounds: int = 60) -> DataFrame:
    """(feature, batch, sample, value) without batch effects: values standardised by feature, less the batch's location and over its
    scale, both shrunk to what the batch has over all features (empirical Bayes), and scaled back.

    All that is needed of a feature in a batch are its count, sum and sum of squares, so the fixed point of location and scale is an
    expression over those, iterated `rounds` times. Features whose values don't vary within batches stay as they are."""
    mean = m.groupBy("feature").agg(F.avg("value").alias("_grand"), F.count("value").alias("_all"))
    own = m.groupBy("feature", "batch").agg((F.var_pop("value") * F.count("value")).alias("_ss"))
    pooled = own.groupBy("feature").agg(F.sum("_ss").alias("_ss")).join(mean, "feature").select("feature", "_grand", F.sqrt(F.col("_ss") / F.col("_all")).alias("_sd"))
    s = m.join(pooled, "feature").withColumn("_s", F.when(F.col("_sd") > 0, (F.col("value") - F.col("_grand")) / F.col("_sd")))
    cell = s.where("_s IS NOT NULL").groupBy("feature", "batch").agg(F.count("*").cast("double").alias("n"), F.avg("_s").alias("g"), F.var_samp("_s").alias("d"), F.sum("_s").alias("s1"), F.sum(F.col("_s") * F.col("_s")).alias("s2"))
    k = cell.groupBy("batch").agg(F.avg("g").alias("g_bar"), F.var_samp("g").alias("t2"), F.avg("d").alias("dm"), F.var_samp("d").alias("dv"))
    k = k.select("batch", "g_bar", "t2", ((2 * F.col("dv") + F.col("dm") * F.col("dm")) / F.col("dv")).alias("a"), ((F.col("dm") * F.col("dv") + F.col("dm") * F.col("dm") * F.col("dm")) / F.col("dv")).alias("b"))
    x = cell.join(k, "batch")
    location = lambda scale: (F.col("t2") * F.col("n") * F.col("g") + scale * F.col("g_bar")) / (F.col("t2") * F.col("n") + scale)

    def step(scale, _):
        at = location(scale)
        return (0.5 * (F.col("s2") - 2 * at * F.col("s1") + F.col("n") * at * at) + F.col("b")) / (F.col("n") / 2 + F.col("a") - 1)

    x = x.withColumn("_scale", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("d"), step))
    # the location is the one that the last scale came from
    x = x.withColumn("_at", location(F.aggregate(F.sequence(F.lit(1), F.lit(rounds - 1)), F.col("d"), step))).select("feature", "batch", "_at", "_scale")
    out = s.join(x, ["feature", "batch"], "left")
    fixed = (F.col("_s") - F.col("_at")) / F.sqrt("_scale") * F.col("_sd") + F.col("_grand")
    return out.select("feature", "batch", "sample", F.when(F.col("_s").isNotNull(), fixed).otherwise(F.col("value")).alias("value"))


def rank_estimate(vectors: DataFrame, vector: str) -> int:
    """How many directions of the vectors, coordinates standardised, have an eigenvalue above the Tracy-Widom bound of noise. The
    products of coordinates are summed on the executors; the driver gets one square of coordinates."""
    width = vectors.select(F.max(F.size(vector))).first()[0] or 0
    if width < 1:
        return 0
    rows = vectors.where(F.size(vector) == width).select(F.transform(vector, lambda v: v.cast("double")).alias("v"))

    def products(batches):
        total, s, n = np.zeros((width, width)), np.zeros(width), 0
        for frame in batches:
            a = np.array(frame["v"].tolist(), dtype=np.float64)
            if len(a):
                total, s, n = total + a.T @ a, s + a.sum(axis=0), n + len(a)
        import pandas as pd

        yield pd.DataFrame({"i": range(width), "row": list(total), "s": s, "n": [n] * width})

    cells = rows.mapInPandas(products, "i int, row array<double>, s double, n long")
    gram, total, n = np.zeros((width, width)), np.zeros(width), 0
    for r in cells.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        gram[r["i"], r["j"]] = r["x"]
    for r in cells.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        total[r["i"]], n = r["s"], r["n"]
    if n < 2:
        return 0
    mean = total / n
    sd = np.sqrt(np.maximum(np.diag(gram) / n - mean * mean, 0))
    sd[sd == 0] = 1.0
    scaled = (gram - n * np.outer(mean, mean)) / np.outer(sd, sd)
    one, p = np.sqrt(n - 1.0), np.sqrt(float(width))
    bound = 3.273 * (one + p) * (1 / one + 1 / p) ** (1 / 3) + (one + p) ** 2
    return int((np.linalg.eigvalsh(scaled) > bound).sum())


def nmf(cells: DataFrame, rank: int, rounds: int = 20, seed: int = 42) -> DataFrame:
    """(feature, sample, value >= 0) as a product of non-negative factors: (sample, k, weight), by multiplicative updates of the
    squared error. Factors of features and samples stay tables; only the squares of rank by rank come to the driver."""
    from assaylake.sources.kept import kept

    def start(key: str) -> DataFrame:
        u = lambda k: (F.xxhash64(F.lit(seed), F.lit(key), key, F.lit(k)) % F.lit(1 << 20) + F.lit(1 << 20)).cast("double") / F.lit(float(1 << 21)) + 0.01
        return kept(cells.select(key).distinct().select(key, F.array(*[u(k) for k in range(rank)]).alias("f")))

    def square(f: DataFrame) -> list[list[float]]:
        row = f.agg(*[F.sum(F.col("f")[i] * F.col("f")[j]).alias(f"s{i}_{j}") for i in range(rank) for j in range(i, rank)]).first()
        return [[float(row[f"s{min(i, j)}_{max(i, j)}"] or 0.0) for j in range(rank)] for i in range(rank)]

    def update(one: DataFrame, key: str, two: DataFrame, other: str) -> DataFrame:
        s = square(two)
        top = x.join(two, other).groupBy(key).agg(*[F.sum(F.col("value") * F.col("f")[k]).alias(f"t{k}") for k in range(rank)])
        below = [sum((F.col("f")[j] * F.lit(s[j][k]) for j in range(rank)), F.lit(0.0)) for k in range(rank)]
        return kept(one.join(top, key, "left").select(key, F.array(*[F.col("f")[k] * F.coalesce(F.col(f"t{k}"), F.lit(0.0)) / (below[k] + 1e-12) for k in range(rank)]).alias("f")))

    x = kept(cells.select("feature", "sample", F.col("value").cast("double").alias("value")).where("value > 0"))
    w, h = start("feature"), start("sample")
    for _ in range(rounds):
        h = update(h, "sample", w, "feature")
        w = update(w, "feature", h, "sample")
    return h.select("sample", F.posexplode("f").alias("k", "weight"))


def expand_labels(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label) of the vectors without a label, by linear support vector machines of each label against the others."""
    from pyspark.ml.classification import LinearSVC, OneVsRest

    x = vectors.select(key, F.col(label).cast("double").alias("label"), array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("features"))
    fit = OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.01)).fit(x.where("label IS NOT NULL"))
    return fit.transform(x.where("label IS NULL")).select(key, F.col("prediction").cast("int").alias(label))
