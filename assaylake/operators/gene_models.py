"""Sets of features that tell classes of samples apart, chosen by cross-validated scores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.sources.kept import dropped, kept

_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _terms(cells: DataFrame, profiles: DataFrame) -> DataFrame:
    """(feature, sample, cls and the terms of a correlation) of every value beside every class's profile."""
    p = profiles.select("feature", "cls", F.col("value").cast("double").alias("y")).where("y is not null")
    x, y = F.col("x"), F.col("y")
    return cells.select("feature", "sample", F.col("value").cast("double").alias("x")).where("x is not null").join(p, "feature").select("feature", "sample", "cls", F.lit(1.0).alias("n"), "x", "y", (x * x).alias("xx"), (y * y).alias("yy"), (x * y).alias("xy"))


def _rho() -> Column:
    n, x, y, xx, yy, xy = map(F.col, _SUMS)
    vx, vy = n * xx - x * x, n * yy - y * y
    return F.when((vx > 1e-12 * n * xx) & (vy > 1e-12 * n * yy), (n * xy - x * y) / F.sqrt(vx * vy))


def _hits(sums: DataFrame, by: list[str], truth: DataFrame) -> DataFrame:
    """(by, sample, fold, own, hit): whether the class with the highest correlation is a sample's own; ties, to twelve places, go to
    the first name, and a sample without any correlation is missed."""
    called = sums.select(*by, "sample", "cls", F.round(_rho(), 12).alias("r")).groupBy(*by, "sample").agg(F.min(F.when(F.col("r").isNotNull(), F.struct((-F.col("r")).alias("d"), "cls")))["cls"].alias("called"))
    return called.join(truth.select("sample", F.col("cls").alias("own"), "fold"), "sample").select(*by, "sample", "fold", "own", F.coalesce(F.col("called") == F.col("own"), F.lit(False)).cast("long").alias("hit"))


def _sizes(truth: DataFrame, hits: DataFrame | None = None) -> list:
    """(fold, own, n, base): samples of each class in each fold and the hits among them; an experiment's folds and classes."""
    own = truth.groupBy("fold", F.col("cls").alias("own")).agg(F.count("*").alias("n"))
    if hits is None:
        return own.withColumn("base", F.lit(0)).collect()
    return own.join(hits.groupBy("fold", "own").agg(F.sum("hit").alias("base")), ["fold", "own"], "left").select("fold", "own", "n", F.coalesce("base", F.lit(0)).alias("base")).collect()


def _scored(candidates: DataFrame, more: DataFrame, by: list[str], sizes: list) -> DataFrame:
    """(by, score) of candidates (by), with more (by, fold, own, more) hits than sizes say."""
    if not sizes:
        return candidates.withColumn("score", F.lit(0.0))
    cells = F.array(*(F.struct(F.lit(r["fold"]).alias("fold"), F.lit(r["own"]).alias("own"), F.lit(r["n"]).alias("n"), F.lit(r["base"]).alias("base")) for r in sizes))
    each = candidates.withColumn("x", F.explode(cells)).select(*by, "x.*").join(more, [*by, "fold", "own"], "left")
    folds = each.groupBy(*by, "fold").agg((F.sum((F.col("base") + F.coalesce("more", F.lit(0))) / F.col("n")) * 100).alias("s"))
    return folds.groupBy(*by).agg(F.round(F.avg("s") * F.min("s"), 6).alias("score"))


def model_scores(models: DataFrame, cells: DataFrame, profiles: DataFrame, truth: DataFrame) -> DataFrame:
    """(model, score) of models (model, feature): a sample's class is that of the profile (feature, cls, value) with which its values
    (feature, sample, value) correlate best over the model's features; the score of a fold of truth (sample, cls, fold) is the sum over
    classes of the percentage found, for two classes sensitivity and specificity; a model's is the folds' mean times their smallest."""
    sums = models.join(_terms(cells, profiles), "feature").groupBy("model", "sample", "cls").agg(*(F.sum(c).alias(c) for c in _SUMS))
    hits = _hits(sums, ["model"], truth).groupBy("model", "fold", "own").agg(F.sum("hit").alias("more"))
    return _scored(models.select("model").distinct(), hits, ["model"], _sizes(truth))


def optimised(cells: DataFrame, profiles: DataFrame, truth: DataFrame, start: Iterable | None = None, rounds: int = 50, least: int = 3) -> DataFrame:
    """(round, action, feature, score): the changes, one a round, that raise the score of a model most, from the features in start (none
    given: all), until none does or rounds have passed. Round 0 is the start, its feature null.

    A change adds one feature that the model lacks or drops one that it has, least features always staying. All of a round's
    candidates are scored in one aggregation: a correlation is made of sums over features, so a candidate's are the model's,
    plus or minus its own terms. Ties go to a drop, then to the smaller feature. Scores: see model_scores."""
    terms = kept(_terms(cells, profiles))
    every = terms.select("feature").distinct()
    kind = dict(cells.dtypes)["feature"]
    spark = cells.sparkSession
    held = kept(every if start is None else every.join(spark.createDataFrame([(f,) for f in start], f"feature {kind}"), "feature"))
    sums = kept(terms.join(held, "feature").groupBy("sample", "cls").agg(*(F.sum(c).alias(c) for c in _SUMS)))
    hits = kept(_hits(sums, [], truth))
    sizes = _sizes(truth, hits)
    none = spark.createDataFrame([(1,)], "one int")
    best = _scored(none, none.select("one", F.lit(None).alias("fold"), F.lit(None).alias("own"), F.lit(0).alias("more")), ["one"], sizes).first()["score"]
    log = [(0, "start", None, best)]
    for turn in range(1, rounds + 1):
        n = held.count()
        marked = terms.join(held.withColumn("_in", F.lit(True)), "feature", "left")
        sign = F.when(F.col("_in"), -1.0).otherwise(1.0)
        some = marked.where("_in is null") if n <= least else marked
        base = sums.select("sample", "cls", *(F.col(c).alias(f"_{c}") for c in _SUMS))
        met = some.withColumn("_sign", sign).join(base, ["sample", "cls"], "left").select("feature", "_sign", "sample", "cls", *((F.coalesce(f"_{c}", F.lit(0.0)) + F.col("_sign") * F.col(c)).alias(c) for c in _SUMS))
        # samples that lack the feature are called as before
        by = ["feature", "_sign"]
        now = _hits(met, by, truth).join(hits.select("sample", F.col("hit").alias("_was")), "sample", "left")
        more = now.groupBy(*by, "fold", "own").agg(F.sum(F.col("hit") - F.coalesce("_was", F.lit(0))).alias("more"))
        top = _scored(some.select("feature", sign.alias("_sign")).distinct(), more, by, sizes).orderBy(F.col("score").desc(), "_sign", "feature").first()
        if top is None or top["score"] <= best:
            break
        best = top["score"]
        adds = top["_sign"] > 0
        log.append((turn, "add" if adds else "drop", top["feature"], best))
        one = every.where(F.col("feature") == F.lit(top["feature"]))
        after = kept(held.unionByName(one) if adds else held.join(one, "feature", "left_anti"))
        for x in (held, sums, hits):
            dropped(x)
        held = after
        sums = kept(terms.join(held, "feature").groupBy("sample", "cls").agg(*(F.sum(c).alias(c) for c in _SUMS)))
        hits = kept(_hits(sums, [], truth))
        sizes = _sizes(truth, hits)
    return spark.createDataFrame(log, f"round int, action string, feature {kind}, score double")
