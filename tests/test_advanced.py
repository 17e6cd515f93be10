"""Models and permutations without SQL, against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.functions import tails
from assaylake.operators import hypothesis, models, network, profiles, stats


def test_tails_at_known_points(spark):
    r = spark.range(1).select(
        tails.normal_two_sided(F.lit(1.959963984540054)).alias("z"), tails.normal_two_sided(F.lit(6.0)).alias("far"), tails.chi_square_tail(F.lit(3.841458820694124), F.lit(1.0)).alias("c1"),
        tails.chi_square_tail(F.lit(10.0), F.lit(4.0)).alias("c4"), tails.f_tail(F.lit(4.0), F.lit(2.0), F.lit(10.0)).alias("f"), tails.t_two_sided(F.lit(0.01), F.lit(1e10)).alias("t"), tails.kolmogorov_tail(F.lit(1.0)).alias("k"),
    ).first()
    assert r.z == pytest.approx(0.05, abs=1e-9) and r.far == pytest.approx(1.973175290075e-9, rel=1e-6) and r.c1 == pytest.approx(0.05, abs=1e-9)
    assert r.c4 == pytest.approx(math.exp(-5) * 6, abs=1e-9) and r.f == pytest.approx((1 + 2 * 4 / 10) ** -5, abs=1e-9)
    assert r.t == pytest.approx(0.992021, abs=1e-6) and r.k == pytest.approx(0.2699996717, abs=1e-8)


def shrunk(data, batches, conv=1e-12):
    """Location and scale by batch, shrunk to what they are over all features: features in rows."""
    names = sorted(set(batches))
    at = {b: [i for i, x in enumerate(batches) if x == b] for b in names}
    grand = data.mean(axis=1)
    away = np.concatenate([data[:, at[b]] - data[:, at[b]].mean(axis=1, keepdims=True) for b in names], axis=1)
    sd = np.sqrt((away**2).mean(axis=1))
    s = (data - grand[:, None]) / sd[:, None]
    out = s.copy()
    for b in names:
        x = s[:, at[b]]
        n, g, d = x.shape[1], x.mean(axis=1), x.var(axis=1, ddof=1)
        m, v = d.mean(), d.var(ddof=1)
        a, bb, bar, t2 = (2 * v + m * m) / v, (m * v + m**3) / v, g.mean(), g.var(ddof=1)
        scale = d
        for _ in range(1000):
            loc = (t2 * n * g + scale * bar) / (t2 * n + scale)
            new = (0.5 * ((x - loc[:, None]) ** 2).sum(axis=1) + bb) / (n / 2 + a - 1)
            done, scale = abs(new - scale).max() < conv, new
            if done:
                break
        out[:, at[b]] = (x - loc[:, None]) / np.sqrt(scale)[:, None]
    return out * sd[:, None] + grand[:, None]


def test_combat(spark):
    rng = np.random.default_rng(2)
    batches = ["a"] * 6 + ["b"] * 5 + ["c"] * 7
    data = rng.normal(size=(40, 18)) * rng.uniform(0.5, 2, (40, 1)) + rng.normal(size=(40, 1)) * 3
    data[:, :6] += 2
    data[:, 11:] *= 1.7
    want = shrunk(data, batches)
    rows = [(f, batches[j], j, float(data[f, j])) for f in range(40) for j in range(18)] + [(99, "a", 0, 1.0), (99, "b", 6, 1.0)]
    got = {(r.feature, r["sample"]): r.value for r in models.combat(spark.createDataFrame(rows, "feature long, batch string, sample long, value double")).collect()}
    assert all(got[f, j] == pytest.approx(want[f, j], abs=1e-6) for f in range(40) for j in range(18)) and got[99, 0] == 1.0


def test_rank_estimate(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(400, 12)) + (rng.normal(size=(400, 3)) * 6) @ rng.normal(size=(3, 12))
    x = spark.createDataFrame([(list(map(float, r)),) for r in data], "v array<double>")
    s = (data - data.mean(axis=0)) / data.std(axis=0)
    one, p = math.sqrt(399), math.sqrt(12)
    bound = 3.273 * (one + p) * (1 / one + 1 / p) ** (1 / 3) + (one + p) ** 2
    assert models.rank_estimate(x, "v") == int((np.linalg.eigvalsh(s.T @ s) > bound).sum()) >= 1
    assert models.rank_estimate(x.where("false"), "v") == 0


def test_factors_are_not_negative_and_fit(spark):
    rng = np.random.default_rng(4)
    data = rng.uniform(0, 1, (30, 2)) @ rng.uniform(0, 1, (2, 8))
    cells = spark.createDataFrame([(i, j, float(data[i, j])) for i in range(30) for j in range(8)], "feature long, sample long, value double")
    away = []
    for rounds in (2, 25):
        h = np.zeros((2, 8))
        for r in models.nmf(cells, 2, rounds).collect():
            h[r.k, r["sample"]] = r.weight
        assert (h >= 0).all()
        w = np.linalg.lstsq(h.T, data.T, rcond=None)[0].T
        away.append(float(np.sqrt(((w @ h - data) ** 2).mean())))
    assert away[1] < away[0] and away[1] < 0.1


def test_permutations(spark):
    rng = random.Random(5)
    rows = [("far", g, v) for g, at in (("R", 0), ("A", 9)) for v in [at + rng.random() for _ in range(8)]] + [("near", g, rng.random()) for g in "RA" for _ in range(8)]
    got = {r.feature: r.p for r in hypothesis.label_permutation(spark.createDataFrame(rows, "feature string, grp string, value double"), "R", "A", 200).collect()}
    assert got["far"] <= 0.01 < 0.03 < got["near"] <= 1
    edges = [(i, j) for i in range(8) for j in range(i + 1, 8)] + [(i, i + 1) for i in range(8, 60)]
    nodes = spark.createDataFrame([(i,) for i in range(61)], "node long")
    r = network.edge_permutation(spark.createDataFrame(edges, "a long, b long"), nodes, nodes.where("node < 8"), 100).first()
    assert r.edges == 28 and r.p <= 0.01


def test_comparison_dispatch(spark):
    rows = [("one", "R", 1.0), ("one", "A", 2.0), ("one", "A", 3.0), ("flat", "R", 1.0), ("flat", "R", 1.0), ("flat", "A", 1.0), ("flat", "A", 1.0), ("gone", "R", 1.0)] + [("far", g, at + i / 10) for g, at in (("R", 0), ("A", 5)) for i in range(6)]
    m = spark.createDataFrame(rows, "feature string, grp string, value double")
    for test in hypothesis.TESTS:
        got = {r.feature: r.p for r in hypothesis.compare(m, "R", "A", test).collect()}
        assert set(got) == {"one", "flat", "far"} and got["one"] == 1.0 and got["far"] < 0.05, test
    with pytest.raises(ValueError, match="no such test"):
        hypothesis.compare(m, "R", "A", "other")


def test_untested_comparison_calls_by_fold(spark):
    f = spark.createDataFrame([("a", 2.0, 1.0), ("b", -2.0, 1.0), ("c", 0.1, 1.0)], "feature string, log_fold double, p double")
    assert {r.feature: r.call for r in stats.criterion(f, 1.0, 0.05).collect()} == {"a": "up", "b": "down", "c": "none"}
    some = f.unionByName(spark.createDataFrame([("d", 3.0, 0.01)], f.schema))
    assert {r.feature: r.call for r in stats.criterion(some, 1.0, 0.05).collect()} == {"a": "none", "b": "none", "c": "none", "d": "up"}


def test_first_kept(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(i, i + 1) for i in range(60, 75)]
    stay = []
    for x in range(80):
        if not any((a == x and b in stay) or (b == x and a in stay) for a, b in edges):
            stay.append(x)
    nodes = spark.createDataFrame([(x,) for x in range(80)], "node long")
    got = network.first_kept(nodes, spark.createDataFrame(edges, "a long, b long"))
    assert sorted(r.node for r in got.collect()) == stay


def test_correlations_of_what_does_not_vary(spark):
    """A feature in one group only, one value only, two pairs only, or a perfect one: null or 0, and no error."""
    rows = [("one", "R", 1.0), ("one", "R", 2.0), ("one", "R", 3.0)] + [("flat", g, 0.1) for g in "RARA"] + [("few", "R", 1.0), ("few", "R", 2.0)] + [("whole", g, v) for g, v in zip("RARA", (1.0, 2.0, 1.0, 2.0))]
    m = spark.createDataFrame(rows, "feature string, grp string, value double")
    got = {r.feature: (r.r, r.p) for r in hypothesis.point_biserial(m, "R", "A").collect()}
    assert got["one"] == got["flat"] == (None, None) and "few" not in got and got["whole"] == (pytest.approx(1.0), pytest.approx(0.0, abs=1e-6))
    xy = spark.createDataFrame([("x", 1.0, float(i)) for i in range(4)] + [("y", float(i), 2.0) for i in range(4)], "feature string, x double, y double")
    for test in (hypothesis.pearson, hypothesis.spearman):
        assert {tuple(r)[1:] for r in test(xy).collect()} == {(None, None)}
    long = spark.createDataFrame([(f, s, v) for f, x in (("a", [1.0, 1.0, 1.0]), ("b", [1.0, 2.0, 3.0]), ("c", [3.0, 2.0, 1.0])) for s, v in enumerate(x)], "feature string, sample int, value double")
    assert {(r.a, r.b): r.r for r in stats.correlate_pairs(long, 3).collect()} == {("a", "b"): None, ("a", "c"): None, ("b", "c"): pytest.approx(-1.0)}


def test_fisher_of_any_counts(spark):
    """Against plain sums over all counts, and with counts for which a list of all wouldn't do."""
    rng = random.Random(3)
    rows = [(a, b, c, d) for d in (1, 7, 40, 300) for _ in range(40) for c in [rng.randint(0, d)] for b in [rng.randint(0, d)] for a in [rng.randint(max(0, b + c - d), min(b, c))]]
    ln = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    for r in hypothesis.fisher_two_sided(spark.createDataFrame(rows, "r long, n long, tr long, tn long")).collect():
        every = [ln(r.tr, k) + ln(r.tn - r.tr, r.n - k) - ln(r.tn, r.n) for k in range(max(0, r.n + r.tr - r.tn), min(r.n, r.tr) + 1)]
        at = ln(r.tr, r.r) + ln(r.tn - r.tr, r.n - r.r) - ln(r.tn, r.n)
        assert r.p == pytest.approx(min(sum(math.exp(x) for x in every if x <= at + 1e-7), 1.0), abs=1e-9)
    large = [(1_000_000_000, 2_000_000_000, 2_000_000_000, 4_000_000_000), (1_000_020_000, 2_000_000_000, 2_000_000_000, 4_000_000_000)]
    whole, far = (r.p for r in hypothesis.fisher_two_sided(spark.createDataFrame(large, "r long, n long, tr long, tn long")).orderBy("r").collect())
    deviation = math.sqrt(2e9 * 0.25 * 0.5)
    assert whole == 1.0 and far == pytest.approx(math.erfc(19_999.5 / deviation / math.sqrt(2)), rel=0.01)


def test_correlations_by_blocks(spark, monkeypatch):
    """Blocks of few features against plain pairs: missing samples, nulls, values far from 0, no variance in what is shared."""
    rng = random.Random(2)
    rows = [(f"f{i}", f"s{j}", None if rng.random() < 0.1 else 1e6 + (1.0 if i % 5 == 0 and j < 6 else rng.gauss(0, 1))) for i in range(40) for j in range(12) if rng.random() < 0.7]
    monkeypatch.setattr(stats, "BLOCK", 7)
    m = spark.createDataFrame(rows, "feature string, sample string, value double")
    got = {(r.a, r.b): r.r for r in stats.correlate_pairs(m, 3).collect()}
    values: dict = {}
    for f, s, v in rows:
        values.setdefault(f, {})[s] = v
    want = {}
    for a, b in ((a, b) for a in values for b in values if a < b and len(values[a].keys() & values[b].keys()) >= 3):
        xy = np.array([(values[a][s] - 1e6, values[b][s] - 1e6) for s in values[a].keys() & values[b].keys() if values[a][s] is not None and values[b][s] is not None]).reshape(-1, 2)
        want[a, b] = np.corrcoef(xy.T)[0, 1] if len(xy) > 1 and (np.ptp(xy, axis=0) > 0).all() else None
    assert set(got) == set(want) and len(want) > 600
    for k, r in want.items():
        assert got[k] is None if r is None else got[k] == pytest.approx(r, abs=1e-7), k


def test_profiles_are_sent_to_the_features(spark):
    """Rows of feature, profile and sample are summed where they are made: no exchange lies above the join with the profiles."""
    m = spark.range(20000).select((F.col("id") % 500).alias("feature"), (F.col("id") % 7).alias("sample"), F.rand(1).alias("value"))
    names = spark.range(500).select(F.col("id").alias("feature"), (F.col("id") % 5).alias("name"))
    few = m.groupBy((F.col("feature") % 5).alias("feature"), "sample").agg(F.avg("value").alias("value"))
    for found in (profiles.depleted(m, names, 0.4), profiles.best_regulator(m, few, 0.1, 3)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("BroadcastHashJoin [sample")]
