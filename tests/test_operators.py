"""Operators without SQL, against plain computations and known values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from assaylake.functions import tails
from assaylake.operators import filters, hypothesis, models, network


def test_digamma_series(spark):
    r = spark.range(1).select(tails.digamma(F.lit(1.0)).alias("d"), tails.trigamma(F.lit(1.0)).alias("t"), tails.digamma(F.lit(0.5)).alias("h")).first()
    assert r.d == pytest.approx(-0.5772156649, abs=1e-9) and r.t == pytest.approx(math.pi**2 / 6, abs=1e-9)
    assert r.h == pytest.approx(-0.5772156649 - 2 * math.log(2), abs=1e-9)
    assert tails.trigamma_inverse(math.pi**2 / 6) == pytest.approx(1.0, abs=1e-8)


def test_fisher_by_enumeration(spark):
    cases = [(3, 10, 5, 40), (0, 5, 5, 10), (5, 5, 5, 10), (7, 12, 20, 31), (0, 0, 0, 9)]
    got = hypothesis.fisher_two_sided(spark.createDataFrame(cases, "r long, n long, tr long, tn long")).collect()
    for row in got:
        chance = lambda k: math.comb(row.tr, k) * math.comb(row.tn - row.tr, row.n - k) / math.comb(row.tn, row.n)  # noqa: B023, E731
        low, high = max(0, row.n + row.tr - row.tn), min(row.n, row.tr)
        assert row.p == pytest.approx(min(1.0, sum(chance(k) for k in range(low, high + 1) if chance(k) <= chance(row.r) * (1 + 1e-7))), abs=1e-9)


def test_moderated_t_shrinks_to_the_common_variance(spark):
    rng = random.Random(7)
    rows = [(f, g, rng.gauss(0, 1)) for f in range(300) for g in "RA" for _ in range(4)]
    m = spark.createDataFrame(rows, "feature long, grp string, value double")
    got = hypothesis.moderated_t(m, "R", "A").collect()
    assert len(got) == 300 and all(r.df > 6 and 0 <= r.p <= 1 for r in got)
    assert 0.01 < sum(r.p < 0.05 for r in got) / 300 < 0.1


def test_components_by_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)] + [(500, 500)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = network.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in list(parent)}
    assert network.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_adaptive_threshold(spark):
    rows = [(f, s, float(f * s)) for f in range(40) for s in range(6)]
    kept, k, fold = filters.widen(spark.createDataFrame(rows, "feature long, sample long, value double"), 2, 4.0, 30, 5)
    assert 5 <= kept.count() <= 30 and k > 2 and fold > 4.0


def test_dispersion_curve(spark):
    points = spark.createDataFrame([(x, 2.0 - x + 0.5 * x * x) for x in (0.0, 1.0, 2.0, 5.0)], "x double, y double")
    assert models.dispersion_curve(points, "x", "y") == pytest.approx((2.0, -1.0, 0.5), abs=1e-6)


def test_singular_directions(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1), 3 * rng.gauss(0, 1), 0.1 * rng.gauss(0, 1)]) for i in range(200)]
    got = models.components(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 2).collect()
    by = dict(rows)
    r = sum(x.scores[0] * by[x.id][1] for x in got) / math.sqrt(sum(x.scores[0] ** 2 for x in got) * sum(v[1] ** 2 for v in by.values()))
    assert r > 0.99
