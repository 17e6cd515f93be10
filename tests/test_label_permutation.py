"""Rounds of label permutation where a feature's values are, and by parts of the hashes' range."""

import random

import numpy as np
from pyspark.sql import functions as F

from assaylake.operators import draws, hypothesis


def test_hashes_are_sparks(spark):
    rng = random.Random(1)
    keys = [0, 1, -1, 1 << 33, -(1 << 63), *(rng.randrange(1 << 63) for _ in range(20))]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", *(F.xxhash64(F.lit(42), F.lit(r), F.lit("f")).alias(f"s{r}") for r in (1, 2)), *(F.xxhash64(F.lit(42), F.lit(r), F.lit("f"), "k").alias(f"h{r}") for r in (1, 2))).collect()
    got = draws.hashes(np.array([r.k for r in rows]), np.array([rows[0].s1, rows[0].s2]))
    assert got.tolist() == [[r.h1 for r in rows], [r.h2 for r in rows]]


def test_both_ways_draw_the_same(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f, rng.choice("RAN"), None if rng.random() < 0.05 else rng.random()) for f in range(5) for _ in range(30 * (f + 1))] + [(7, "R", 1.0), (8, "R", 1.0), (8, "A", 3.0), (None, "R", 2.0), (None, "A", 3.0)]
    m = spark.createDataFrame(rows, "feature long, grp string, value double").coalesce(1)
    found = lambda **kw: {r.feature: (r.diff, r.p) for r in hypothesis.label_permutation(m, "R", "A", 60, **kw).collect()}
    parts = found(whole=0)
    assert set(parts) == {0, 1, 2, 3, 4, 8} == set(found(whole=50))
    monkeypatch.setattr(draws, "_turned", None)  # nothing is turned by rounds where features are whole
    monkeypatch.setattr(hypothesis, "AT_ONCE", 100)
    whole = found()
    assert set(whole) == set(parts)
    for f, (diff, p) in parts.items():
        assert abs(whole[f][0] - diff) < 1e-9 and whole[f][1] == p
