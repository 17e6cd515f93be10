"""Marks of min-hashes in the join by rarest shingles, and SimHash in the pipeline's near-dedup."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from assaylake.llm import near, setsketch, simhash

RNG = np.random.default_rng(3)


def frame(spark, sets, marks):
    rows = [(i, near.parities(s).tolist(), m.tolist(), s.view(np.int64).tolist()) for i, (s, m) in enumerate(zip(sets, marks, strict=True))]
    return spark.createDataFrame(rows, "node long, odd array<long>, marks array<long>, hashes array<long>")


def test_chance_makes_no_pairs(spark):
    common = RNG.integers(0, 1 << 63, 600, np.uint64)
    sets = [np.unique(np.concatenate([common, RNG.integers(0, 1 << 63, 2400, np.uint64)])) for _ in range(40)]
    sets += [np.unique(np.concatenate([sets[0][:2800], RNG.integers(0, 1 << 63, 200, np.uint64)]))]
    for marks in ([near.marks(near.min_hashes(s)) for s in sets], [near.marks(setsketch.sketch(s)) for s in sets]):
        x = frame(spark, sets, marks)
        # places at the widest: neither they nor the parities of so large sets rule a pair out
        place = x.selectExpr("node", "size(hashes) AS n", f"{common[0].view(np.int64)} AS h", "3000 AS before", "3000 AS after", "node AS root")
        assert [tuple(r) for r in near.across(place, x, 0.8).collect()] == [(0, 40)]


def test_marks_lose_no_similar_pair():
    assert 12 < near.most_marks(0.9) < near.most_marks(0.8) < 44
    for n in (12, 100, 3000):
        for _ in range(200):
            own = RNG.integers(0, 1 << 63, n, np.uint64)
            other = np.concatenate([own[n // 9 :], RNG.integers(0, 1 << 63, n // 9, np.uint64)])
            for f in (near.min_hashes, setsketch.sketch):
                differ = np.bitwise_count(near.marks(f(own)).view(np.uint64) ^ near.marks(f(other)).view(np.uint64)).sum()
                assert differ <= near.most_marks(0.8)


def test_near_copies_by_fingerprint(spark, monkeypatch):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(500)}" for _ in range(400)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    texts += [" ".join([*b[:k], "new", *b[k + 1 :]]) for b in base for k in (50, 200, 350)]
    fps = [simhash.fingerprint(t, 5) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = near.signatures(docs, "doc_id").selectExpr("doc_id AS node", "fp")
    first = {f: fps.index(f) for f in fps}
    want = {(first[f], i) for i, f in enumerate(fps) if first[f] != i}
    want |= {tuple(sorted((first[f], first[g]))) for f, g in itertools.combinations(first, 2) if (f ^ g).bit_count() <= 2}
    assert want and {tuple(r) for r in near.fingerprint_pairs(nodes).collect()} == want
    found = []
    monkeypatch.setattr(near, "band_keys", lambda least: np.zeros(0, np.int64))
    monkeypatch.setattr(near, "across", lambda place, bits, least: found.append(1) or place.selectExpr("node AS a", "node AS b").limit(0))
    got = {r.doc_id: r.component for r in near.near_copies(docs, "doc_id").collect()}
    for a, b in want:
        sa, sb = (set(near.shingle_set(texts[i]).tolist()) for i in (a, b))
        assert len(sa & sb) < 0.8 * len(sa | sb) or got[a] == got[b]
    assert found and any(i != c for i, c in got.items())


def test_a_pair_has_one_row(spark, monkeypatch):
    made = []
    common, sets = RNG.integers(0, 1 << 63, 400, np.uint64), []
    for _ in range(24):  # any two share more than three quarters; the last two are links of the first
        sets.append(np.unique(np.concatenate([RNG.permutation(common)[:372], RNG.integers(0, 1 << 63, 20, np.uint64)])))
    sets += [np.unique(np.concatenate([sets[0][k:], RNG.integers(0, 1 << 63, k, np.uint64)])) for k in (10, 30)]
    x = frame(spark, sets, [near.marks(near.min_hashes(s)) for s in sets])
    place = near.keep(near.prefixes(x, 0.8).withColumn("root", F.col("node")))
    met = near.across(place, x, 0.8)
    similar = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if similar(a, b)}
    assert {(0, 24), (0, 25)} <= want <= {tuple(r) for r in met.collect()}
    # rows of the join itself, before they are made distinct
    monkeypatch.setattr(DataFrame, "distinct", lambda self: made.append(self.count()) or self)
    near.across(place, x, 0.8)
    assert made[0] <= 2 * len(sets) * (len(sets) - 1) // 2
