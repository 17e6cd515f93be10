"""Linear models, step-down tests, median polish, factors, domains and draws against plain computations."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.functions import tails
from assaylake.operators import domains, draws, enrich, factors, hypothesis, linear, models, network

CELL = "feature long, sample long, value double"


def cells(spark, data):
    return spark.createDataFrame([(i, j, None if np.isnan(v) else float(v)) for i, row in enumerate(data) for j, v in enumerate(row)], CELL)


def test_contrasts(spark):
    rng = np.random.default_rng(1)
    design = np.column_stack([np.ones(12), [0] * 4 + [1] * 4 + [0] * 4, [0] * 8 + [1] * 4, rng.normal(size=12)])
    data = rng.normal(size=(30, 12)) + np.outer(rng.normal(size=30), design[:, 1])
    data[3, :5] = np.nan
    data[4, 4:8] = np.nan  # one coefficient can't be told
    data[5] = design @ [1.0, 2.0, 3.0, 0.5]
    x = spark.createDataFrame([(j, list(map(float, r))) for j, r in enumerate(design)], "sample long, x array<double>")
    names = {"b": [0, 1, 0, 0], "b-c": [0, 1, -1, 0]}
    got = {(r.feature, r.contrast): r for r in linear.contrasts(cells(spark, data), x, names).collect()}
    for i in range(30):
        ok = ~np.isnan(data[i])
        if np.linalg.matrix_rank(design[ok]) < 4:
            assert (i, "b") not in got
            continue
        beta, *_ = np.linalg.lstsq(design[ok], data[i, ok], rcond=None)
        rss, df = float(((data[i, ok] - design[ok] @ beta) ** 2).sum()), int(ok.sum()) - 4
        inverse = np.linalg.inv(design[ok].T @ design[ok])
        c = np.array(list(names.values()), float)
        for k, name in enumerate(names):
            r = got[i, name]
            assert r.estimate == pytest.approx(c[k] @ beta, abs=1e-8)
            if i == 5:
                assert r.t is None and r.p is None and r.f is None
                continue
            assert r.t == pytest.approx(c[k] @ beta / math.sqrt(rss / df * (c[k] @ inverse @ c[k])), abs=1e-7)
            f = (c @ beta) @ np.linalg.inv(c @ inverse @ c.T) @ (c @ beta) / 2 / (rss / df)
            assert r.f == pytest.approx(f, rel=1e-7)
            import pandas as pd

            assert r.f_p == pytest.approx(tails._fisher(pd.Series([f]), pd.Series([2.0]), pd.Series([float(df)]))[0], abs=1e-9)


def test_step_down(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(23, 9))
    data[0, :4] += 6
    data[1, :4] += 3
    data[22] = data[21]
    groups = spark.createDataFrame([(j, "a" if j < 4 else "b") for j in range(9)] + [(50, "c")], "sample long, grp string")
    got = {r.feature: r for r in linear.max_t(cells(spark, data).repartition(3), groups, "a", "b", 300, 5).collect()}
    sides = linear.relabellings(9, 4, 300, 5)

    def t(row, side):
        a, b = row[side], row[~side]
        return abs(a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b))

    d = np.array([[t(row, s) for s in sides] for row in data])
    order = sorted(range(23), key=lambda i: (-d[i, 0], i))
    before = 0.0
    for k, i in enumerate(order):
        u = d[order[k:]].max(axis=0)
        before = max(before, float((u >= d[i, 0] * (1 - 1e-12)).mean()))
        assert got[i].t == pytest.approx(d[i, 0]) and got[i].p == pytest.approx((d[i] >= d[i, 0] * (1 - 1e-12)).mean()) and got[i].adjusted == pytest.approx(before)
    assert got[0].adjusted < 0.05 < got[15].adjusted
    assert linear.max_t(cells(spark, data), groups, "a", "c", 10).count() == 0


def test_polish(spark):
    rng = np.random.default_rng(3)
    tables = {g: rng.normal(size=(5 + g, 6)) + np.arange(6) for g in range(3)}
    rows = [(g, i, j, float(v)) for g, t in tables.items() for i, r in enumerate(t) for j, v in enumerate(r)]
    df = spark.createDataFrame([*rows, (0, 0, 0, None)], "g long, row long, col long, value double")
    got = {(r.g, r.row, r.col): r for r in linear.median_polish(df, ["g"], 6, -1.0).collect()}
    for g, t in tables.items():
        z, m, a, b = t.copy(), 0.0, np.zeros(len(t)), np.zeros(6)
        for _ in range(6):
            d = np.median(z, axis=1)
            z, a = z - d[:, None], a + d
            level = np.median(b)
            b, m = b - level, m + level
            d = np.median(z, axis=0)
            z, b = z - d, b + d
            level = np.median(a)
            a, m = a - level, m + level
        for i, j in itertools.product(range(len(t)), range(6)):
            r = got[g, i, j]
            assert (r.residual, r.overall, r.row_effect, r.col_effect) == pytest.approx((z[i, j], m, a[i], b[j]), abs=1e-9)


def plain_nnls(gram, right):
    best = None
    for mask in itertools.product((False, True), repeat=len(gram)):
        m, h = np.array(mask), np.zeros(len(gram))
        if m.any():
            h[m] = np.linalg.lstsq(gram[np.ix_(m, m)], right[m], rcond=None)[0]
        if (h >= -1e-12).all():
            v = h @ gram @ h / 2 - h @ right
            best = (v, h) if best is None or v < best[0] - 1e-12 else best
    return best[0]


def test_non_negative_squares():
    rng = np.random.default_rng(4)
    for k in (1, 2, 4):
        a = rng.normal(size=(8, k))
        gram, right = a.T @ a + 0.01 * np.eye(k), rng.normal(size=(60, k)) * 3
        h = factors.non_negative(gram, right)
        assert (h >= 0).all()
        for x, r in zip(h, right, strict=True):
            assert x @ gram @ x / 2 - x @ r == pytest.approx(plain_nnls(gram, r), abs=1e-9)


def test_sparse_factors(spark):
    rng = np.random.default_rng(5)
    w, h = np.zeros((40, 3)), np.zeros((3, 25))
    for i in range(40):
        w[i, i % 3] = rng.uniform(1, 3)
    for j in range(25):
        h[j % 3, j] = rng.uniform(1, 3)
    data = w @ h + rng.uniform(0, 0.2, (40, 25))
    ws, hs, seen = factors.sparse_nmf(cells(spark, data), 3, rounds=3)
    assert all(b <= a + 1e-7 * a for a, b in zip(seen, seen[1:], strict=False))
    got_w = np.array([r.f for r in ws.orderBy("feature").collect()])
    got_h = np.array([r.f for r in hs.orderBy("sample").collect()]).T
    eta = data.max()
    plain = 0.5 * ((data - got_w @ got_h) ** 2).sum() + eta / 2 * (got_w**2).sum() + 0.01 / 2 * (got_h.sum(axis=0) ** 2).sum()
    assert seen[-1] == pytest.approx(plain, rel=1e-9)
    # the same halves of a round, plainly
    g = got_w.T @ got_w + 0.01 * np.ones((3, 3))
    again = factors.non_negative(g, data.T @ got_w)
    _, _, more = factors.sparse_nmf(cells(spark, data), 3, rounds=4)
    g2 = again.T @ again + eta * np.eye(3)
    w2 = factors.non_negative(g2, data @ again)
    assert more[-1] == pytest.approx(0.5 * ((data - w2 @ again.T) ** 2).sum() + eta / 2 * (w2**2).sum() + 0.01 / 2 * (again.sum(axis=1) ** 2).sum(), rel=1e-7)
    kinds = {}
    for r in factors.assigned(hs, "sample").collect():
        kinds.setdefault(r["sample"] % 3, set()).add(r.cluster)
    assert all(len(v) == 1 for v in kinds.values()) and len(set.union(*kinds.values())) == 3


def test_independent_components(spark):
    rng = np.random.default_rng(6)
    n = 4000
    s = np.column_stack([rng.uniform(-1, 1, n), np.sign(rng.normal(size=n)), rng.laplace(size=n)])
    x = s @ rng.normal(size=(3, 5)) + [1, 2, 3, 4, 5]
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)] + [(n, None)], "k long, v array<double>").repartition(3)
    got = np.array([r.sources for r in factors.independent(df, "k", "v", 3).orderBy("k").collect()])
    c = np.abs(np.corrcoef(got.T, s.T)[:3, 3:])
    assert got.shape == (n, 3) and (c.max(axis=0) > 0.99).all() and (c.max(axis=1) > 0.99).all()
    with pytest.raises(ValueError, match="fewer"):
        factors.independent(df, "k", "v", 4)


def test_domains(spark):
    rng = random.Random(7)
    exons, bases = [], {}
    for t in range(12):
        strand, at, own = "+-"[t % 2], 100 + t * 1000, []
        for _ in range(rng.randint(1, 4)):
            n = rng.randint(1, 40)
            exons.append((f"t{t}", "1", strand, at, at + n - 1))
            own += range(at, at + n)
            at += n + rng.randint(1, 30)
        bases[f"t{t}"] = own if strand == "+" else own[::-1]
    found = [(f"d{i}", f"t{i % 12}", f"g{i % 12}", a := rng.randint(1, 15), a + rng.randint(0, 12)) for i in range(40)]
    regions = [(f"r{i}", f"g{i % 12}", "1", s := 100 + i % 12 * 1000 + rng.randint(0, 100), s + rng.randint(0, 60), bool(i % 2)) for i in range(50)]
    es = spark.createDataFrame(exons, "transcript string, chrom string, strand string, start long, end long")
    fs = spark.createDataFrame(found, "feature string, transcript string, gene string, from_residue long, to_residue long")
    rs = spark.createDataFrame(regions, "region string, gene string, chrom string, start long, end long, spliced_out boolean")
    want = {}
    for f, t, g, a, b in found:
        own = set(bases[t][(a - 1) * 3 : b * 3])
        for r, rg, _, s, e, _ in regions:
            if rg == g and (n := len(own & set(range(s, e + 1)))):
                want[r, f] = n
    on = domains.on_regions(fs, es, rs, 16)
    assert {(r.region, r.feature): r.bases for r in on.collect()} == want
    out = {r[0]: r[5] for r in regions}
    lost = {f: sum(n for (r, x), n in want.items() if x == f and out[r]) for f in {x for _, x in want}}
    assert {r.feature: r.lost for r in domains.changed(on, rs).collect()} == {f: n for f, n in lost.items() if n}


def test_draws(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    sizes = spark.createDataFrame([(0, 10), (1, 200), (2, 0)], "g long, n long")
    got = draws.drawn(rows, ["g"], F.col("k"), sizes, "n", 20, 1)
    assert {(r.g, r["_round"]): r["count"] for r in got.groupBy("g", "_round").count().collect()} == {(g, i): n for g, n in ((0, 10), (1, 200)) for i in range(1, 21)}
    assert got.groupBy("k").count().count() > 400 and got.groupBy("k", "_round").count().where("count > 1").count() == 0
    sums = draws.sums(rows, ["g"], F.col("k"), sizes, "n", "v", 20, 1)
    plain = got.groupBy("g", "_round").agg(F.sum("v").alias("s"))
    assert {(r.g, r["_round"]): r["_sum"] for r in sums.collect()} == {(r.g, r["_round"]): r.s for r in plain.collect()}
    order = draws._turned(rows, [], F.col("k"), 3, 9).where("_round = 2").orderBy("_h", "k").limit(37)
    assert {r.k for r in order.collect()} == {r.k for r in draws.drawn(rows, [], F.col("k"), spark.createDataFrame([(37,)], "n long"), "n", 3, 9).where("_round = 2").collect()}


def test_set_permutation(spark):
    every = spark.createDataFrame([(f"e{i}",) for i in range(300)], "element string")
    hit = every.where(F.substring("element", 2, 3).cast("int") < 40)
    members = spark.createDataFrame([("in", f"e{i}") for i in range(30)] + [("mixed", f"e{i}") for i in range(0, 300, 5)], "gene_set string, element string")
    got = {r.gene_set: r for r in enrich.permuted(every, hit, members, 400).collect()}
    # of 40 of 300, how often are 60 elements hit as far from 8 as they are
    rng, n = np.random.default_rng(1), 20000
    away = np.abs(rng.hypergeometric(60, 240, 40, n) - 8)
    assert got["in"].p == 0.0 and abs(got["mixed"].p - (away >= abs(got["mixed"].r - 8)).mean()) < 0.08


def test_moderated_unequal_variances(spark):
    rng = np.random.default_rng(9)
    rows = [(i, g, float(rng.normal((i == 0) * 9 * (g == "R"), 1 + (g == "A")))) for i in range(50) for g, n in (("R", 6), ("A", 9)) for _ in range(n)]
    m = spark.createDataFrame(rows, "feature long, grp string, value double")
    got = {r.feature: r for r in hypothesis.moderated_welch(m, "R", "A").collect()}
    assert len(got) == 50 and got[0].p == min(r.p for r in got.values()) < 1e-3
    own = {f: {g: np.array([v for a, b, v in rows if (a, b) == (f, g)]) for g in "RA"} for f in range(50)}
    shares = [abs(got[f].t) / abs((x["R"].mean() - x["A"].mean()) / math.sqrt(x["R"].var(ddof=1) / 6 + x["A"].var(ddof=1) / 9)) for f, x in own.items()]
    assert 0.4 < min(shares) and max(shares) < 2.5 and np.median(shares) == pytest.approx(1, abs=0.2)


def test_page_rank(spark):
    rng = random.Random(3)
    edges = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(120)) if a != b}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    rank = dict.fromkeys(near, 1 / len(near))
    for _ in range(20):
        rank = {x: 0.15 / len(near) + 0.85 * sum(rank[y] / len(near[y]) for y in near[x]) for x in near}
    got = {r.node: r["rank"] for r in network.page_rank(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert got.keys() == rank.keys() and all(got[x] == pytest.approx(rank[x], abs=1e-9) for x in rank)


def test_clusters_and_labels(spark):
    rng = np.random.default_rng(12)
    rows = [(i, list(map(float, rng.normal(size=3) + 12 * (i % 3))), i % 3 if i < 30 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, v array<double>, label int")
    found = {}
    for r in models.k_means(df, "k", "v", 3).collect():
        found.setdefault(r.k % 3, set()).add(r.cluster)
    assert sorted(min(v) for v in found.values()) == [1, 2, 3] and all(len(v) == 1 for v in found.values())
    got = {r.k: r.label for r in models.expand_labels(df, "k", "v", "label").collect()}
    assert got == {i: i % 3 for i in range(30, 90)}


def test_first_kept_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(1000, 1001), (1001, 1002)], "a long, b long")
    nodes = spark.range(401).withColumnRenamed("id", "node").unionByName(spark.range(1000, 1003).withColumnRenamed("id", "node"))
    got = sorted(r.node for r in network.first_kept(nodes, edges).collect())
    assert got == [*range(0, 401, 2), 1000, 1002]


def test_first_kept_of_many_edges_asks_for_no_components(spark, monkeypatch):
    rng = np.random.default_rng(4)
    edges = [(a, b) for a in range(150) for b in range(a) if rng.random() < 0.3]
    has, stay = set(edges), []
    for x in range(150):
        if not any((x, y) in has for y in stay):
            stay.append(x)

    def refused(*_):
        raise AssertionError("components of all edges")

    monkeypatch.setattr(network, "components", refused)
    # edges that repeat, and one to what is no node
    got = network.first_kept(spark.range(150).withColumnRenamed("id", "node"), spark.createDataFrame(edges + edges[:9] + [(-1, 0)], "a long, b long"))
    assert sorted(r.node for r in got.collect()) == stay


def test_shared_neighbours_are_dealt_by_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(network, "PAIRS", 40)
    rows = [(s, p) for p in range(20) for s in range(p % 7 + 3)] * 2 + [(None, 1), (1, None)]
    want = {}
    for p in range(20):
        for a, b in itertools.combinations(range(p % 7 + 3), 2):
            want[a, b] = want.get((a, b), 0) + 1
    got = network.shared_neighbours(spark.createDataFrame(rows, "s long, p long"), "s", "p")
    assert {(r.a, r.b): r.shared for r in got.collect()} == want
    assert got.rdd.getNumPartitions() >= sum(want.values()) // 40


def test_no_drawn_table_is_broadcast(spark):
    """What the rounds draw is many times its rows, which an estimate doesn't know: only limits, a row for each round, are broadcast."""
    every = spark.range(20000).select(F.col("id").alias("element"))
    members = every.select("element", (F.col("element") % 5).cast("string").alias("gene_set"))
    plan = enrich.permuted(every, every.where("element % 40 = 0"), members, 50)._jdf.queryExecution().optimizedPlan().toString()
    edges = every.select(F.col("element").alias("a"), (F.col("element") * 7 % 20000).alias("b"))
    nodes = every.withColumnRenamed("element", "node")
    for text in (plan, network.edge_permutation(edges, nodes, nodes.where("node % 9 = 0"), 50)._jdf.queryExecution().optimizedPlan().toString()):
        joins = [x for x in text.splitlines() if "Join Inner" in x and "_most" in x]
        assert joins and all("rightHint=(strategy=broadcast)" in x for x in joins)
    own = {r["_round"]: r.n for r in draws.drawn(every, [], F.col("element"), spark.createDataFrame([(77,)], "n long"), "n", 30, 1).groupBy("_round").agg(F.count("*").alias("n")).collect()}
    assert own == {i: 77 for i in range(1, 31)}
