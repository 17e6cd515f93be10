"""Models of features against a plain loop."""

import random

import numpy as np
import pytest

from assaylake.operators import gene_models


def plain_score(model, cells, profiles, truth):
    folds = {}
    for sample, (own, fold) in truth.items():
        best = None
        for cls in sorted({c for _, c in profiles}):
            pairs = [(cells[f, sample], profiles[f, cls]) for f in model if (f, sample) in cells and (f, cls) in profiles]
            if len(pairs) < 2:
                continue
            x, y = np.array(pairs).T
            if x.std() < 1e-6 or y.std() < 1e-6:
                continue
            r = round(float(np.corrcoef(x, y)[0, 1]), 12)
            if best is None or r > best[0]:
                best = (r, cls)
        folds.setdefault(fold, {}).setdefault(own, []).append(best is not None and best[1] == own)
    s = [100 * sum(sum(v) / len(v) for v in by.values()) for by in folds.values()]
    return round(sum(s) / len(s) * min(s), 6)


def test_models(spark):
    rng, np_rng = random.Random(4), np.random.default_rng(4)
    profiles = {(f"f{i}", c): float(np_rng.normal()) for i in range(9) for c in ("x", "y", "z")}
    truth = {j: ("xyz"[j % 3], j // 3 % 2) for j in range(24)}
    cells = {(f"f{i}", j): profiles[f"f{i}", truth[j][0]] * (i < 5) + float(np_rng.normal()) for i in range(9) for j in truth if rng.random() > 0.05}
    frames = [spark.createDataFrame([(*k, v) for k, v in t.items()], s) for t, s in ((cells, "feature string, sample long, value double"), (profiles, "feature string, cls string, value double"))]
    truths = spark.createDataFrame([(j, c, f) for j, (c, f) in truth.items()], "sample long, cls string, fold int")
    models = {m: rng.sample([f"f{i}" for i in range(9)], rng.randint(2, 8)) for m in range(6)}
    ms = spark.createDataFrame([(m, f) for m, fs in models.items() for f in fs], "model long, feature string")
    got = {r.model: r.score for r in gene_models.model_scores(ms, *frames, truths).collect()}
    assert got == {m: pytest.approx(plain_score(fs, cells, profiles, truth), abs=1e-4) for m, fs in models.items()}
    start = ["f0", "f6", "f7", "f8"]
    model, log = set(start), [("start", None, plain_score(start, cells, profiles, truth))]
    while True:
        options = [(-plain_score(model - {f}, cells, profiles, truth), 0, f) for f in model if len(model) > 3] + [(-plain_score(model | {f}, cells, profiles, truth), 1, f) for f in {f for f, _ in profiles} - model]
        s, add, f = min(options)
        if -s <= log[-1][2]:
            break
        model ^= {f}
        log.append(("add" if add else "drop", f, -s))
    found = gene_models.optimised(*frames, truths, start).orderBy("round").collect()
    assert len(log) > 1 and [(r.action, r.feature) for r in found] == [x[:2] for x in log] and found[-1].score == pytest.approx(log[-1][2], abs=1e-4)
