"""Stages of the corpus pipeline on planted cases."""

import itertools
import random

import corpus_pipeline
from assaylake.llm import near, simhash

S = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
VOCABULARY = [a + b + c for a in "abcdefgh" for b in "aeiou" for c in "lmnrst"]


def prose(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def edited(ws, n):
    out = list(ws)
    for at in RNG.sample(range(3, len(ws) - 3), n):
        out[at] = "new" + str(RNG.random())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], S)


def test_near_copies_recall(spark):
    texts = []
    for n in (40, 120, 300, 900):
        for _ in range(6):
            base = prose(n)
            copies = [edited(base, k) for k in (1, max(1, n // 60), max(1, n // 46), max(2, n // 20), n // 8)]
            texts += [base, *copies, edited(copies[2], max(1, n // 50))]
    passage = prose(60)
    texts += [prose(20) + passage + prose(20) for _ in range(20)] + [["one"], ["one", "two"], ["one"]]
    texts = [" ".join(t) for t in texts]
    sets = [set(near.shingle_set(t).tolist()) for t in texts]
    group = list(range(len(texts)))
    far = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            far += (simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[j], 5)).bit_count() > 2
            group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    assert far > 40  # two bits of a fingerprint lose these
    rows = frame(spark, enumerate(texts))
    assert {r.doc_id: r.component for r in near.near_copies(rows, "doc_id").collect()} == dict(enumerate(group))
    kept = corpus_pipeline.drop_near_copies(spark, rows, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group)) and kept.columns == rows.columns
    assert corpus_pipeline.drop_near_copies(spark, rows.where("false"), "").count() == 0


def test_repeated_and_null_ids(spark, tmp_path):
    a, b, c, leak = (" ".join(prose(50)) for _ in range(4))
    a, b = sorted([a, b])
    rows = frame(spark, [(2, a), (5, a), (5, b), (None, a), (None, c), (None, c), (6, None), (None, None), (7, leak), (None, leak + " more"), (7, b + " and more")])
    kept = corpus_pipeline.drop_near_copies(spark, rows, "")
    want = [(2, a), (5, b), (6, None), (7, leak), (None, c)]
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in want)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = corpus_pipeline.drop_leaks(spark, rows, str(tmp_path))
    assert left.count() == 9 and left.where("doc_id = 7").count() == 1 and left.columns == rows.columns
