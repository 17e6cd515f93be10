"""The operators against plain versions of themselves on small tables with nulls, ties, repeated rows and odd texts."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assaylake.llm import html, langid, licences, lines, pieces, shards, simhash, topk, toxicity, winnow

S = "doc_id long, text string, source string, extra string"
RNG = random.Random(3)
VOCABULARY = [a + b for a in "abcdefgh" for b in "xyz"]


def sentence(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = [sentence(60) for _ in range(12)]
    rows = [(i, t, f"s{i % 5}", "x") for i, t in enumerate(base)]
    rows += [(20, base[0], "s1", "x"), (20, base[0], "s1", "x"), (21, base[1] + " tail", "s2", None), (22, None, None, "x"), (23, "", "s1", "x"), (None, base[2], "s3", "x"), (24, " \n\t", "s1", "x"), (25, "É€▁ one", "s1", "x"), (26, sentence(30000), "s1", "x")]
    return spark.createDataFrame(rows, S)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], S)


def test_simhash(spark, docs, empty):
    def plain(text):
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split() if text else []
        hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), seed=42) for i in range(max(1, len(ws) - 2))] if ws else []
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0

    rows = docs.collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.fp % 2**64, r.component) for r in simhash.near_duplicates(docs).collect())
    fps = sorted(((r.doc_id is None, r.doc_id or 0), plain(r.text)) for r in rows)
    group = list(range(len(fps)))
    for _ in fps:
        for i, j in itertools.combinations(range(len(fps)), 2):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                group[i] = group[j] = min(group[i], group[j])
    want = [(*fp, min(fps[j][0][1] for j in range(len(fps)) if group[j] == group[i] and not fps[j][0][0])) for i, fp in enumerate(fps)]
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_chain(spark):
    x, chain = 0, []
    for i in range(30):
        chain.append((x - (1 << 64) if x >> 63 else x, i))
        x ^= (1 << (2 * i)) | (1 << (2 * i + 1))
    nodes = spark.createDataFrame([*chain, (0x0F0F0F0F0F0F0F0F, 99)], "fp long, low int")
    edges = simhash.links(nodes)
    roots = {r.root for r in simhash.components(edges).collect()}
    assert len(roots) == 1 and simhash.components(edges).count() == 30


@pytest.mark.parametrize("split", [2, 64])
def test_simhash_links_equal_all_pairs(spark, split):
    """Random fingerprints, neighbours of some at one to four bits in the same or both segments, and segments that many share."""
    r, fps = random.Random(9), set()
    for _ in range(40):
        x = r.getrandbits(64)
        fps.add(x)
        for k in (1, 1, 2, 2, 2, 3, 4):
            y = x
            for b in r.sample(range(64), k):
                y ^= 1 << b
            fps.add(y)
    for _ in range(60):
        fps |= {0x123456789 << 28 & ~0xFFFFFFFF & (1 << 64) - 1 | r.getrandbits(5), r.getrandbits(32) << 32 | 0xFFFFFFFF, 0xABCD << 48 | 1 << r.randrange(40)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in itertools.combinations(sorted(fps), 2) if (a ^ b).bit_count() <= 2}
    got = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), split).collect()
    assert len(got) == len(want) > 300 and {(e.a, e.b) for e in got} == want


def test_winnow_equals_plain(spark, docs):
    texts = [r.text for r in docs.collect()]
    items = [(1, " ".join(texts[0].split()[5:30])), (2, "ax ay az"), (2, "hx hy"), (3, None), (None, " ".join(texts[1].split()[:12])), (4, " ".join(texts[3].split()[20:30]).upper()), (5, "")]
    low = lambda t: [w for w in __import__("re").split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]
    want = []
    for r in docs.collect():
        ws, hit, found = low(r.text), set(), set()
        for i, t in items:
            it = low(t)
            k = min(10, len(it))
            for a in range(len(it) - k + 1 if k else 0):
                for b in range(len(ws) - k + 1):
                    if ws[b : b + k] == it[a : a + k]:
                        hit.update(range(b, b + k))
                        found |= {str(i)} if i is not None else set()
        want.append((str(r.doc_id), len(ws), sorted(hit), sorted(found)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(str(r.doc_id), r.n_words, r.hit, r["items"]) for r in winnow.hits(docs, bench).collect()]
    assert sorted(got) == sorted(want)
    clash = docs.select(F.col("doc_id").alias("hit"), F.col("text").alias("n_words"))
    again = winnow.hits(clash, bench, key="hit", text="n_words")
    assert again.columns == ["hit_", "n_words", "hit", "items"] and sorted((str(r[0]), *r[1:]) for r in again.collect()) == sorted(want)
    assert winnow.hits(docs.where("false"), bench).count() == 0
    assert all(r.hit == [] for r in winnow.hits(docs, bench.where("false")).collect())


def test_lines(spark, empty):
    rows = [(i, f"own {i}\nshared \n\nonce{i // 2}", f"s{i}", "x") for i in range(12)] + [(50, None, "s1", "x"), (51, "", None, "x"), (0, "own 0\nshared \n\nonce0", "s0", "x")]
    got = {(r.doc_id, r.text): r.n_removed for r in lines.drop_boilerplate(spark.createDataFrame(rows, S)).collect()}
    assert got[(0, "own 0\nshared \n\nonce0")] == 0 and got[(50, None)] == 0 and got[(51, "")] == 0
    assert all(got[(i, f"own {i}\n\nonce{i // 2}")] == 1 for i in range(1, 12))
    assert lines.drop_boilerplate(empty).count() == 0


def test_pieces(spark, docs, empty):
    v = pieces.Vocabulary.load(pieces.default_model())
    c, score = pieces.Coder(v), {p: s for p, s, k in v.pieces if k == 1}
    for word in [sentence(3), "über-Größe  x", "漢字\n\t ▁", "a" * 90]:
        s = (" " + word).replace("▁", "\n").replace(" ", "▁")
        best = [0.0] + [-np.inf] * len(s)
        for e in range(1, len(s) + 1):
            best[e] = max([best[a] + score[s[a:e]] for a in range(max(0, e - 16), e) if s[a:e] in score] + ([best[e - 1] + c.unknown_score] if s[e - 1] not in score else []))
        ids = c.encode(word.replace("▁", "\n"))
        n_unknown = sum(x not in score for x in s)
        assert sum(v.pieces[i][1] for i in ids if v.pieces[i][2] == 1) + n_unknown * c.unknown_score == pytest.approx(best[-1])
        assert c.decode(c.encode(word)) == word
    out = pieces.encode(docs)
    assert all(r.round_trip in (True, None) and (r.ids is None) == (r.round_trip is None) for r in out.collect())
    assert sorted(str(r.text) for r in pieces.decode(out).collect()) == sorted(str(r.text) for r in docs.collect())
    assert pieces.encode(empty).count() == 0


def test_top_k(spark):
    r = np.random.default_rng(1)
    vs = [(i, [float(x) for x in r.normal(size=8) * r.choice([0.1, 1, 3])]) for i in range(300)] + [(7, None), (300, [float("nan")] * 8), (301, [None] * 8), (None, [1.0] * 8)]
    vs += [(i, [2.0] * 8) for i in range(310, 330)] + [(310, [2.0] * 8)]
    good = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in vs if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = {q: sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:5] for q in good if q % 50 == 0}
    got = topk.top_k(spark.createDataFrame(vs, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0)
    assert sorted((x.query_id, x["rank"], -x.score, x.vec_id) for x in got.collect()) == sorted((q, k + 1, *b) for q, best in want.items() for k, b in enumerate(best))
    plane = [(1000 + i, [float(x) for x in r.normal(size=3)]) for i in range(120)]  # another number of dimensions, and small blocks and ranges
    two = spark.createDataFrame([*vs, *plane], "vec_id long, embedding array<double>")
    small = {i: np.floor(256 * np.array(v)).astype(int) for i, v in plane}
    want |= {q: sorted((-int(small[q] @ v), i) for i, v in small.items() if i != q)[:5] for q in small if q % 50 == 0}
    got = topk.top_k(two, lambda i: i % 50 == 0, block_bytes=128, range_rows=16)
    assert sorted((x.query_id, x["rank"], -x.score, x.vec_id) for x in got.collect()) == sorted((q, k + 1, *b) for q, best in want.items() for k, b in enumerate(best))
    big = [(0, [2.0**21, 1.0]), (1, [2.0**21, 3.0]), (2, [-(2.0**21), 5.0])]
    got = topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), lambda i: i == 0)
    assert [(x.vec_id, x.score) for x in got.orderBy("rank").collect()] == [(1, 2**58 + 3 * 2**16), (2, -(2**58) + 5 * 2**16)]
    for far in ([1e30], [2.0**40]):
        with pytest.raises(Exception, match="64 bits"):
            topk.top_k(spark.createDataFrame([(0, far), (1, far)], "vec_id long, embedding array<double>"), lambda i: i == 0).collect()
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 50 == 0).count() == 0


def test_sharding(spark):
    df = spark.range(3000).unionByName(spark.range(5)).select(F.col("id").alias("doc_id"))
    rows = shards.assign(df, "doc_id", [1.0, 1.0, 2.0], [1.0, 1.0, 2.0, 1.0]).collect()
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert abs(sum(r.shard == 2 for r in rows) / len(rows) - 0.5) < 0.05
    assert shards.assign(df.where("false"), "doc_id", [1.0]).count() == 0


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p><b>one<br><p>two  <i>three</i></p><div class='ad'>buy</div><form>f</form><div id=comments>c</div></article><footer>f</footer>"
    bare = "<div><p>Welcome</p><div class=body><p>Text number {0} of the page, long enough to be it {0}.</p></div></div>"
    rows = [(1, "http://a/1", page), (1, "http://a/1", page), (2, "http://a/2", page[:150]), (3, None, None), (4, "http://b/1", bare.format(1)), (5, "http://b/2", bare.format(2)), (6, "http://[", ""), (7, "http://c/", "<" * 2000)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "A & B\n\none\n\ntwo three" and got[3] == "" and got[6] == ""
    assert got[4] == "Text number 1 of the page, long enough to be it 1."


def test_classifiers(spark, empty):
    data = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 3 + sentence(4) + (" idiot" if i % 3 == 0 else ""), "en" if i % 2 else "de", int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame([*data, (900, None, "en", 1), (901, "", None, 0), (902, "123 456", "en", None)], "doc_id long, text string, lang string, toxic int")
    model = langid.train(df)
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    assert all(out[i][0] == lang for i, _, lang, _ in data) and out[900] == out[902] == ("und", 0.0)
    assert langid.predict(empty, langid.train(empty.withColumn("lang", F.lit("en")))).count() == 0
    tox = toxicity.train(toxicity.labelled(df.select("doc_id", "text"), df.select("doc_id", "toxic"), learn=F.col("doc_id") % 4 != 0))
    got = {r.doc_id: r.toxicity for r in toxicity.score(df, tox).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, _, y in data) and 0 <= got[900] <= 1 and got[900] == got[901]
    none = toxicity.train(toxicity.labelled(empty, df.select("doc_id", "toxic").where("false")))
    assert toxicity.score(df, none).where("toxicity = 0.5").count() == 303
    text = "Intro words here.\nReleased under the MIT License.\nlicense free words"
    m = licences.train(df)
    assert m.predict("Licensed under the Apache License, Version 2.0.")[0] == "apache-2.0" and m.predict("the cat and the dog")[0] == "unknown"
    found = licences.scan(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), m).collect()
    assert [r.families for r in sorted(found)] == [["mit"], [], []]
