"""Queries as registered, on small tables of their own, and operators against brute-force versions."""

import hashlib
import itertools
import math
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assaylake.llm import html, langid, licences, lines, pieces, shards, simhash, toxicity, winnow

RNG = random.Random(13)
LONG = "the long dog " * 40000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n):
    return " ".join(RNG.choice(["ka", "lo", "mi", "nu", "pe", "ro", "su", "ta"]) + RNG.choice("abcdefgh") for _ in range(n))


def rows():
    out = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 4 + words(6) + (" idiot" if i % 5 < 2 else ""), "en" if i % 2 else "de", f"s{i % 4}", 0) for i in range(240)]
    return out + [(500, None, "en", "s1", 0), (501, "", None, None, 0), (502, "½ ² 3", "en", "s1", 0), (503, LONG, "en", "s1", 0), (None, "the cat", "en", "s1", 0), (3, out[3][1], "en", "s1", 0), (3, "der hund", "de", "s1", 0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    data = rows()
    spark.createDataFrame(data, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int("idiot" in (t or ""))) for i, t, *_ in data if i is not None] + [(None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("b1", " ".join(rows()[0][1].split()[:20])), ("b2", "the cat"), (None, "hund und"), ("b3", None)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    for table, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id string, text string"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(f"{d}/{table}.parquet")
    return d


@pytest.mark.parametrize("query", [licences.query, pieces.query, simhash.query, winnow.query, langid.query, html.query, toxicity.query, shards.query])
def test_empty_tables(spark, none, query):
    assert query(spark, none).count() == 0


def test_language_query(spark, folder):
    got = langid.query(spark, folder)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = got.collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.doc_id in (500, 501, 502))
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got if r.doc_id is not None and r.doc_id < 240 and r.doc_id != 3)


def test_language_probability(spark, folder):
    m = langid.train(spark.read.parquet(f"{folder}/documents.parquet"))
    for text in ("Der Hund, die Katze!", "the 3 cats", "x" * 50):
        low = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        n: dict[int, int] = {}
        for k in langid.ORDERS:
            for i in range(len(low) - k + 1):
                b = int(langid.char_ngrams(low[i : i + k], (k,), langid.BITS)[0])
                n[b] = n.get(b, 0) + 1
        x = {b: (1 + math.log(c)) * m.idf[b] for b, c in n.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / norm * m.weights[b, j] for b, v in x.items()) + m.weights[-1, j]) / m.temperature for j in range(len(m.langs))]
        p = [math.exp(v - max(z)) for v in z]
        want = max(range(len(p)), key=lambda j: p[j])
        lang, score = m.predict(text)
        assert lang == m.langs[want] and score == pytest.approx(p[want] / sum(p), abs=1e-5)


def test_toxicity_query(spark, folder):
    got = toxicity.query(spark, folder)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = got.collect()
    assert len(got) == len(rows())
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    plain = [r for r in got if r.doc_id is not None and r.doc_id < 240 and r.doc_id != 3]
    assert all(r.predicted == int("idiot" in texts[r.doc_id]) for r in plain)
    clash = spark.createDataFrame([("x", "an idiot")], "toxicity string, text string")
    again = toxicity.score(clash, toxicity.trained(spark, folder), carry=("toxicity", "text"))
    assert again.columns == ["toxicity_", "text", "toxicity"] and again.first()[0] == "x"


def test_sharding_equals_plain(spark, folder):
    got = shards.query(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()

    def costs(key):
        h = xxhash.xxh64_intdigest(("null" if key is None else str(key)).encode(), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<Q", h), 42)
        return [-math.log(((xxhash.xxh64_intdigest(struct.pack("<q", s), h) >> 11) + 0.5) / 2**53) for s in range(41)]

    want = []
    for r in docs:
        c, text = costs(r.doc_id), (r.text or "").encode()
        want.append((str(r.doc_id), len(text) + 16, zlib.crc32(text), "key", min(range(40), key=lambda s: c[s]), min(range(41), key=lambda s: c[s])))
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == sorted(want)
    for s in range(40):
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        ids = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in own]
        assert ids == sorted(ids)
    clash = spark.range(50).select(F.col("id").alias("shard"), F.lit(1).alias("slot"), F.lit("t").alias("_h"))
    out = shards.assign(clash, "shard", [1.0, 0.0, 2.0])
    assert out.columns[:3] == ["shard_", "slot_", "_h_"] and {r.shard for r in out.collect()} == {0, 2}


def test_fingerprint_query(spark, folder):
    got = {(r.doc_id, r.fingerprint) for r in simhash.query(spark, folder).collect()}
    assert (500, "0" * 16) in got and (501, "0" * 16) in got and all(len(f) == 16 for _, f in got)
    clash = spark.createDataFrame([(1, "a b"), (2, "a b")], "fp long, component string")
    out = simhash.near_duplicates(clash, "fp", "component")
    assert out.columns == ["fp_", "fp", "component"] and {r.component for r in out.collect()} == {1}


def test_contamination_query(spark, folder):
    got = winnow.query(spark, folder).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id == 0:
            assert r.n_items == 1 and r.items_sha256 == hashlib.sha256(b"b1").hexdigest() and r.n_hit >= 20
        if r.doc_id in (500, 501):
            assert (r.n_words, r.n_hit, r.contaminated, r.items_sha256) == (0, 0, False, hashlib.sha256(b"").hexdigest())
        if r.doc_id is None:
            assert r.n_items == 1 and r.items_sha256 == hashlib.sha256(b"b2").hexdigest() and r.n_hit == 2


def test_coder_steps_together_as_alone(spark, folder):
    c = pieces.Coder(pieces.Vocabulary.load(pieces.default_model()))
    r = random.Random(4)
    letters = sorted(c.lockstep.known)
    segments = sorted({"▁" + "".join(r.choice(letters) for _ in range(r.randrange(1, 30))) for _ in range(3000)} | {"▁" + w for w in "the internationalisation of multitudinous straightforward things".split()})
    got = c.lockstep.segment(segments)
    assert all(np.frombuffer(got[s], np.int32).tolist() == c.viterbi(s) for s in segments)
    out = pieces.query(spark, folder).collect()
    assert all(r.round_trip in (True, None) and r.n_pieces == len(r.ids or ()) for r in out) and len(out) == len(rows())
    clash = pieces.encode(spark.createDataFrame([(1, "a")], "ids long, text string"), carry=("ids", "text"))
    assert clash.columns == ["ids_", "text", "ids", "n_pieces", "round_trip"]


def test_coder_equals_library():
    """The library's unigram mode adds in single precision and rounds at the size of the two pieces that score -10**9, so those are
    lifted here, for both."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for p in m.pieces:
        p.score = max(p.score, -40000.0)
    library = sentencepiece.SentencePieceProcessor()
    library.LoadFromSerializedProto(m.SerializeToString())
    c = pieces.Coder(pieces.Vocabulary([(p.piece, p.score, p.type) for p in m.pieces], m.normalizer_spec.add_dummy_prefix))
    r = random.Random(6)
    some = "the of with internationalisation straightforward things Größe élève 東京 naïve x1 3.14 e-mail ☃ don't a  b".split(" ")
    lines = [" ".join(r.choice([*some, words(1), r.choice("abcdefghij") * r.randrange(1, 9)]) for _ in range(r.randrange(1, 40))) for _ in range(400)]
    assert all(library.EncodeAsIds(x) == c.encode(x).tolist() for x in lines)


WRAPPED = """Some title

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software.

Other words here."""


@pytest.fixture(scope="module")
def licence_model(spark, folder):
    return licences.train(spark.read.parquet(f"{folder}/documents.parquet"))


def test_licences_of_held_out_statements(spark, licence_model, folder):
    m = licence_model
    forms = ("This project is made available under the {}.", "The source code is provided under the {}; refer to the file for details.", "You may use this library according to the {}.", "License: {}")
    known = {x for _, x in licences.examples()}
    cases = [(f, form.format(n)) for f, names in licences.NAMES.items() for n in names for form in forms]
    assert not known & {x for _, x in cases}
    found = [m.predict(x)[0] == f for f, x in cases]
    assert sum(found) / len(found) >= 0.9
    for x in ("the cat and the dog", "a license to kill", "the general public likes software", "copy of a copy", "MIT campus map"):
        assert m.predict(x)[0] == "unknown"
    texts = [(1, WRAPPED), (2, "Licensed under the ISC License."), (3, "Eclipse Public License - v 2.0\nmore text"), (4, None), (5, ""), (6, " \n "), (7, LONG + ". Released under the MIT License. " + LONG), (1, WRAPPED)]
    got = licences.scan(spark.createDataFrame(texts, "found long, text string"), m, carry=("found",))
    assert got.columns == ["found_", "n_paragraphs", "families", "found"]
    got = {r[0]: (r.families, r.n_paragraphs) for r in got.collect()}
    assert got[1] == (["mit"], 3) and got[2][0] == ["isc"] and got[3][0] == ["epl"] and got[4] == got[5] == got[6] == ([], 0) and got[7][0] == ["mit"]


def test_licence_probability(licence_model):
    m = licence_model
    for text in ("Licensed under the ISC License, dog.", "ka lo mi", "Apache 2.0"):
        ws, n = licences.words(text), len(m.index)
        grams = {" ".join(ws[i : i + k]) for k in licences.ORDERS for i in range(len(ws) - k + 1)}
        own = {m.index[g] for g in grams if g in m.index}
        rest = {n + (zlib.crc32(g.encode()) >> 32 - licences.BITS) for g in grams if g not in m.index}
        z = [(sum(float(m.weights[i, j]) for i in own) + sum(float(m.weights[i, j]) for i in rest) / math.sqrt(max(1, len(rest))) + float(m.weights[-1, j])) / m.temperature for j in range(len(m.families))]
        p = np.exp(np.array(z) - max(z))
        assert m.probabilities(ws) == pytest.approx(p / p.sum(), abs=1e-4)


def page(i, body):
    return f"<html><head><title>{words(3)}</title></head><body><div class=a><ul>" + "".join(f"<li><a href=/{j}>{words(1)}</a></li>" for j in range(5)) + f"</ul></div><div class=b>{body}</div><div class=c><p>Fixed words at the end</p></div></body></html>"


def test_pages_without_names(spark):
    texts = {i: [words(8), *(words(RNG.randrange(20, 60)) for _ in range(RNG.randrange(1, 5)))] for i in range(20)}
    data = [(i, f"http://h.example/{i}", page(i, f"<h2>{t[0]}</h2>" + "".join(f"<p>{x}</p>" for x in t[1:]) + "<div>Please give us money now</div>")) for i, t in texts.items()]
    df = spark.createDataFrame([*data, data[0]], "page_id long, url string, html string")
    for by_name in (False, True):
        got = {r.page_id: r.text for r in html.extract(df, by_name=by_name).collect()}
        assert got == {i: "\n\n".join(t) for i, t in texts.items()}


def test_notice_inside_articles(spark):
    texts = {i: [words(8), words(30)] for i in range(8)}
    data = [(i, "https://n.example/x", f"<body class=has-sidebar><div class='layout--nav-open no-header'><article><h1>{t[0]}</h1><p>Cookies are used here</p><p>{t[1]}</p></article></div></body>") for i, t in texts.items()]
    data.append((9, "https://n.example/y", data[0][2].replace("<p>Cookies are used here</p>", "<p>Cookies are used here</p><section id=related-work><p>Own part</p></section>")))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "\n\n".join(t) for i, t in texts.items()) and got[9] == f"{texts[0][0]}\n\nOwn part\n\n{texts[0][1]}"


def test_host_of_one_article(spark):
    """Pages that differ around one and the same article keep it."""
    text = [words(20), words(30)]
    data = [(i, "http://one.example/a", f"<nav><a href=x>{words(2)}</a></nav><article><h1>{text[0]}</h1><p>{text[1]}</p><p>{words(3)}</p></article>") for i in range(6)]
    got = [r.text for r in html.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()]
    assert all(x.startswith("\n\n".join(text)) for x in got)


def test_classes_equal_plain(spark):
    data = []
    for h, n in (("a.example", 9), ("b.example", 5), ("c.example", 2)):
        for i in range(n):
            extra = "<p class=x>Twice</p>" * 2 if i % 3 else ""
            data.append((len(data), f"http://{h}/{i}", f"<div><h1>{words(2)}</h1>{extra}<i>Same text</i><ul>{'<li>Item</li>' * (i + 1)}</ul></div>"))
    data += [(90, data[0][1], data[0][2]), (91, None, "<p>x</p>"), (92, "http://a.example/null", None)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got: dict = {}
    for r in html.classes(df).collect():
        got.setdefault((r.host, r["class"]), set()).add((r.token, r.text))
    want = []
    hosts: dict = {}
    for _, url, text in data:
        hosts.setdefault(url.split("/")[2] if url else "", set()).add(text or "")
    for host, pages in hosts.items():
        pages = sorted(pages)
        counts = []
        for text in pages:
            n: dict = {}
            for token, is_text, _ in html.Page(text).tokens():
                n[token, is_text] = n.get((token, is_text), 0) + 1
            counts.append(n)
        groups: dict = {}
        for t in set(itertools.chain(*counts)):
            groups.setdefault(tuple(n.get(t, 0) for n in counts), set()).add(t)
        for vector, own in groups.items():
            on = sum(v > 0 for v in vector)
            if on >= html.MIN_PAGES and on >= html.SUPPORT * len(pages) and any(not is_text for _, is_text in own):
                want.append((host, frozenset(own)))
    assert sorted((h, sorted(x)) for (h, _), x in got.items()) == sorted((h, sorted(x)) for h, x in want) and len(want) >= 4


def test_page_cases():
    one = lambda text: html.extract_page(text, None, None, None)
    deep = "<div>" * 3000 + "<article><p>one</p></article>" + "</div>" * 3000 + "<p>" + "long " * 100 + "</p>"
    assert one(deep) == "one"
    assert one("<article><p>Price: <math><mi>x</mi></math> ok</p><p>a<script>b</script> c</p></article>") == "Price: x ok\n\na c"
    for c in ("has-sidebar", "no-header", "layout--nav-open", "sidebar"):
        assert one(f"<div class={c}><article><p>text</p></article></div>") == "text"
    assert one("<main><p>text</p><div class=comments><p>me too</p></div><div id=comment-list>x</div><div class='post-comments'>y</div></main>") == "text"
    assert one(None) == one("") == "" and one("<" * 5000) != ""


def test_lines_clash_and_length(spark):
    long = "\n".join(f"own {i}" for i in range(20000))
    rows = [(i, f"a {i}\nshared", f"s{i}", "x", i) for i in range(11)] + [(20, long + "\nshared", "s1", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines string, _text long")
    out = lines.drop_boilerplate(df)
    assert out.columns == ["doc_id", "text", "source", "n_lines_", "_text_", "n_lines", "n_removed"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[20].text == long and got[20].n_lines == 20001 and got[20].n_removed == 1 and got[3]._text_ == 3 and got[3].n_lines_ == "x"


def test_names_and_repeats_of_pages_and_languages(spark, folder):
    pages = spark.createDataFrame([(1, "u", "<article>a</article>")] * 2, "text long, n_chars string, html string").withColumn("url", F.lit("http://x/"))
    out = html.extract(pages, carry=("text", "n_chars"))
    assert out.columns == ["text_", "n_chars_", "text", "n_chars"] and [tuple(r) for r in out.collect()] == [(1, "u", "a", 1)] * 2
    m = langid.train(spark.read.parquet(f"{folder}/documents.parquet"))
    got = langid.predict(spark.createDataFrame([("k", "the cat and the dog")] * 2, "score string, text string"), m, carry=("score",))
    rows = got.collect()
    assert got.columns == ["score_", "lang_pred", "score"] and len(rows) == 2 and rows[0] == rows[1] and rows[0][1] == "en"
    long = langid.predict(spark.createDataFrame([(1, LONG * 4)], "doc_id long, text string"), m).first()
    assert long.lang_pred == "en"
