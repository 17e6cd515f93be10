"""The Merkle manifest, SetSketch near copies and reassembled turns against SQL and plain computations."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import merkle, near, setsketch, turns
from assaylake.llm.queries import ORACLE_SQL, QUERIES

RNG = random.Random(31)
D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_minhash_near_dedup", "op13_turn_reassembly"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = QUERIES[name](spark, D)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def beside(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 8 * 8
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
        i //= 8
    return out


def test_manifest(spark):
    rows = [(i, "big", h(str(i))) for i in range(5000)] + [(i, "a" * (i % 3), h(str(-i))) for i in range(100)] + [(7, "é", h("x"))]
    rows += [(None, "big", h("n")), (3, "big", h("3")), (3, "big", h("3")), (3, "big", h("4")), (1, None, h("y")), (None, None, h("z")), (2, "", h("e"))]
    RNG.shuffle(rows)
    df = spark.createDataFrame(rows, "root long, path string, digest string").repartition(5)
    got = merkle.manifest(df, "path", "root", "digest", ("root", "path"))
    assert got.columns == ["root_", "path_", "leaf", "subroot", "root", "path"]
    groups = sorted({g for _, g, _ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted([(k, d) for k, x, d in rows if x == g], key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for g in groups}
    trees = {g: tree([d for _, d in x]) for g, x in own.items()}
    top = tree([trees[g][-1][0] for g in groups])
    want = [(k, g, d, trees[g][-1][0], top[-1][0], tuple(beside(trees[g], i) + beside(top, n))) for n, g in enumerate(groups) for i, (k, d) in enumerate(own[g])]
    found = [(r.root_, r.path_, r.leaf, r.subroot, r["root"], tuple((x.left, x.right) for x in r.path)) for r in got.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(found, key=key) == sorted(want, key=key)
    assert got.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert got.where(merkle.folded(F.sha2(F.col("leaf"), 256), F.col("path")) == F.col("root")).count() == 0
    lone = merkle.manifest(df.limit(1), "path", "root", "digest").first()
    assert lone.leaf == lone.subroot == lone.root and lone.path == []
    assert merkle.manifest(df.where("false"), "path", "root", "digest").count() == 0


def test_manifest_of_documents(spark, tmp_path):
    low = next(i for i in range(20, 99) if zlib.crc32(str(i).encode()) % 3 == 0)
    rows = [(low, "Abc é", None, "s", 5), (2, None, "en", "s", None), (3, "", "en", None, 0), (3, "", "en", None, 0), (None, "X", "fr", "s", 1), (6, "No" * 50000, "de", "s", 100000), (9, "low", "de", "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.query(spark, str(tmp_path)).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    want = {h(*map(field, (i, source, lang, n, text))) for i, text, lang, source, n in rows}
    assert {r.leaf for r in got} == want and len(got) == 7
    changed = {i for i, text, *_ in rows if i is not None and text and zlib.crc32(str(i).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in text)}
    assert {r.doc_id for r in got if not r.verified} == changed and changed


def words(n):
    return [RNG.choice("abcdefgh") + RNG.choice("aeiou") + RNG.choice("lmnrst") for _ in range(n)]


def test_sketches():
    a, b = (np.unique(np.random.default_rng(s).integers(0, 1 << 63, 700, np.uint64)) for s in (1, 2))
    both = np.unique(np.concatenate([a[:500], b[:200]]))
    one, two = setsketch.sketch(a), setsketch.sketch(both)
    assert (setsketch.merged(setsketch.sketch(a[:300]), setsketch.sketch(a[300:])) == one).all()
    found = []
    for seed in range(40):
        x = np.random.default_rng(seed).integers(0, 1 << 63, 1000, np.uint64)
        s, t = setsketch.sketch(x[:900]), setsketch.sketch(x[100:])
        found.append(setsketch.estimate(np.array([(s > t).sum()]), np.array([(s < t).sum()]), np.array([900.0]), np.array([900.0]))[0])
    assert abs(np.mean(found) - 0.8) < 0.02 and np.std(found) < 0.06
    assert len(set(setsketch.bands(one).tolist()) & set(setsketch.bands(two).tolist())) < 32 and not setsketch.sketch(a[:0]).any()


def test_near_copies(spark):
    texts = []
    for n in (6, 30, 120, 500):
        for _ in range(5):
            base = words(n)
            texts.append(base)
            for k in (1, max(1, n // 25), max(1, n // 19), max(1, n // 15), n // 6):
                copy = list(base)
                for at in RNG.sample(range(n), min(n, k)):
                    copy[at] = f"x{RNG.random()}"
                texts.append(copy)
    passage = words(40)
    texts += [passage + words(8) for _ in range(25)]
    rows = [(i + 10, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "One"), (504, "one"), (505, "one two"), (506, "oNE\x0btwo"), (507, "ÀB c"), (508, "àB c"), (None, rows[3][1]), (None, "alone and unlike"), (13, "another text of its own"), (9, rows[5][1]), (9, rows[5][1]), (509, "ka " * 60000)]
    sets = [set(near.shingle_set(t, 2).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    low = {}
    for (i, _), g, s in zip(rows, group, sets, strict=True):
        if s and i is not None:
            low[g] = min(low.get(g, i), i)
    want = sorted(((i, len(s), low.get(g) if s else i) for (i, _), g, s in zip(rows, group, sets, strict=True)), key=str)
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "n long, text string, component int, node string").repartition(3)
    got = setsketch.near_duplicates(df, "n")
    assert got.columns == ["n_", "n", "component"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert setsketch.near_duplicates(df.where("false"), "n").count() == 0
    assert setsketch.near_duplicates(df.where("n < 11"), "n").count() > 0


def plain_events(rows, batches, idle):
    arrived, first = {}, {}
    for conv, turn, role, text, batch in rows:
        if turn is None or batch is None:
            continue
        x = (f"{role or ''}|{text or ''}".encode(), role or "", text or "")
        first[conv] = min(first.get(conv, turn), turn)
        k = (batch, conv, turn)
        arrived[k] = min(arrived.get(k, x), x)
    state, closed, out = {}, set(), []

    def close(conv, batch):
        s = state.pop(conv)
        closed.add(conv)
        kept = s["kept"]
        breaks = sum(t - 1 in kept and kept[t - 1][1] == kept[t][1] for t in kept)
        out.append(("close", conv, -1, batch, None, None, tuple(sorted(t for t in kept if t >= s["next"])), max(kept) - first[conv] + 1 - len(kept), breaks))

    for b in range(batches):
        for (batch, conv, turn), x in sorted(arrived.items(), key=str):
            if batch != b:
                continue
            if conv in closed:
                out.append(("reject", conv, turn, b, x[1], x[2], None, None, None))
                continue
            s = state.setdefault(conv, {"kept": {}, "next": first[conv], "last": b})
            s["last"] = b
            s["kept"].setdefault(turn, x)
        for conv, s in list(state.items()):
            while s["next"] in s["kept"]:
                x = s["kept"][s["next"]]
                out.append(("release", conv, s["next"], b, x[1], x[2], None, None, None))
                s["next"] += 1
            if b == s["last"] + idle:
                close(conv, b)
    for conv in list(state):
        close(conv, batches)
    return out


def test_turns(spark):
    rows = []
    for conv in [*range(40), None]:
        start, batch = RNG.choice([0, 0, 3, -2]), RNG.randrange(7)
        for t in range(start, start + RNG.randint(1, 9)):
            if RNG.random() < 0.15:
                continue
            for _ in range(RNG.choice([1, 1, 1, 2, 3])):
                b = RNG.choice([batch, batch, batch + 1, batch + 2, RNG.randrange(7)])
                rows.append((conv, t, RNG.choice(["user", "assistant", None]), RNG.choice([None, "", "a|b", f"text {t}", "é"]), b if b < 7 and b != 4 else 3))
    rows += [(99, 0, "user", "long " * 100000, 0), (99, 0, "user", "long " * 100000, 0), (99, None, "user", "gone", 1), (99, 1, "user", "gone", None)]
    schema = "conv_id long, turn long, role string, text string, batch long"
    df = spark.createDataFrame(rows, schema).withColumns({"first": F.lit(5), "beat": F.lit("x"), "at": F.lit(1)})
    got = turns.reassemble(df, 7)
    found = [(*r[:6], tuple(r.unreleased) if r.unreleased is not None else None, *r[7:]) for r in got.collect()]
    assert sorted(found, key=str) == sorted(plain_events(rows, 7, 2), key=str)
    assert {r[0] for r in found} == {"release", "reject", "close"} and any(r[6] for r in found)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_no_turns(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, batch long")
    assert turns.reassemble(df, 1, 1).count() == 0
    assert turns.dealt(df.drop("batch")).count() == 0
