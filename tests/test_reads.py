"""Aligned reads: files of compressed blocks, regions, differences, isoforms and their shares, against plain computations."""

import itertools
import math
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from assaylake.operators import hypothesis, intervals, isoforms, reads
from assaylake.sources import alignments, files
from tests.test_binary_files import record

RNG = random.Random(3)
A = alignments.ALIGNMENTS


def block(content):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(content) + packer.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\2\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(content), len(content))


def blocked(path, body, size):
    path.write_bytes(b"".join(block(body[a : a + size]) for a in range(0, len(body), size)) + block(b""))


def head():
    return b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + n + b"\0" + struct.pack("<i", 10**6) for n in (b"chr1", b"chr2"))


@pytest.mark.parametrize(("split", "size"), [("128m", 60000), ("70k", 60000), ("9k", 20000), ("2k", 3000)])
def test_blocks_are_split(spark, tmp_path, split, size):
    body, want = head(), []
    for i in range(3000):
        n = 9000 if i % 500 == 0 else RNG.choice([50, 75, 100])
        seq, ref, pos = "".join(RNG.choices("ACGT", k=n)), RNG.randrange(2), RNG.randrange(10**6)
        body += record(f"read{i}", ref, pos, [(n, "M")], seq, b"XSA+NHC\x01CBZAAC\0")
        want.append((f"read{i}", f"chr{ref + 1}", pos + 1, seq))
    blocked(tmp_path / "a.bam", body, size)
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = files.bam(spark, str(tmp_path))
        assert sorted((r.name, r.chrom, r.pos, r.seq) for r in got.collect()) == sorted(want)
        if split == "2k":
            (tmp_path / "a.bam").write_bytes((tmp_path / "a.bam").read_bytes()[:-40 - len(block(body[-size:])) // 2])
            with pytest.raises(Exception, match="block|joined|cut off"):
                files.bam(spark, str(tmp_path)).count()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def steps(cigar):
    out, n = [], ""
    for c in cigar:
        if c.isdigit():
            n += c
        else:
            out.append((int(n), c))
            n = ""
    return out


def plain_blocks(pos, cigar):
    out, at, since = [], pos, pos
    for n, k in steps(cigar):
        if k == "N":
            out.append((since, at - 1))
            since = at + n
        if k in "MDN=X":
            at += n
    return [b for b in [*out, (since, at - 1)] if b[1] >= b[0]]


def random_reads(n):
    out = []
    for i in range(n):
        parts = [f"{RNG.randint(1, 3)}S"] * RNG.randrange(2)
        for j in range(RNG.randint(1, 3)):
            parts += [f"{RNG.choice([10, 30, 300])}N"] * bool(j) + [f"{RNG.randint(3, 12)}M"]
            parts += [RNG.choice(["2D4M", "1I5M", ""])]
        cigar = "".join(parts)
        n_seq = sum(n for n, k in steps(cigar) if k in "MIS")
        tags = RNG.choice([None, {"XS": "+"}, {"XS": "-"}])
        out.append(("f", f"r{i // 2}", RNG.choice([0, 1]), RNG.choice(["1", "2"]), RNG.randint(1, 400), cigar, "".join(RNG.choices("ACGT", k=n_seq)), tags))
    return [*out, ("f", "unplaced", 4, None, 0, "*", "A", None)]


def test_regions(spark):
    rows = random_reads(400)
    regions = [(i, RNG.choice(["1", "2"]), a := RNG.randint(1, 500), a + RNG.choice([0, 5, 40, 1000]), RNG.choice("+-")) for i in range(60)]
    df, rg = spark.createDataFrame(rows, A), spark.createDataFrame(regions, "key long, chrom string, start long, end long, strand string")
    exons, introns = {}, {}
    for key, chrom, a, b, strand in regions:
        n, pairs = 0, {}
        for _, name, flag, c, pos, cigar, _, tags in rows:
            if c != chrom or (tags or {}).get("XS", strand) != strand:
                continue
            x = plain_blocks(pos, cigar)
            s, e = x[0][0], x[-1][1]
            if s > b or e < a:
                continue
            edge = any(p[1] == b for p in x[:-1]) or any(p[0] == a for p in x[1:])
            n += len(x) == 1 or a <= s <= b or a <= e <= b or edge
            if len(x) == 1:
                p = pairs.setdefault(name, [False, False, False])
                p[0] |= s < a <= e
                p[1] |= s <= b < e
                p[2] |= flag == 0 or (s >= a and e <= b)
        exons[key] = n
        introns[key] = (sum(p[0] and p[2] for p in pairs.values()), sum(p[1] and p[2] for p in pairs.values()))
    assert {r.key: r.reads for r in reads.exon_reads(df, rg, 16).collect()} == exons
    assert {r.key: (r.left, r.right) for r in reads.intron_reads(df, rg, 16).collect()} == introns
    assert any(sum(v) for v in introns.values()) and reads.exon_reads(df.where("false"), rg).where("reads = 0").count() == 60


def test_bases_and_differences(spark):
    rows = random_reads(300)
    df = spark.createDataFrame(rows, A)
    sites = [(f"{c}:{p}", c, p) for c in "12" for p in range(1, 500, 7)]
    want = {}
    for _, _, _, c, pos, cigar, seq, _ in rows[:-1]:
        ref, at = pos, 0
        for n, k in steps(cigar):
            for i in range(n):
                if k in "MD" and (ref + i) % 7 == 1 and ref + i < 500:
                    x = (f"{c}:{ref + i}", "del" if k == "D" else seq[at + i])
                    want[x] = want.get(x, 0) + 1
            ref, at = ref + n * (k in "MDN"), at + n * (k in "MIS")
    got = reads.bases_at(df, spark.createDataFrame(sites, "key string, chrom string, at long"), 8)
    assert {(r.key, r.base): r.reads for r in got.collect()} == want
    one = reads.alleles(got).where("n_second is not null").first()
    own = sorted(((n, b) for (k, b), n in want.items() if k == one.key), reverse=True)
    assert (one.n_first, one["first"], one.n_second, one.second, one.depth) == (*own[0], *own[1], sum(n for n, _ in own))
    some = [("f", "a", 0, "1", 100, "5M100N5M", "A" * 10, {"MD": "2C4T2"}), ("f", "b", 0, "1", 100, "4M2D2I4M", "A" * 10, {"MD": "4^GA0C3"}), ("f", "c", 0, "1", 100, "6M", "A" * 6, None), ("f", "d", 0, "1", 100, "6M", "A" * 6, {"MD": "6"})]
    found = {(r["at"], r.kind): r.reads for r in reads.differences(spark.createDataFrame(some, A)).collect()}
    assert found == {(102, "mismatch"): 1, (207, "mismatch"): 1, (104, "deletion"): 1, (106, "mismatch"): 1, (106, "insertion"): 1}


def test_meetings(spark):
    sides = [[(RNG.choice("xy"), s := RNG.choice([RNG.randint(0, 50), RNG.randint(0, 10**9)]), s + RNG.choice([0, 3, 70, 5000, 10**9]), i) for i in range(150)] for _ in range(2)]
    schema = "g string, start long, end long, key long"
    one, two = (spark.createDataFrame(s, schema) for s in sides)
    for touch in (True, False):
        got = sorted((r.i, r.j) for r in intervals.meet(one, two, ["g"], 16, touch).select(F.col("a.key").alias("i"), F.col("b.key").alias("j")).collect())
        over = (lambda x, y: x <= y) if touch else (lambda x, y: x < y)
        assert got == sorted((a[3], b[3]) for a in sides[0] for b in sides[1] if a[0] == b[0] and over(a[1], b[2]) and over(b[1], a[2]))
    every = spark.range(1).select(F.sequence(F.lit(0), F.lit(intervals.LEVELS - 1)).alias("_levels"))
    assert intervals._spread(one, "a", ["g"], 16, every).groupBy("a.key").count().agg(F.max("count")).first()[0] <= 2 * intervals.LEVELS


def test_isoforms(spark):
    forms = [("g", "one", "1", [(100, 119), (140, 159), (180, 199)]), ("g", "two", "1", [(100, 119), (180, 199)]), ("h", "one", "1", [(100, 199)])]
    fs = spark.createDataFrame(forms, "gene string, isoform string, chrom string, exons array<struct<start:long,end:long>>")
    rows = [("f", n, fl, "1", p, c, "", None) for n, fl, p, c in [("a", 0, 110, "10M20N5M"), ("b", 0, 110, "10M60N5M"), ("c", 0, 185, "10M"), ("d", 0, 115, "10M"), ("e", 0, 118, "2M20N9M"), ("p", 1, 101, "10M"), ("p", 1, 141, "10M"), ("q", 1, 100, "10M"), ("q", 1, 110, "10M"), ("s", 0, 110, "9M1D20N5M")]]
    df = spark.createDataFrame(rows, A)
    fits = reads.compatible(df, fs, 3)
    got = {}
    for r in fits.collect():
        got.setdefault(r.name, []).append((r.gene, r.isoform))
    assert {k: sorted(v) for k, v in got.items()} == {"a": [("g", "one")], "b": [("g", "two")], "c": [("g", "one"), ("g", "two"), ("h", "one")], "d": [("h", "one")], "p": [("g", "one"), ("g", "one"), ("g", "two"), ("h", "one"), ("h", "one")], "q": [("g", "one"), ("g", "one"), ("g", "two"), ("g", "two"), ("h", "one"), ("h", "one")], "s": [("g", "one")]}
    classes = {(r.gene, tuple(r.isoforms)): r.reads for r in reads.read_classes(fits).collect()}
    assert classes == {("g", ("one",)): 3, ("g", ("two",)): 1, ("g", ("one", "two")): 2, ("h", ("one",)): 4}
    exons = reads.constitutive_exons(fs)
    assert sorted((r.gene, r.start) for r in exons.collect()) == [("g", 100), ("g", 180), ("h", 100)]
    lengths = reads.insert_lengths(df, exons.where("gene = 'g'"))
    assert [(r.name, r.length) for r in lengths.collect()] == [("q", 20)]
    assert reads.insert_summary(lengths).first().pairs == 1


def test_shares(spark):
    events = {"a": (30, 10, 25, 100.0, 60.0), "b": (0, 5, 3, 80.0, 80.0), "c": (300, 40, 0, 200.0, 90.0), "d": (2, 0, 0, 10.0, 100.0)}
    classes = [(g, c, n) for g, (x, y, z, _, _) in events.items() for c, n in ((["i"], x), (["o"], y), (["i", "o"], z))] + [("lone", ["i"], 4)]
    sizes = [(g, i, int(n)) for g, e in events.items() for i, n in (("i", e[3]), ("o", e[4]))] + [("lone", "i", 50), ("unread", "i", 50)]
    cs, ls = spark.createDataFrame(classes, "gene string, isoforms array<string>, reads long"), spark.createDataFrame(sizes, "gene string, isoform string, length long")
    post = isoforms.posterior(cs, ls)
    got = {(r.gene, r.isoform): r for r in post.collect()}
    for g, (x, y, _, a, b) in events.items():
        grid = [(k + 0.5) / 4000 for k in range(4000)]
        logs = [x * math.log(p) + y * math.log(1 - p) - sum(events[g][:3]) * math.log(p * a + (1 - p) * b) for p in grid]
        w = [math.exp(v - max(logs)) for v in logs]
        mean, total, edges = sum(p * v for p, v in zip(grid, w, strict=True)) / sum(w), list(itertools.accumulate(w)), []
        for q in (0.025, 0.975):
            edges.append(grid[next(i for i, v in enumerate(total) if v >= q * total[-1])])
        r = got[g, "i"]
        assert abs(r.psi - mean) < 0.02 and abs(r.low - edges[0]) < 0.04 and abs(r.high - edges[1]) < 0.04 and abs(r.psi + got[g, "o"].psi - 1) < 1e-9
    assert got["lone", "i"].psi == 1.0 and ("unread", "i") not in got
    again = {(r.gene, r.isoform): r.psi for r in isoforms.sampled(cs.repartition(3), ls).collect()}
    assert again == {k: r.psi for k, r in got.items()}
    other = isoforms.posterior(cs.withColumn("reads", F.when(F.col("gene") == "c", 300 - F.col("reads")).otherwise(F.col("reads"))).where("reads >= 0"), ls)
    factor = {r.feature: r.bayes_factor for r in hypothesis.bayes_factor(isoforms.paired_draws(post, other)).collect()}
    assert factor["c:i"] > 100 and factor["a:i"] < 2
    pairs = spark.createDataFrame([("x", [10, 1], [10, 0], 0.4, 30.0), ("y", [1, 1], [10, 9], 0.4, 30.0), ("z", [10, 1], [10, 0], 0.1, 30.0)], "k string, inclusion array<int>, exclusion array<int>, dpsi double, bayes_factor double")
    assert [r.k for r in isoforms.passing(pairs, 15, 5, 5, 0.2, 10).collect()] == ["x"]
