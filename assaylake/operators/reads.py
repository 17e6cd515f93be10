"""Aligned reads against regions, positions and isoforms: everything from pos (from 1) and the steps of the cigar."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.operators import intervals

_BLOCKS = "array<struct<start:bigint,end:bigint>>"
#: Positions in the narrowest bin in which reads and regions meet.
WIDTH = 256


def _steps(cigar: Column, kinds: str) -> Column:
    """(n, kind) of each step of those kinds."""
    found = F.regexp_extract_all(cigar, F.lit(rf"(\d+[{kinds}])"), 1)
    return F.transform(found, lambda s: F.struct(F.regexp_extract(s, r"^\d+", 0).cast("long").alias("n"), F.right(s, F.lit(1)).alias("kind")))


def _walk(cigar: Column, kinds: str, state: dict[str, Column], step) -> Column:
    """A struct of named values, changed by step(values, n, kind) for each step of the cigar."""
    start = F.struct(*(v.alias(k) for k, v in state.items()))

    def apply(acc, s):
        changed = step(acc, s["n"], s["kind"])
        return F.struct(*(changed.get(k, acc[k]).alias(k) for k in state))

    return F.aggregate(_steps(cigar, kinds), start, apply)


def blocks(pos: Column, cigar: Column) -> Column:
    """The stretches [start, end] of the reference between the skipped ones; a deletion doesn't part a stretch. Null where either is null.

    Alignments of a batch share most of their cigars, so each distinct one is read once, from 0, and its stretches are moved to every pos."""

    @F.arrow_udf(_BLOCKS)
    def of(pos: pa.Array, cigar: pa.Array) -> pa.Array:
        codes = cigar.dictionary_encode()
        found, starts, ends = [0], [], []
        for text in codes.dictionary.to_pylist():
            at = since = 0
            for n, kind in [*re.findall(r"([0-9]+)([MDN=X])", text), ("0", "N")]:
                if kind == "N":
                    if at > since:
                        starts.append(since)
                        ends.append(at - 1)
                    since = at + int(n)
                at += int(n)
            found.append(len(starts))
        known = np.asarray(pos.is_valid()) & np.asarray(cigar.is_valid())
        own = np.asarray(codes.indices.fill_null(0)).astype(np.int64)
        found = np.array([*found, found[-1]], np.int64)  # one more, for a batch without a cigar
        sizes = np.where(known, found[own + 1] - found[own], 0)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(found[own] - offsets[:-1], sizes) + np.arange(offsets[-1])
        shift = np.repeat(np.asarray(pos.fill_null(0)).astype(np.int64), sizes)
        both = [pa.array(np.array(x, np.int64)[at] + shift) for x in (starts, ends)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(both, ["start", "end"]), mask=pa.array(~known))

    return of(pos.cast("long"), cigar)


def _once(x: Column) -> Column:
    """x, worked out once a row: what explode makes is a column for all that uses it, where filters and other columns would each have the
    whole expression put in for its name."""
    return F.explode(F.array(x))


def placed(alignments: DataFrame) -> DataFrame:
    """alignments that have a place, with blocks, start and end."""
    out = alignments.where(F.col("chrom").isNotNull() & (F.col("pos") > 0)).withColumn("blocks", _once(blocks(F.col("pos"), F.col("cigar")))).where(F.size("blocks") > 0)
    return out.withColumns({"start": F.col("blocks")[0]["start"], "end": F.element_at("blocks", -1)["end"]})


def _strand_fits(tags: Column, strand: Column) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit("XS")) == strand, F.lit(True))


def exon_reads(alignments: DataFrame, exons: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, reads): alignments by exon (key, chrom, start, end, strand).

    An alignment without a gap counts if it shares a base with the exon; one with gaps if its first or last base is in the exon
    or if a gap begins right behind the exon's end or ends right before its start. An alignment that knows its strand (XS)
    counts on that alone. Exons without reads have 0; an exon's key is unique."""
    reads = placed(alignments).select("chrom", "start", "end", "blocks", "tags")
    met = intervals.meet(exons.select("chrom", "start", "end", "key", "strand"), reads, ["chrom"], width)
    a, b = F.col("a"), F.col("b")
    inside = lambda at: (at >= a["start"]) & (at <= a["end"])
    n = F.size(b["blocks"])
    edge = F.exists(F.slice(b["blocks"], F.lit(1), n - 1), lambda x: x["end"] == a["end"]) | F.exists(F.slice(b["blocks"], F.lit(2), n), lambda x: x["start"] == a["start"])
    counts = met.where(_strand_fits(b["tags"], a["strand"]) & ((n == 1) | inside(b["start"]) | inside(b["end"]) | edge)).groupBy(a["key"].alias("key")).agg(F.count("*").alias("reads"))
    return exons.select("key").join(counts, "key", "left").select("key", F.coalesce("reads", F.lit(0)).alias("reads"))


def intron_reads(alignments: DataFrame, introns: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, left, right): by intron (key, chrom, start, end, strand) the reads that run over its first and its last border
    without a gap. Of a pair (flag 1) one read has to run over the border and one to lie wholly inside the intron; a pair counts
    once at a border."""
    reads = placed(alignments).where(F.size("blocks") == 1).select("chrom", "start", "end", "name", "flag", "tags")
    met = intervals.meet(introns.select("chrom", "start", "end", "key", "strand"), reads, ["chrom"], width)
    a, b = F.col("a"), F.col("b")
    left, right = (b["start"] < a["start"]) & (b["end"] >= a["start"]), (b["start"] <= a["end"]) & (b["end"] > a["end"])
    inside = (b["start"] >= a["start"]) & (b["end"] <= a["end"])
    alone = b["flag"].bitwiseAND(F.lit(1)) == 0
    named = met.where(_strand_fits(b["tags"], a["strand"])).groupBy(a["key"].alias("key"), b["name"].alias("name")).agg(F.bool_or(left).alias("l"), F.bool_or(right).alias("r"), F.bool_or(inside | alone).alias("ok"))
    counts = named.where("ok").groupBy("key").agg(F.sum(F.col("l").cast("long")).alias("left"), F.sum(F.col("r").cast("long")).alias("right"))
    return introns.select("key").join(counts, "key", "left").select("key", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("left", "right")))


def differences(alignments: DataFrame) -> DataFrame:
    """(chrom, at, kind, reads): places of the reference at which reads differ from it, by the MD tag (mismatch, and deletion by
    its first base) and by the cigar (insertion, by the base behind it)."""
    tokens = F.regexp_extract_all(F.try_element_at("tags", F.lit("MD")), F.lit(r"(\d+|\^[A-Z]+|[A-Z])"), 1)
    empty = "array<struct<at:bigint,kind:string>>"

    def token(acc, t):
        letters, cut = t.rlike("^[A-Z]"), t.startswith("^")
        n = F.when(letters, F.lit(1).cast("long")).when(cut, (F.length(t) - 1).cast("long")).otherwise(F.coalesce(t.try_cast("long"), F.lit(0)))
        found = F.array(F.struct(acc["at"].alias("at"), F.when(cut, "deletion").otherwise("mismatch").alias("kind")))
        return F.struct((acc["at"] + n).alias("at"), F.when(letters | cut, F.concat(acc["found"], found)).otherwise(acc["found"]).alias("found"))

    seen = F.aggregate(tokens, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(empty).alias("found")), token)["found"]
    # the tag counts aligned and deleted bases only: a stretch's own bases begin where those of the stretches before end
    def shifted(v):
        start = F.struct(v["at"].alias("left"), F.lit(None).cast("long").alias("at"))
        step = lambda acc, b: F.struct((acc["left"] - (b["end"] - b["start"] + 1)).alias("left"), F.when(acc["at"].isNull() & (acc["left"] < b["end"] - b["start"] + 1), b["start"] + acc["left"]).otherwise(acc["at"]).alias("at"))
        return F.struct(F.aggregate(F.col("blocks"), start, step)["at"].alias("at"), v["kind"].alias("kind"))

    def insertion(acc, n, kind):
        return {"at": acc["at"] + F.when(kind == "I", 0).otherwise(n), "found": F.when(kind == "I", F.concat(acc["found"], F.array(F.struct(acc["at"].alias("at"), F.lit("insertion").alias("kind"))))).otherwise(acc["found"])}

    put_in = _walk(F.col("cigar"), "MDNI=X", {"at": F.col("pos").cast("long"), "found": F.array().cast(empty)}, insertion)["found"]
    every = F.concat(F.coalesce(F.transform(seen, shifted), F.array().cast(empty)), put_in)
    return placed(alignments).select("chrom", F.explode(every).alias("v")).where("v.at is not null").groupBy("chrom", "v.at", "v.kind").agg(F.count("*").alias("reads"))


def bases_at(alignments: DataFrame, sites: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, base, reads): the bases that reads have at sites (key, chrom, at); del where a read leaves the site out. Reads that
    skip the site in a gap don't count."""
    points = sites.select("chrom", F.col("at").alias("start"), F.col("at").alias("end"), "key")
    reads = placed(alignments).select("chrom", "start", "end", "pos", "cigar", "seq")
    met = intervals.meet(points, reads, ["chrom"], width)
    at, r = F.col("a.start"), F.col("b")

    def step(acc, n, kind):
        here = (at >= acc["ref"]) & (at < acc["ref"] + n)
        own = F.substring(r["seq"], (acc["read"] + at - acc["ref"] + 1).cast("int"), F.lit(1))
        base = F.when(here & kind.isin("M", "=", "X"), own).when(here & (kind == "D"), F.lit("del"))
        return {"ref": acc["ref"] + F.when(kind.isin("I", "S"), 0).otherwise(n), "read": acc["read"] + F.when(kind.isin("D", "N"), 0).otherwise(n), "base": F.coalesce(acc["base"], F.when(~kind.isin("I", "S"), base))}

    base = _walk(r["cigar"], "MIDNS=X", {"ref": r["pos"].cast("long"), "read": F.lit(0).cast("long"), "base": F.lit(None).cast("string")}, step)["base"]
    return met.select(F.col("a.key").alias("key"), base.alias("base")).where("base is not null").groupBy("key", "base").agg(F.count("*").alias("reads"))


def alleles(bases: DataFrame) -> DataFrame:
    """(key, depth, first, n_first, second, n_second, share, ratio) of bases_at: the two commonest bases of a site (ties: the
    later name first), the share of reads that don't have the commonest, and the second's reads over the first's."""
    x = F.reverse(F.array_sort(F.collect_list(F.struct("reads", "base"))))
    s = bases.groupBy("key").agg(F.sum("reads").alias("depth"), x.alias("x"))
    one, two = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    n1, n2 = one["reads"], two["reads"]
    return s.select("key", "depth", one["base"].alias("first"), n1.alias("n_first"), two["base"].alias("second"), n2.alias("n_second"), ((F.col("depth") - n1) / F.col("depth")).alias("share"), (n2 / n1).alias("ratio"))


def compatible(alignments: DataFrame, isoforms: DataFrame, overhang: int = 1, width: int = WIDTH) -> DataFrame:
    """(name, file, gene, isoform) of alignments that an isoform (gene, isoform, chrom, exons: its sorted stretches) can have made.

    The read's stretches have to lie in as many consecutive exons, to begin at an exon's start and end at its end wherever the
    read has a gap, and to be overhang bases long or longer beside a gap."""
    reads = placed(alignments).select("chrom", "start", "end", "name", "file", "blocks")
    forms = isoforms.select("chrom", F.col("exons")[0]["start"].alias("start"), F.element_at("exons", -1)["end"].alias("end"), "gene", "isoform", "exons")
    met = intervals.meet(forms, reads, ["chrom"], width)
    b = F.col("b.blocks")
    own = F.filter(F.col("a.exons"), lambda e: (e["end"] >= F.col("b.start")) & (e["start"] <= F.col("b.end")))
    both = F.zip_with(F.col("own"), F.col("blocks"), lambda e, r: F.struct(e["start"].alias("es"), e["end"].alias("ee"), r["start"].alias("rs"), r["end"].alias("re")))
    n = F.size("both")
    fits = F.forall(F.slice("both", F.lit(1), n - 1), lambda x: x["ee"] == x["re"]) & F.forall(F.slice("both", F.lit(2), n), lambda x: x["es"] == x["rs"])
    ends = (F.get("both", F.lit(0))["es"] <= F.get("both", F.lit(0))["rs"]) & (F.element_at("both", -1)["ee"] >= F.element_at("both", -1)["re"])
    long = (n == 1) | F.forall("both", lambda x: x["re"] - x["rs"] + 1 >= overhang)
    s = met.select(F.col("b.name").alias("name"), F.col("b.file").alias("file"), F.col("a.gene").alias("gene"), F.col("a.isoform").alias("isoform"), b.alias("blocks"), _once(own).alias("own")).where(F.size("own") == F.size("blocks"))
    return s.withColumn("both", _once(both)).where(fits & ends & long).select("name", "file", "gene", "isoform")


def read_classes(fits: DataFrame) -> DataFrame:
    """(gene, isoforms, reads): how many reads have just these isoforms, sorted. Both ends of a pair count as one read, which has the
    isoforms that either end has alone or both have together."""
    # dealt out once: both aggregations are by these
    ends = fits.repartition("file", "name", "gene").groupBy("file", "name", "gene", "isoform").agg(F.count("*").alias("n"))
    most = ends.groupBy("file", "name", "gene").agg(F.max("n").alias("most"), F.collect_set(F.struct("n", "isoform")).alias("x"))
    own = F.array_sort(F.transform(F.filter("x", lambda s: s["n"] == F.col("most")), lambda s: s["isoform"]))
    return most.select("gene", own.alias("isoforms")).groupBy("gene", "isoforms").agg(F.count("*").alias("reads"))


def constitutive_exons(isoforms: DataFrame, least: int = 1) -> DataFrame:
    """(gene, chrom, start, end): exons of least bases or more that all isoforms of a gene have, just so."""
    forms = isoforms.groupBy("gene").agg(F.countDistinct("isoform").alias("n"))
    each = isoforms.select("gene", "chrom", "isoform", F.explode("exons").alias("e")).groupBy("gene", "chrom", "e.start", "e.end").agg(F.countDistinct("isoform").alias("k"))
    return each.join(forms, "gene").where((F.col("k") == F.col("n")) & (F.col("end") - F.col("start") + 1 >= least)).select("gene", "chrom", "start", "end")


def insert_lengths(alignments: DataFrame, exons: DataFrame, width: int = WIDTH) -> DataFrame:
    """(file, name, length): of pairs of which both ends lie wholly, without a gap, in one exon (chrom, start, end): bases from
    the first's first to the last's last."""
    reads = placed(alignments).where((F.size("blocks") == 1) & (F.col("flag").bitwiseAND(F.lit(1)) != 0)).select("chrom", "start", "end", "file", "name")
    met = intervals.meet(exons.select("chrom", "start", "end").distinct(), reads, ["chrom"], width).where("b.start >= a.start and b.end <= a.end")
    pairs = met.groupBy("b.file", "b.name", "a.start", "a.end").agg(F.count("*").alias("n"), (F.max("b.end") - F.min("b.start") + 1).alias("length")).where("n = 2")
    return pairs.groupBy("file", "name").agg(F.min("length").alias("length"))


def insert_summary(lengths: DataFrame) -> DataFrame:
    """(file, pairs, mean, deviation) of insert lengths within three deviations of the mean, by file: the rest is no insert."""
    s = lengths.groupBy("file").agg(F.avg("length").alias("m"), F.stddev_pop("length").alias("s"))
    near = lengths.join(s, "file").where(F.abs(F.col("length") - F.col("m")) <= 3 * F.col("s"))
    return near.groupBy("file").agg(F.count("*").alias("pairs"), F.avg("length").alias("mean"), F.stddev_pop("length").alias("deviation"))
