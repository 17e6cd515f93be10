"""Near copies by SetSketch: mergeable registers whose values are banded, compared by likelihood and verified on whole sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near
from .common import apart, by_text, dealt_out, drop_kept, keep, mix, read, small_batches
from .shingles import components

#: Words in a shingle, and the least similarity of a link in percent.
SHINGLE, PERCENT = 2, 80
#: Registers and how many make a band; the base of the scale, the rate of the values and the largest register.
REGISTERS, ROWS, BASE, RATE, TOP = 128, 4, 1.001, 20.0, (1 << 16) - 1
#: Bands of the first turn.
EARLY = 8
#: A pair goes on unless its registers are exp(UNLIKELY) times likelier at some lower similarity than at the least one.
UNLIKELY = 20.0
_DRAWS = np.random.default_rng(12).integers(0, 1 << 63, (2, REGISTERS, 1), np.uint64)
_BLOCK = 1 << 9
_TURN = np.uint64(0xD6E8FEB86659FD93)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit hashes.

    Every element draws a value for each register from an exponential distribution of rate RATE; a register is
    floor(1 - log(value) / log(BASE)) of the smallest one, truncated to 0 and TOP. The scale is exponential, so 16 bits
    hold any count, and the smallest value can be taken before the logarithm."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    turn, add = _DRAWS[0] | np.uint64(1), _DRAWS[1]
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), _BLOCK):
        x = hashes[a : a + _BLOCK] * turn + add
        x ^= x >> np.uint64(32)
        x *= _TURN
        np.minimum(least, x.min(axis=1), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def bands(registers: np.ndarray) -> np.ndarray:
    """One value for each band, mixed from its registers and its place.

    Sets of similarity s share a register with probability s or more; at 0.8 all but 5 in 10**8 pairs share a band."""
    parts = registers.astype(np.uint64).reshape(-1, ROWS)
    out = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out ^ parts[:, r]) + parts[:, r]
    return out.view(np.int64)


def _above(x: np.ndarray) -> np.ndarray:
    """The chance that one set's register is the larger, x being its own part of the union less what both share."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likelihood(more: np.ndarray, less: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """The logarithm of the chance that of REGISTERS registers of sets of n and m elements so many are larger and smaller."""
    u, v = n / (n + m), m / (n + m)
    p, q = _above(np.maximum(u - v * similarity, 1e-12)), _above(np.maximum(v - u * similarity, 1e-12))
    return more * np.log(p) + less * np.log(q) + (REGISTERS - more - less) * np.log(np.maximum(1 - p - q, 1e-12))


def estimate(more: np.ndarray, less: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The likeliest similarity of sets of n and m elements, by golden-section search (the likelihood has one peak)."""
    low, high, g = np.zeros(len(n)), np.minimum(n, m) / np.maximum(n, m), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        right = likelihood(more, less, n, m, a) < likelihood(more, less, n, m, b)
        low, high = np.where(right, a, low), np.where(right, high, b)
    return (low + high) / 2


def sketches(docs: DataFrame, key: str, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, s1, s2, n, registers, marks): 128 bits of hash of the set of shingles, its size, its registers as bytes, and the lowest bit of
    each of them."""

    def of(texts: list[str | None]) -> dict:
        s1, s2, n, registers, marks = [], [], [], [], []
        for t in texts:
            s = near.shingle_set(t, size)
            both = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes(), 42), "<i8")
            s1.append(int(both[0]))
            s2.append(int(both[1]))
            n.append(len(s))
            own = sketch(s)
            registers.append(own.tobytes() if len(s) else None)
            marks.append(near.marks(own))
        return {"s1": pa.array(s1, pa.int64()), "s2": pa.array(s2, pa.int64()), "n": pa.array(n, pa.int64()), "registers": pa.array(registers, pa.binary()), "marks": pa.array(marks, pa.list_(pa.int64()))}

    return by_text(docs, of, "s1 long, s2 long, n long, registers binary, marks array<long>", text, (key,))


def band_values(registers: pd.Series) -> pd.Series:
    return registers.map(lambda x: bands(np.frombuffer(x, np.uint16)))


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes (node, n, registers) whose sizes and registers don't rule out a similarity of percent."""
    least = percent / 100

    def batches(it):
        for batch in it:
            if not len(batch):
                continue
            n, m = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
            found = estimate(more, less, n, m)
            gap = likelihood(more, less, n, m, found) - likelihood(more, less, n, m, np.full(len(n), least))
            yield batch.select(["a", "b"]).filter(pa.array((found >= least) | (gap <= UNLIKELY)))

    left, right = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}")) for c in "ab")
    met = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return small_batches(met).mapInArrow(batches, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of percent or more."""
    left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"_{c}")) for c in "ab")
    met = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("_a", "_b")).cast("long").alias("_in"), (F.size("_a") + F.size("_b")).cast("long").alias("_sum"))
    return met.where(F.col("_in") * 100 >= (F.col("_sum") - F.col("_in")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n, component): the number of distinct shingles, and the smallest key that links of similarity percent or more reach.

    Rows of equal sets are one node from the first aggregation on, however many there are. In each group of nodes with the
    same band all are held against the one that a hash of node and band puts first; the likelihood of both sketches says
    which pairs are worth verifying on whole sets. So a group makes no more pairs than it has nodes, and its nodes meet other
    firsts in other bands. Then nodes of different components that share one of their rarest shingles are held
    against each other (near.across; it loses no link between banded nodes, marks of registers apart), by the same likelihood and verification.

    Texts without words, null or empty, have no shingles and link with nothing: their own key is their component, as that of
    every row alone. Fewer words than size are one shingle. Rows that repeat a key each give a row; null keys are never the
    smallest, and the component of null keys alone is null. Texts are read whole; other columns take no part. A key named n
    or component gets an underscore behind its name."""
    name = apart([key], ["n", "component"])[0]
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    # 128 bits of a row's key and text name the row in both passes over the texts
    named = rows.withColumn("_at", F.struct(F.xxhash64("_key", "_text").alias("k1"), F.xxhash64(F.lit("again"), "_text", "_key").alias("k2")))
    own = keep(sketches(named.select(F.struct("_key", "_at").alias("_row"), "_text"), "_row", "_text", size).select("_row._key", "_row._at", "s1", "s2", "n", "registers", "marks"))
    whose = keep(own.where("n > 0").groupBy("s1", "s2").agg(F.min("_key").alias("low"), F.min("_at").alias("_at")).withColumn("node", F.monotonically_increasing_id()))
    nodes = keep(whose.join(own.select("s1", "s2", "_at", "n", "registers", "marks").dropDuplicates(["s1", "s2", "_at"]), ["s1", "s2", "_at"]))
    table = nodes.select("node", F.posexplode(F.pandas_udf(band_values, "array<long>")("registers")).alias("place", "band")).withColumn("turn", F.xxhash64("node", "band"))
    first = table.groupBy("band").agg(F.min("turn").alias("least"), F.max("turn").alias("_z")).where(F.col("least") < F.col("_z")).select("band", "least")
    members = keep(dealt_out(table).join(first, "band"))
    roots = whose.select("s1", "s2", "low", F.col("node").alias("root"))
    if not members.isEmpty():
        roots = whose.select("s1", "s2", "low", "node").join(_linked(named, nodes, members, size, percent), "node", "left").select("s1", "s2", "low", F.coalesce("root", "node").alias("root"))
    roots = keep(roots)
    lows = roots.groupBy("root").agg(F.min("low").alias("component"))
    found = keep(roots.join(lows, "root").select("s1", "s2", "component"))
    for x in (whose, nodes, members):
        drop_kept(x)
    linked = own.where("n > 0").join(found, ["s1", "s2"]).select(F.col("_key").alias(name), "n", "component")
    return linked.unionByName(own.where("n = 0").select(F.col("_key").alias(name), "n", F.col("_key").alias("component")))


def _joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots (node, root) after edges (a, b) between nodes, which join components as wholes: only edges between different ones
    count, each pair of components once."""
    ends = edges
    for c in "ab":
        ends = ends.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c)
    ends = keep(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if ends.isEmpty():
        return roots
    moved = components(ends).select(F.col("fp").alias("root"), F.col("root").alias("into"))
    return keep(roots.join(moved, "root", "left").select("node", F.coalesce("into", "root").alias("root")))


def _linked(named: DataFrame, nodes: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) of the nodes that share a band with others. The bands come in two turns: what the first ones have joined
    needs no further pair."""
    wanted = keep(members.select("node").distinct())
    of = nodes.join(wanted, "node").select(F.col("_at.k1").alias("k1"), F.col("_at.k2").alias("k2"), F.col("node").alias("_n"))
    texts = named.select(F.col("_at.k1").alias("k1"), F.col("_at.k2").alias("k2"), "_text").join(of, ["k1", "k2"])
    sets = keep(near.whole_sets(texts, "_n", "_text", size).withColumnRenamed("_n", "node").dropDuplicates(["node"]))
    roots = wanted.select("node", F.col("node").alias("root"))
    for some in (F.col("place") < EARLY, F.col("place") >= EARLY):
        own = members.where(some).join(roots, "node")
        pivots = own.where(F.col("turn") == F.col("least")).select("band", F.col("node").alias("a"), F.col("root").alias("_root"))
        stars = own.join(pivots, "band").where(F.col("root") != F.col("_root")).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        roots = _joined(roots, keep(verified(likely(stars, nodes, percent), sets, percent)))
    place = keep(near.prefixes(sets, percent / 100).join(roots, "node"))
    roots = _joined(roots, keep(verified(likely(near.across(place, sets.join(nodes.select("node", "marks"), "node"), percent / 100), nodes, percent), sets, percent)))
    for x in (sets, place):
        drop_kept(x)
    return roots


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every document's number of distinct two-word shingles, and the smallest doc_id of its component."""
    out = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS x FROM w),
e AS (SELECT doc_id, len(x) AS n, unnest(x) AS h FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY 1, 2 HAVING count(*) * 100 >= (any_value(a.n) + any_value(b.n) - count(*)) * 80),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) USING (doc_id)"""
