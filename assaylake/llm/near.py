"""Near copies by the share of word shingles two texts have in common, verified exactly.

SimHash fingerprints and their multi-index search (simhash.links) find what lies within two bits. At a similarity of 0.8 texts
lie up to 14 bits apart, which 64 bits can't tell from chance; what the fingerprints leave apart is then looked up by bands
of min-hashes."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import simhash
from .common import by_text, dealt_out, drop_kept, keep, mix, trim
from .shingles import components, shingle_hashes, words

#: Words in a shingle, least share of shingles (Jaccard) of a link, bands of min-hashes, min-hashes in a band, and 64-bit
#: numbers that hold the parities of a set.
SHINGLE, LEAST, BANDS, ROWS, PARITIES = 5, 0.8, 32, 4, 8
#: Min-hashes of which a bit is a mark, and the probability with which marks may rule out a link.
MARKS, LOST = BANDS * ROWS, 1e-10
#: Shingles before one that say whether a pair has met already.
EARLIER = 8
_DRAWS = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_BLOCK = 1 << 9


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order."""
    return np.unique(shingle_hashes(words(text), size))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS min-hashes of a set; none without shingles."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    turn, add = _DRAWS[0] | np.uint64(1), _DRAWS[1]
    return np.min([mix(hashes[a : a + _BLOCK] * turn + add).min(axis=1) for a in range(0, len(hashes), _BLOCK)], axis=0)


def band_keys(least: np.ndarray) -> np.ndarray:
    """One value for each band, mixed from its min-hashes and its place; none without any.

    Texts that share s of their shingles share a band with probability 1 - (1 - s**ROWS)**BANDS: at s = 0.8 all but 5 in
    10**8 do."""
    if not len(least):
        return np.zeros(0, np.int64)
    least = least.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out ^ least[:, r]) + least[:, r]
    return out.view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Shingles are dealt into 64 * PARITIES places; a bit for each place says whether it got an odd number.

    Two sets differ in as many elements as these bits differ in, or more."""
    odd = np.bincount((hashes % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def marks(least: np.ndarray) -> np.ndarray:
    """The lowest bit of each of MARKS min-hashes (or registers), as longs; none without any."""
    return np.packbits((least & least.dtype.type(1)).astype(np.uint8), bitorder="little").view("<i8")


def most_marks(least: float) -> int:
    """How many marks of two sets of similarity least or more can differ: more do with a probability below LOST. A min-hash differs with a
    probability of 1 - least, and its mark then every other time."""
    p = (1 - least) / 2
    for t in range(MARKS):
        if sum(comb(MARKS, i) * p**i * (1 - p) ** (MARKS - i) for i in range(t + 1, MARKS + 1)) < LOST:
            return t
    return MARKS


def signatures(docs: DataFrame, key: str, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, s1, s2, n, fp, bands, marks): 128 bits of hash of the set of shingles, its size, the text's SimHash fingerprint, the set's band
    keys and marks."""

    def of(texts: list[str | None]) -> dict:
        s1, s2, n, fp, bands, bits = [], [], [], [], [], []
        for t in texts:
            every = shingle_hashes(words(t), size)
            fp.append(simhash.of_hashes(every))
            s = np.unique(every)
            both = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes(), 42), "<i8")
            s1.append(int(both[0]))
            s2.append(int(both[1]))
            n.append(len(s))
            least = min_hashes(s)
            bands.append(band_keys(least))
            bits.append(marks(least))
        numbers = {"s1": pa.array(s1, pa.int64()), "s2": pa.array(s2, pa.int64()), "n": pa.array(n, pa.int64()), "fp": np.array(fp, np.uint64).view(np.int64)}
        return numbers | {"bands": pa.array(bands, pa.list_(pa.int64())), "marks": pa.array(bits, pa.list_(pa.int64()))}

    return by_text(docs, of, "s1 long, s2 long, n long, fp long, bands array<long>, marks array<long>", text, (key,))


def whole_sets(docs: DataFrame, key: str, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(node, n, odd, hashes): the sets themselves, and their parities."""

    def of(texts: list[str | None]) -> dict:
        sets = [shingle_set(t, size) for t in texts]
        out = {"n": np.array([len(s) for s in sets], np.int64), "odd": pa.array([parities(s) for s in sets], pa.list_(pa.int64())), "hashes": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))}
        del sets
        return out

    return by_text(docs, of, "n long, odd array<long>, hashes array<long>", text, (key,)).withColumnRenamed(key, "node")


def in_reach(n: Column, m: Column, least: float) -> Column:
    """Whether sets of n and m elements can have a similarity of least."""
    return F.least(n, m) >= F.greatest(n, m) * F.lit(least) - F.lit(1e-9)


def not_apart(odd: str, other: str, n: Column, m: Column, least: float) -> Column:
    """Whether the parities leave room for it: the sets may differ in (1 - least) / (1 + least) of n + m elements at most."""
    differ = sum((F.bit_count(F.col(odd)[i].bitwiseXOR(F.col(other)[i])) for i in range(PARITIES)), F.lit(0))
    return differ <= (n + m) * F.lit((1 - least) / (1 + least)) + F.lit(1e-9)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity is least or more, from their whole sets."""
    left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"_{c}")) for c in "ab")
    met = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("_a", "_b")).alias("_in"), (F.size("_a") + F.size("_b")).alias("_sum"))
    return met.where(F.col("_in") >= (F.col("_sum") - F.col("_in")) * F.lit(least) - F.lit(1e-9)).select("a", "b")


def possible(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that sizes and parities don't rule out."""
    left, right = (sets.select(F.col("node").alias(c), F.col("n").alias(f"_n_{c}"), F.col("odd").alias(f"_odd_{c}")) for c in "ab")
    n, m = F.col("_n_a"), F.col("_n_b")
    return pairs.join(left, "a").join(right, "b").where(in_reach(n, m, least) & not_apart("_odd_a", "_odd_b", n, m, least)).select("a", "b")


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(node, n, h, before, after): of each set, the shingles on other sets too among its n - ceil(least * n) + 1 rarest, and
    how many such shingles of the set are rarer, and how many commoner.

    Two sets of Jaccard similarity least or more have least * n of their shingles in common, so the rarest shingle that they
    share is among so many of either."""
    every = sets.select("node", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    often = keep(every.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    own = dealt_out(every).join(often, "h").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("x"))
    take = F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1 - (F.col("n") - F.size("x"))
    cut = own.withColumn("_take", take.cast("int")).where("_take > 0")
    return cut.select("node", "n", F.size("x").alias("_m"), F.posexplode(F.slice("x", F.lit(1), F.col("_take"))).alias("before", "y")).select(
        "node", "n", F.col("y.h").alias("h"), "before", (F.col("_m") - F.col("before") - 1).alias("after")
    )


def across(place: DataFrame, bits: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes of different roots that share a shingle of their prefixes and that no bound rules out.

    place has prefixes' columns and root, bits the nodes' parities (odd) and marks. Shingles whose nodes have one root between them make no
    pair. The bounds are part of the join, so a pair that they rule out is never a row. Sizes, places and parities lose nothing, but say
    little of sets of over a thousand shingles, of which any two share some by chance; marks tell those apart whatever their sizes.

    Near copies share most of their prefixes, and a pair needs one row only, that of the first shingle they share: all others that they share come
    after it in both, which bounds how many there are. So a row goes if it couldn't be the first of a link by that bound, or if the
    EARLIER shingles before it, of either, have one in common; the first has none, however many are looked at."""
    mixed = place.groupBy("h").agg(F.min("root").alias("_r"), F.max("root").alias("_s")).where(F.col("_r") < F.col("_s")).select("h")
    # a shingle that both have has both their roots, so none that they share is missing here
    earlier = F.collect_list("h").over(W.partitionBy("node").orderBy("before").rowsBetween(-EARLIER, -1))
    open_ = keep(dealt_out(place).join(mixed, "h").withColumn("earlier", earlier).join(bits.select("node", "odd", "marks"), "node"))
    left, right = (open_.select("h", F.col("node").alias(c), *[F.col(x).alias(f"_{x}_{c}") for x in ("root", "n", "after", "earlier", "odd", "marks")]) for c in "ab")
    # if it is the first that both have, the shingle itself and at most so many after it can be in both
    n, m = F.col("_n_a"), F.col("_n_b")
    most = F.least("_after_a", "_after_b") + 1
    enough = most >= (n + m - most) * F.lit(least) - F.lit(1e-9)
    differ = sum((F.bit_count(F.col("_marks_a")[i].bitwiseXOR(F.col("_marks_b")[i])) for i in range(MARKS // 64)), F.lit(0))
    bounds = (F.col("a") < F.col("b")) & (F.col("_root_a") != F.col("_root_b")) & enough & (differ <= most_marks(least)) & not_apart("_odd_a", "_odd_b", n, m, least)
    bounds &= ~F.arrays_overlap("_earlier_a", "_earlier_b")
    return dealt_out(left).join(right, "h").where(bounds).select("a", "b").distinct()


def near_copies(docs: DataFrame, key: str, text: str = "text", size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(key, component): component is the smallest key that links of Jaccard similarity least or more reach.

    key must be unique, not null, and of a type that orders. Texts with equal sets of shingles are one node from the first
    aggregation on; those without words are copies of each other. First nodes meet by SimHash: all of one fingerprint are held
    against one of them, and those ones of fingerprints that lie within two bits (simhash.links) against each other. Then nodes that
    share a band of min-hashes and are in different components still: of each band's group all are held against one pivot, the
    node that a hash of node and band puts first, so that a group of copies of one text makes no pairs, and its nodes meet other pivots
    in other bands. Last, nodes that are in different components still are held against each other if they share one of their
    rarest shingles, which loses no link (see prefixes), marks apart (see most_marks). Every link is verified on the whole sets."""
    own = keep(signatures(docs, key, text, size))
    nodes = keep(own.groupBy("s1", "s2").agg(F.min(F.struct(F.col(key).alias("node"), "fp", "bands", "marks")).alias("x")).select("s1", "s2", "x.*"))
    by_print = keep(fingerprint_pairs(nodes))
    table = nodes.select("node", F.explode("bands").alias("band")).withColumn("turn", F.xxhash64("node", "band"))
    first = table.groupBy("band").agg(F.min("turn").alias("least"), F.max("turn").alias("_z")).where(F.col("least") < F.col("_z")).select("band", "least")
    members = keep(dealt_out(table).join(first, "band"))
    ends = members.select("node").unionByName(by_print.select(F.explode(F.array("a", "b")).alias("node")))
    wanted = keep(ends.distinct())
    whole = nodes.select("s1", "s2", F.col("node").alias("component"))
    if not wanted.isEmpty():
        sets = keep(whole_sets(docs.join(wanted.withColumnRenamed("node", key), key, "left_semi"), key, text, size))
        edges = keep(verified(possible(by_print, sets, least), sets, least))
        roots = _roots(edges, wanted)
        apart = members.join(roots, "node")
        pivots = apart.where(F.col("turn") == F.col("least")).select("band", F.col("node").alias("a"), F.col("root").alias("_root"))
        stars = apart.join(pivots, "band").where(F.col("root") != F.col("_root")).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        banded = keep(verified(possible(stars, sets, least), sets, least))
        if not banded.isEmpty():
            edges = keep(edges.unionByName(banded))
            roots = _roots(edges, wanted)
        place = keep(prefixes(sets, least).join(roots, "node"))
        more = keep(verified(across(place, sets.join(nodes.select("node", "marks"), "node"), least), sets, least))
        if not more.isEmpty():
            roots = _roots(keep(edges.unionByName(more)), wanted)
        whole = keep(nodes.join(roots, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("component")))
        for x in (sets, place, wanted, members):
            drop_kept(x)
    return own.join(whole, ["s1", "s2"]).select(key, "component")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes (node, fp): each node and the first of its fingerprint, and the firsts of any two fingerprints that differ
    in two bits or fewer."""
    prints = keep(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(prints, "fp").where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b"))
    met = simhash.links(prints)
    for c in "ab":
        met = met.join(prints.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}")), c)
    return same.unionByName(met.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))


def _roots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of every node: itself where no edge touches it."""
    if edges.isEmpty():
        return nodes.select("node", F.col("node").alias("root"))
    reached = components(edges).withColumnRenamed("fp", "node")
    return keep(nodes.join(reached, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
