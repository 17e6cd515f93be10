"""SimHash near-dedup by multi-index hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, by_text, dealt_out, keep, read
from .shingles import components, shingle_hashes, words

#: Words in a shingle, bits that linked fingerprints may differ in, segments of a fingerprint and their bits, the radius of
#: the ball around a segment, and fingerprints that may share a segment's value before that value is split.
SHINGLE, RADIUS, SEGMENTS, SPLIT = 3, 2, 2, 64
WIDTH, BALL = 64 // SEGMENTS, RADIUS // SEGMENTS


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingle hashes; 0 without words."""
    return of_hashes(shingle_hashes(words(text), size))


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes, repeats included."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""

    def of(texts: list[str | None]) -> dict:
        return {"fp": np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)}

    return by_text(docs, of, "fp long", text, (key,))


def segment(fp: Column, place: int) -> Column:
    """The bits of one segment, as a number."""
    return F.shiftrightunsigned(fp, place * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))


def ball(value: Column) -> list[Column]:
    """A segment's value and all at one bit from it."""
    return [value, *(value.bitwiseXOR(F.lit(1 << b)) for b in range(WIDTH))]


def index_rows(fps: DataFrame) -> DataFrame:
    """(fp, place, value, far): the tables of all segments, far 0, and what each fingerprint looks up in them, far 1.

    The ball around a segment has BALL = 1 bit. Of two values that differ in one bit one has it set, so it is enough that
    a fingerprint looks up the values with one more bit set; equal values meet in the table itself. That makes 34 rows
    of a fingerprint on average."""
    fp = F.col("fp")
    rows = []
    for place in range(SEGMENTS):
        own = segment(fp, place)
        rows += [F.struct(F.lit(place).alias("place"), own.alias("value"), F.lit(0).alias("far"))]
        rows += [F.when(own.bitwiseAND(F.lit(1 << b)) == 0, F.struct(F.lit(place).alias("place"), own.bitwiseOR(F.lit(1 << b)).alias("value"), F.lit(1).alias("far"))) for b in range(WIDTH)]
    return fps.select("fp", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("fp", "x.*")


def other(fp: Column, place: Column) -> Column:
    """The rest of a fingerprint beside one segment, where there are two."""
    return F.when(place == 0, segment(fp, 1)).otherwise(segment(fp, 0))


def links(fps: DataFrame, split: int = SPLIT) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints that differ in RADIUS bits or fewer.

    Two such fingerprints differ in BALL bits at most in some segment. There is a table for each segment, by its value; a
    fingerprint fetches what the table has under the values of a ball around its own segment, and complete distances are
    verified. Where more than split fingerprints share a segment's value, that value is split by the rest of the
    fingerprint: of those that share it, the rests lie within two bits, so balls of one bit around them meet; to one that is
    a bit off already, only a ball of one bit around its rest can lead. As fingerprints are distinct, at most 33 are under such
    a key, whatever shares the value, so candidates grow with the fingerprints and not with the square of a group. Neither side of
    a join is broadcast: by its estimate, the 34 rows of a fingerprint are one."""
    rows = index_rows(fps.select("fp"))
    own = F.array(*(F.struct(F.lit(p).alias("place"), segment(F.col("fp"), p).alias("value")) for p in range(SEGMENTS)))
    table = fps.select(F.col("fp").alias("one"), F.explode(own).alias("x")).select("x.*", "one")
    dense = keep(table.groupBy("place", "value").count().where(F.col("count") > split).select("place", "value"))
    key = ["place", "value"]
    wide = F.bit_count(F.col("one").bitwiseXOR(F.col("fp"))) <= RADIUS
    light = table.join(dense, key, "left_anti").join(dealt_out(rows), key).where(wide & ((F.col("far") == 1) | (F.col("one") < F.col("fp"))))
    found = [light.select(F.least("one", "fp").alias("a"), F.greatest("one", "fp").alias("b"))]
    if not dense.isEmpty():
        heavy = keep(rows.join(dense, key, "left_semi"))
        near = heavy.withColumn("rest", F.explode(F.array(*ball(other(F.col("fp"), F.col("place"))))))
        full = heavy.where("far = 0").select(*key, other(F.col("fp"), F.col("place")).alias("rest"), F.col("fp").alias("one"))
        within = near.where("far = 0")
        met = within.select(*key, "rest", F.col("fp").alias("one")).join(dealt_out(within), [*key, "rest"]).where(wide & (F.col("one") < F.col("fp")))
        off = full.join(dealt_out(near.where("far = 1")), [*key, "rest"]).where(wide)
        found += [x.select(F.least("one", "fp").alias("a"), F.greatest("one", "fp").alias("b")) for x in (met, off)]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, fp, component): component is the smallest key whose fingerprint can be reached by links of two bits or fewer.

    Documents without words (null, empty, white space) have fingerprint 0 and link like any other. Copies meet in an
    aggregation by fingerprint before anything else, so a large group of copies is one row from there on. Rows whose key
    repeats each give a row. Null keys are kept; they never are the smallest, and the component of null keys alone is null.
    Ties of distance don't matter: every link counts. Texts are read whole, however long; other columns take no part. Keys must
    be of a type that orders; a key named fp or component gets an underscore behind its name."""
    name = apart([key], ["fp", "component"])[0]
    own = keep(fingerprints(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")), "_key", "_text", size))
    nodes = keep(own.groupBy("fp").agg(F.min("_key").alias("low")))
    edges = keep(links(nodes))
    if edges.isEmpty():
        whole = nodes.withColumnRenamed("low", "component")
    else:
        rooted = keep(nodes.join(components(edges), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
        lows = keep(rooted.groupBy("root").agg(F.min("low").alias("component")))
        whole = keep(rooted.join(lows, "root").select("fp", "component"))
    return own.join(whole, "fp").select(F.col("_key").alias(name), "fp", "component")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document's fingerprint and the smallest doc_id of its component."""
    out = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
