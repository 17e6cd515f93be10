"""Sharding: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import apart, drop_kept, keep, read

def key_hash(key: Column) -> Column:
    """XXH64 (seed 42) of the key's text; no session setting takes part. It is taken once for a row."""
    return F.xxhash64(F.coalesce(key.cast("string"), F.lit("null")))


def draw(h: Column, shard: int) -> Column:
    """A number in (0, 1) that the key's hash and the shard decide: the upper 53 bits of XXH64 of both."""
    return (F.shiftrightunsigned(F.xxhash64(h, F.lit(shard).cast("long")), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def cost(h: Column, shard: int, weight: float) -> Column:
    """-ln(draw) / weight: the shard of the smallest cost wins, so that a shard gets its weight's share of the keys."""
    return -F.ln(draw(h, shard)) / F.lit(float(weight))


def choose(h: Column, weights: Sequence[float]) -> Column:
    """The winning shard. Shards of no weight get nothing; a tie goes to the smaller number. Taking a shard away or adding
    one leaves the other shards' costs as they are, so only keys that the shard loses or wins move."""
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a weight")
    return F.array_min(F.array(*[F.struct(cost(h, i, w).alias("c"), F.lit(i).alias("s")) for i, w in live]))["s"]


def assign(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """df with shard, slot and, if grown weights are given, grown_shard (the shard under those).

    slot numbers the rows of a shard from 0 without gaps, in the order of key and then of the columns in order. Rows are
    dealt by ranges of (shard, key, order, place in the input), so neither a large shard nor a repeated key meets in one
    task; each range counts its own rows, and the small table of counts (a few rows for each range) gives the offsets.

    A null key is placed as the text "null" would be; repeated rows get slots of their own; texts and other columns pass
    through whole; an empty table gives no row. A column of df named shard, slot, grown_shard or as one of the operator's own
    (_h, _row, _at, _part, _shift) gets an underscore behind its name.
    """
    names = apart(df.columns, ["shard", "slot", "grown_shard", "_h", "_row", "_at", "_part", "_shift"])
    now = dict(zip(df.columns, names, strict=True))
    key, order = now[key], [now[x] for x in order]
    placed = df.toDF(*names).withColumn("_h", key_hash(F.col(f"`{key}`"))).withColumn("shard", choose(F.col("_h"), weights))
    placed = placed.withColumn("grown_shard", choose(F.col("_h"), grown) if grown is not None else F.lit(None).cast("int"))
    # written before it is dealt by ranges, which reads it twice: for the bounds and for the rows
    placed = keep(placed.drop("_h").withColumn("_row", F.monotonically_increasing_id()))
    by = ["shard", key, *order, "_row"]
    ranged = keep(placed.repartitionByRange(*(F.col(f"`{c}`") for c in by)).sortWithinPartitions(*(F.col(f"`{c}`") for c in by)).drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    drop_kept(placed)
    # the upper bits of the id are the partition, the lower 33 the row in it
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    runs = ranged.groupBy("_part", "shard").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("_part", "shard", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    # a row for each range and shard in it: as many as ranges and shards together, whatever the rows
    return ranged.join(F.broadcast(runs), ["_part", "shard"]).withColumn("slot", F.col("_at") + F.col("_shift")).select(*(f"`{c}`" for c in names), "shard", "grown_shard", "slot")


N_SHARDS = 40


def query(spark, sf_dir: str) -> DataFrame:
    """op10: documents in shards 0 to 39 by doc_id; grown_shard is the shard among 41."""
    body = F.coalesce(F.col("text"), F.lit(""))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(body) + F.lit(16)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")
    )
    out = assign(docs, "doc_id", [1.0] * N_SHARDS, [1.0] * (N_SHARDS + 1), ("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.col("grown_shard").cast("int"))
