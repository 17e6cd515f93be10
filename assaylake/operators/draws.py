"""Random draws of exact size, many rounds at once, without a task that orders a whole list."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts of the range of hashes in which a round's rows are counted first.
PARTS = 256


def _turned(rows: DataFrame, by: list[str], key: Column, rounds: int, seed: int) -> DataFrame:
    """rows in every round, with the hash that orders them there and that hash's part."""
    h = F.xxhash64(F.lit(seed), "_round", *by, "_key")
    turn = rows.withColumn("_key", key).withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_h", h)
    return turn.withColumn("_part", (F.shiftright("_h", 56) + F.lit(PARTS // 2)).cast("int"))


def _borders(turn: DataFrame, by: list[str], sizes: DataFrame, n: str) -> DataFrame:
    """(by, _round, _border, _open): the part in which a round's draw ends, and how many of it are drawn. Counts by part leave a task;
    a round is a row for each part."""
    counts = turn.groupBy(*by, "_round", "_part").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*by, "_round").orderBy("_part"))
    counts = counts.withColumn("_upto", upto)
    counts = counts.join(sizes.select(*by, n), by) if by else counts.join(F.broadcast(sizes.select(n)))
    own = counts.where((F.col("_upto") >= F.col(n)) & (F.col("_upto") - F.col("_c") < F.col(n)))
    return own.select(*by, "_round", F.col("_part").alias("_border"), (F.col(n) - F.col("_upto") + F.col("_c")).alias("_open"))


def limits(rows: DataFrame, key: Column, sizes: DataFrame, n: str, rounds: int, seed: int) -> DataFrame:
    """(_round, _most, _last): the last hash that each round draws, and its key; a row for each round, none where n is beyond the rows or
    0. One row in PARTS is ordered."""
    turn = _turned(rows, [], key, rounds, seed)
    border = turn.join(F.broadcast(_borders(turn, [], sizes, n)), "_round").where(F.col("_part") == F.col("_border"))
    place = F.row_number().over(W.partitionBy("_round").orderBy("_h", "_key"))
    return border.withColumn("_k", place).where(F.col("_k") == F.col("_open")).select("_round", F.col("_h").alias("_most"), F.col("_key").alias("_last"))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rolled(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def hashes(keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """(seeds, keys): what Spark's xxhash64 goes on to from each seed, the hash of the columns before, with a long key. Different keys have
    different hashes."""
    h = seeds.view(np.uint64)[:, None] + (_P5 + np.uint64(8)) ^ _rolled(keys.view(np.uint64) * _P2, 31) * _P1
    h = _rolled(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def within(key: Column, seed: int) -> Column:
    """Whether the round of limits that a row has met draws the key: that takes no table of what is drawn."""
    h = F.xxhash64(F.lit(seed), "_round", key)
    return (h <= F.col("_most")) & ((h < F.col("_most")) | (key <= F.col("_last")))


def drawn(rows: DataFrame, by: list[str], key: Column, sizes: DataFrame, n: str, rounds: int, seed: int) -> DataFrame:
    """rows with _round, once for each round that draws them: of the rows of a group (by; none: all are one) the n, a column of
    sizes (a row for each group), of the smallest hashes of (seed, round, group, key). Keys are unique in a group; where n is
    beyond a group's rows or 0, nothing is drawn.

    Rows are counted by parts of the hashes' range first. Those below the part in which a round's draw ends are drawn as they are;
    only that part's rows, one in PARTS, are ordered. No side of a join by round is broadcast on an estimate, which doesn't know of rounds."""
    if not by:
        return rows.join(F.broadcast(limits(rows, key, sizes, n, rounds, seed)), within(key, seed)).select(*rows.columns, "_round")
    turn = _turned(rows, by, key, rounds, seed)
    met = turn.hint("merge").join(_borders(turn, by, sizes, n), [*by, "_round"]).where(F.col("_part") <= F.col("_border"))
    names = [*rows.columns, "_round"]
    inside = met.where(F.col("_part") < F.col("_border")).select(*names)
    place = F.row_number().over(W.partitionBy(*by, "_round", "_part").orderBy("_h", "_key"))
    return inside.unionByName(met.where(F.col("_part") == F.col("_border")).withColumn("_k", place).where(F.col("_k") <= F.col("_open")).select(*names))


def sums(rows: DataFrame, by: list[str], key: Column, sizes: DataFrame, n: str, value: str, rounds: int, seed: int) -> DataFrame:
    """(by, _round, _sum): the sum of value over what each round draws, as drawn would. Sums by part leave a task, so rows are
    neither dealt out by group and round nor ordered, but for the last part's."""
    turn = _turned(rows, by, key, rounds, seed)
    border = _borders(turn, by, sizes, n)
    parts = turn.groupBy(*by, "_round", "_part").agg(F.sum(value).alias("_s"))
    below = parts.hint("merge").join(border, [*by, "_round"]).where(F.col("_part") < F.col("_border")).select(*by, "_round", "_s")
    place = F.row_number().over(W.partitionBy(*by, "_round", "_part").orderBy("_h", "_key"))
    last = turn.hint("merge").join(border, [*by, "_round"]).where(F.col("_part") == F.col("_border")).withColumn("_k", place).where(F.col("_k") <= F.col("_open")).select(*by, "_round", F.col(value).alias("_s"))
    return below.unionByName(last).groupBy(*by, "_round").agg(F.sum("_s").alias("_sum"))
