"""Word shingles, and connected components of links; what near-duplicate operators share."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, keep

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text: str | None) -> list[bytes]:
    """A-Z in lower case, split at space and the controls 9 to 13, as bytes.split does."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def shingle_hashes(parts: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of size words joined by a space; of the whole sequence if it is shorter."""
    if not parts:
        return np.zeros(0, "<u8")
    h, joined = xxhash.xxh64_intdigest, b" ".join(parts)
    if len(parts) <= size:
        return np.array([h(joined, 42)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([h(joined[a:b], 42) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)], "<u8")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (fp, root): for each end of an edge, the smallest fingerprint that can be reached.

    Rounds of two steps, until nothing changes: each node takes the smallest label of itself and its neighbours, and then the
    label of the node whose name it carries. Tables between rounds are written to the shared folder; joins are between
    written tables, whose large groups adaptive execution splits, and minima are taken before rows are dealt out."""
    both = keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = keep(both.groupBy(F.col("a").alias("fp")).agg(F.least(F.min("b"), F.col("fp")).alias("root")))
    while True:
        heard = keep(both.join(label.select(F.col("fp").alias("b"), "root"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("heard")))
        near = keep(label.join(heard, "fp").select("fp", F.least("root", "heard").alias("next"), F.col("root").alias("was")))
        ahead = near.where(F.col("fp") != F.col("next")).select(F.col("fp").alias("next"), F.col("next").alias("further"))
        root = F.least(F.col("next"), F.coalesce("further", "next"))
        after = keep(near.join(ahead, "next", "left").select("fp", root.alias("root"), (root < F.col("was")).alias("moved")))
        for old in (label, heard, near):
            drop_kept(old)
        label = after.drop("moved")
        if after.where("moved").isEmpty():
            drop_kept(both)
            return label
