"""Exact top-k search by inner product: norm-bucketed retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import drop_kept, keep, read, small_batches, trim

#: Vectors in a bucket and in a range of lengths, vectors of the greatest length that give the first thresholds, bytes of
#: queries in a block, the local cosine threshold from which on coordinates prune a bucket for a query (below, lengths
#: do), and the coordinates that are looked at then.
BUCKET, RANGE, SEEDS, BLOCK_BYTES, BY_COORDINATE, FOCUS = 1024, 1 << 16, 2048, 8 << 20, 0.6, 3


def scaled(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, dim, norm2, v): v holds floor(scale * component) as bytes of 64-bit numbers, norm2 its squared length.

    Rows with a null id or vector, or with a null or non-finite component, are left out. A number beyond 64 bits is an error."""

    def batches(it):
        for batch in it:
            ids, lists = batch.column(0), batch.column(1)
            good, norms, out = np.zeros(len(ids), bool), np.zeros(len(ids)), []
            flat, offsets, valid = lists.values, lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            values = pa.compute.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
            for i in range(len(ids)):
                x = values[offsets[i] : offsets[i + 1]]
                if valid[i] and ids[i].is_valid and np.isfinite(x).all():
                    v = np.floor(x * scale)
                    if len(v) and not (-(2.0**63) <= v.min() and v.max() < 2.0**63):
                        raise OverflowError(f"a component of {key} {ids[i]} times {scale} doesn't fit into 64 bits")
                    good[i], norms[i] = True, float(v @ v)
                    out.append(v.astype("<i8"))
            yield pa.RecordBatch.from_arrays(
                [ids.filter(pa.array(good)), pa.array([len(v) for v in out], pa.int32()), pa.array(norms[good]), pa.array([v.tobytes() for v in out], pa.binary())],
                ["id", "dim", "norm2", "v"],
            )

    return small_batches(vectors).select(F.col(f"`{key}`").cast("long"), F.col(f"`{vector}`")).mapInArrow(batches, "id long, dim int, norm2 double, v binary")


class Block:
    """Queries of one number of dimensions: their ids, numbers, lengths, and first thresholds."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.v, self.k, self.floor = ids, v, k, floor
        self.length = np.sqrt((v.astype(float) ** 2).sum(axis=1))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where no sum can pass 2**53, in 64-bit numbers where none can pass 2**63 (as
    those wrap, what lies between doesn't matter), else in whole numbers of any size; one beyond 64 bits is an error."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    a, b = q.astype(float), v.astype(float)
    most = np.sqrt((a * a).sum(axis=1).max() * (b * b).sum(axis=1).max())
    if most < 2.0**52:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return q @ v.T
    whole = q.astype(object) @ v.T.astype(object)
    if any(not -(1 << 63) <= x < 1 << 63 for x in whole.ravel()):
        raise OverflowError("an inner product doesn't fit into 64 bits")
    return whole.astype(np.int64)


def first_thresholds(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """What a query's k-th best score can't fall below: the k-th best among the longest vectors. Ids are distinct."""
    if len(ids) <= k:
        return np.full(len(q), -np.inf)
    s = products(q, v).astype(float)
    s[q_ids[:, None] == ids[None, :]] = -np.inf
    return np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]


class Search:
    """The best k of the vectors seen so far for each query of a block."""

    def __init__(self, block: Block):
        self.b, n = block, len(block.ids)
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (-score, id), in order
        self.floor = block.floor.copy()
        unit = np.abs(block.v) / np.maximum(block.length, 1e-300)[:, None]
        self.focus = np.argsort(-unit, axis=1, kind="stable")[:, :FOCUS]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.b.k
        both = sorted({*self.found[q], *((-int(s), int(i)) for s, i in zip(scores, ids, strict=True) if i != self.b.ids[q])})
        self.found[q] = both[:k]
        if len(both) >= k:
            self.floor[q] = max(self.floor[q], float(-self.found[q][-1][0]))

    def bucket(self, ids: np.ndarray, v: np.ndarray, length: np.ndarray) -> None:
        """One bucket, longest vectors first. A query whose threshold its longest vector can't reach passes it by. For the
        others, the threshold over both lengths is a threshold of the cosine: where that is high, vectors go whose focus coordinates rule
        it out; where it is low, vectors go that are too short. Products are taken of what is left. Bounds have a little
        slack for rounding, and a score equal to the threshold stays, for its id may be smaller."""
        b, slack = self.b, 1 - 1e-9
        reach = b.length * length[0]
        live = np.flatnonzero((reach >= self.floor * slack) | (self.floor <= 0))
        local = np.where(reach[live] > 0, self.floor[live] / np.maximum(reach[live], 1e-300), -1.0)
        low = live[local < BY_COORDINATE]
        if len(low):
            need = np.where(self.floor[low] > 0, self.floor[low] * slack / np.maximum(b.length[low], 1e-300), 0.0)
            upto = np.searchsorted(-length, -need, "right")
            s = products(b.v[low], v[: int(upto.max())])
            hit = (s >= self.floor[low][:, None]) & (np.arange(s.shape[1])[None, :] < upto[:, None])
            for i in np.flatnonzero(hit.any(axis=1)).tolist():
                at = np.flatnonzero(hit[i])
                self.add(int(low[i]), s[i][at], ids[at])
        high = live[local >= BY_COORDINATE]
        if len(high):
            unit = v / np.maximum(length, 1e-300)[:, None]
            for q in high.tolist():
                t = np.minimum(self.floor[q] * slack / np.maximum(b.length[q] * length, 1e-300), 2.0)
                # what the focus coordinates give, and at most what the others can add to it
                f = self.focus[q]
                c, w = b.v[q, f] / b.length[q], unit[:, f]
                rest = np.sqrt(np.maximum(1 - (w * w).sum(axis=1), 0.0) * max(0.0, 1 - float(c @ c)))
                mask = (t <= 1.0) & (w @ c + rest >= t - 1e-9)
                at = np.flatnonzero(mask)
                if len(at):
                    s = products(b.v[q : q + 1], v[at])[0]
                    good = s >= self.floor[q]
                    if good.any():
                        self.add(q, s[good], ids[at[good]])


def grouped(it: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Runs of rows that are equal in the first n columns (numbers), with those; a group may come in several runs."""
    for batch in it:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y > x:
                yield tuple(keys[:, x].tolist()), batch.slice(x, y - x)


def numbers(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), "<i8").reshape(len(column), dim)


def with_thresholds(rows: DataFrame, k: int) -> DataFrame:
    """(dim, block, id, v, floor) of the queries in rows (dim, block, tag, id, v): of each block, first come the longest vectors
    (tag 0), then its queries (tag 1)."""

    def batches(it):
        now, longest, ids, v = None, {}, None, None
        for key, part in grouped(it, 3):
            dim, block, tag = key
            if (dim, block) != now:
                now, longest, ids = (dim, block), {}, None
            if tag == 0:
                longest.update(zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True))
                continue
            if ids is None:
                ids, v = np.array(list(longest), np.int64), np.frombuffer(b"".join(longest.values()), "<i8").reshape(len(longest), dim)
            for at in range(0, part.num_rows, BUCKET):
                own = part.slice(at, BUCKET)
                floor = first_thresholds(own.column(3).to_numpy(), numbers(own.column(4), dim), ids, v, k)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(3), own.column(4), pa.array(floor)], ["dim", "block", "id", "v", "floor"])
        trim()

    return rows.mapInArrow(batches, "dim int, block int, id long, v binary, floor double")


def searched(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k in each range for each query of each block, from rows (dim, part, block, tag,
    id, v, x): of each range and block, first come the queries (tag 0, x the threshold), then the vectors (tag 1, x the
    squared length) in order of falling length. A task holds one block of queries and one bucket of vectors."""

    def batches(it):
        now, ids, vs, floors, search = None, [], [], [], None

        def best():
            rows = [(int(search.b.ids[q]), i, -s) for q, found in enumerate(search.found) for s, i in found] if search else []
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

        for key, part in grouped(it, 4):
            dim, _, _, tag = key
            if key[:3] != now:
                yield best()
                now, ids, vs, floors, search = key[:3], [], [], [], None
            if tag == 0:
                ids.append(part.column(4).to_numpy())
                vs.append(numbers(part.column(5), dim))
                floors.append(part.column(6).to_numpy())
                continue
            if search is None and ids:
                search = Search(Block(np.concatenate(ids), np.concatenate(vs), k, np.concatenate(floors)))
            if search is not None:
                for at in range(0, part.num_rows, BUCKET):
                    own = part.slice(at, BUCKET)
                    search.bucket(own.column(4).to_numpy(), numbers(own.column(5), dim), np.sqrt(own.column(6).to_numpy()))
        yield best()
        trim()

    return rows.mapInArrow(batches, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0, block_bytes: int = BLOCK_BYTES, range_rows: int = RANGE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest (is_query tells by the id) inner products with the other rows, ties to smaller ids.

    Vectors are dealt by ranges of their length, the id parting ties, so that a range holds vectors of like length however many
    are equal; within one, buckets of BUCKET vectors are pruned and searched. Queries are dealt into blocks of block_bytes.
    Each block first gets thresholds from the SEEDS longest vectors. A block and a range meet in one task, as rows that are
    sorted by block and range, unless no vector of the range is long enough for any threshold of the block. What comes
    to the driver is the number of rows. A range returns k rows of a query at most, and the best k of those are taken.

    Vectors that are null or hold null or non-finite components, and null ids, take no part. Rows that repeat an id count
    once for each score they have; an id with several vectors is a query with the smallest. Only vectors of equal numbers of
    dimensions are compared. A component or score beyond 64 bits is an error. Empty tables give no row, and names of other columns
    don't matter."""
    spark = vectors.sparkSession
    n = vectors.count()
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-n // range_rows), min(few, -(-n // (4 * BUCKET))))
    base = keep(scaled(vectors, key, vector, scale).repartitionByRange(ranges, "dim", "norm2", "id").withColumn("part", F.spark_partition_id()))
    queries = base.where(is_query(F.col("id"))).groupBy("dim", "id").agg(F.min("v").alias("v"))
    n_blocks = queries.groupBy("dim").agg(F.ceil(F.count("*") * F.col("dim") * 8 / F.lit(block_bytes)).cast("int").alias("of"))
    dealt = queries.join(n_blocks, "dim").select("dim", F.pmod(F.xxhash64("id"), F.greatest("of", F.lit(1))).cast("int").alias("block"), "id", "v")
    dealt = keep(dealt)
    place = W.partitionBy("dim").orderBy(F.desc("norm2"), "id", "v")
    longest = base.select("dim", "norm2", "id", "v", F.row_number().over(place).alias("n")).where(F.col("n") <= SEEDS)
    longest = longest.join(dealt.select("dim", "block").distinct(), "dim").select("dim", "block", F.lit(0).alias("tag"), "id", "v")
    order = ["dim", "block", "tag", "id", "v"]
    seeded = keep(with_thresholds(longest.unionByName(dealt.select("dim", "block", F.lit(1).alias("tag"), "id", "v")).repartition("dim", "block").sortWithinPartitions(*order), k))
    # a block can reach a range if the least length that some threshold of it asks for is in there
    lengths = base.groupBy("dim", "part").agg(F.max("norm2").alias("longest"))
    own = base.where(is_query(F.col("id"))).groupBy("dim", "id").agg(F.max("norm2").alias("norm2"))
    asks = F.when(F.col("floor") > 0, F.col("floor") / F.sqrt("norm2")).otherwise(F.lit(0.0))
    need = seeded.join(own, ["dim", "id"]).groupBy("dim", "block").agg(F.min(asks).alias("need"))
    meet = keep(need.join(lengths, "dim").where(F.sqrt("longest") >= F.col("need") * F.lit(1 - 1e-9)).select("dim", "block", "part"))
    asked = seeded.join(meet, ["dim", "block"]).select("dim", "part", "block", F.lit(0).alias("tag"), "id", "v", F.col("floor").alias("x"))
    held = base.join(meet, ["dim", "part"]).select("dim", "part", "block", F.lit(1).alias("tag"), "id", "v", F.col("norm2").alias("x"))
    rows = asked.unionByName(held).repartition("dim", "part", "block").sortWithinPartitions("dim", "part", "block", "tag", F.desc("x"), "id", "v")
    out = keep(searched(rows, k).distinct())
    for x in (base, dealt, seeded, meet):
        drop_kept(x)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: rows whose vec_id is divisible by 50, against all rows."""
    return top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 50 == 0)


ORACLE_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT vec_id, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM c AS q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
