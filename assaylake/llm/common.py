"""Helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that crosses to Python, where its rows are not larger themselves.
BATCH = "4m"
_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one if all runs on
    this machine, as in tests; on a cluster each executor would write to a disk of its own, so it is an error there."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="assaylake-")
    return _own_root[app]


def keep(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_root(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(df: DataFrame) -> None:
    """Deletes what keep() wrote for df."""
    files = df.inputFiles()
    if files:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def dealt_out(df: DataFrame) -> DataFrame:
    """df, whose join deals both sides out and broadcasts neither. Spark sizes what explode makes as if each row gave one, and a written
    table by its compressed bytes, so either may be broadcast though it is many times larger than the threshold."""
    return df.hint("merge")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_bucket(key: str | Column, n: int) -> Column:
    """crc32 of a key's decimal text, modulo n; null for a null key."""
    return F.pmod(F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")), F.lit(n))


def trim() -> None:
    """Gives what a worker has freed back to the system, where the C library can: a worker that waits for its next task
    holds no freed buffers."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(df: DataFrame) -> DataFrame:
    """df, after its session is set to hand Python batches of BATCH bytes at most: whole texts, but few of them at once."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return df


def apart(names: Sequence[str], own: Sequence[str]) -> list[str]:
    """names, each with underscores behind it until it is no other name's, whatever its case, and none of own's."""
    taken, out = {x.lower() for x in own}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(schema: str) -> list[str]:
    """The names at the top of a schema's text."""
    flat = schema
    while (less := re.sub(r"<[^<>]*>", "", flat)) != flat:
        flat = less
    return [x.split()[0].strip("`") for x in flat.split(",")]


def by_text(df: DataFrame, fn, schema: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), most_bytes: int = 8 << 20, after=None) -> DataFrame:
    """Applies fn(list of texts or None) -> dict of columns to df, batch by batch, and keeps the columns in carry. fn gets
    texts of about most_bytes together, or a longer one alone; after is called where a task's texts end.

    A carried column that is named as one of the results gets an underscore behind its name."""

    def batches(it):
        for batch in it:
            for a, n in _slices(batch.column(len(carry)), most_bytes):
                part = batch.slice(a, n)
                out = fn(part.column(len(carry)).to_pylist())
                yield pa.RecordBatch.from_pydict({f"_c{i}": part.column(i) for i in range(len(carry))} | out)
        if after is not None:
            after()
        trim()

    types, own = dict(df.dtypes), columns_of(schema)
    head = "".join(f"_c{i} {types[c]}, " for i, c in enumerate(carry))
    put = small_batches(df).select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)), F.col(f"`{text}`").alias("_t"))
    return put.mapInArrow(batches, head + schema).toDF(*apart(carry, own), *own)


def _slices(column: pa.Array, most_bytes: int = 8 << 20):
    """(offset, length) of runs of rows whose texts hold about most_bytes together; a longer text is a run of its own."""
    n = len(column)
    if not n:
        return [(0, 0)]
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64)
    ends, out, start = np.cumsum(sizes), [], 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        out.append((start, stop - start))
        start = stop
    return out


#: Odd multipliers of the 64-bit mixing steps.
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def char_ngrams(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Buckets below 2**bits of all character n-grams of the given orders, repeats included."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h, out, shift = np.zeros(len(c), np.uint64), [], np.uint64(64 - bits)
    for k in range(1, max(orders) + 1):
        if len(c) < k:
            break
        h = (h[: len(c) - k + 1] + c[k - 1 :] + np.uint64(1)) * _M1
        h ^= h >> np.uint64(31)
        if k in orders:
            out.append(((h * _M2) >> shift).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature that makes the labels y likeliest, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))).mean())

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Ftrl:
    """Multinomial logistic regression on sparse rows, trained one row at a time with follow-the-regularised-leader
    and elastic-net penalties (l1 makes weights zero, l2 shrinks them)."""

    def __init__(self, n_features: int, n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1):
        self.z = np.zeros((n_features + 1, n_classes))
        self.n = np.zeros((n_features + 1, n_classes))
        self.alpha, self.beta, self.l1, self.l2, self.bias = alpha, beta, l1, l2, n_features

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, seed: int = 7, weight: np.ndarray | None = None) -> np.ndarray:
        """The weights, one row for each feature and the bias last."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                at, x = np.append(rows[i][0], self.bias), np.append(rows[i][1], 1.0)
                w = self.weights(at)
                s = x @ w
                p = np.exp(s - s.max())
                p /= p.sum()
                p[y[i]] -= 1.0
                g = x[:, None] * p[None, :] * (1.0 if weight is None else weight[i])
                n = self.n[at]
                self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
                self.n[at] = n + g * g
        return self.weights()
