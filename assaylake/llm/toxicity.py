"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Ftrl, apart, by_text, char_ngrams, id_bucket, keep, read, small_batches, trim

#: Orders of the n-grams, log2 of the buckets they are hashed into, n-grams that the classifier keeps, labelled rows
#: of each class that the ratios and that the weights are fitted on at most, and passes over the latter.
ORDERS, BITS, FEATURES, MOST_ROWS, PER_CLASS, EPOCHS = (4, 5, 6), 20, 1 << 15, 100_000, 2500, 4
#: Standard errors between the classes' shares that an n-gram needs to be kept, and rows that it must be in.
LEAST_Z, LEAST_DF = 4.0, 3


def buckets(text: str | None) -> np.ndarray:
    """The distinct buckets of a whole text's n-grams, in lower case and with single spaces around words."""
    words = f" {' '.join(text.lower().split())} " if text else ""
    if not words.strip():
        return np.zeros(0, np.int64)
    step, over = 1 << 18, max(ORDERS) - 1
    return np.unique(np.concatenate([np.unique(char_ngrams(words[at : at + step + over], ORDERS, BITS)) for at in range(0, max(1, len(words) - over), step)]))


class Model:
    """A weight for each bucket (0 for most) and a bias. The weight holds the classifier's own and the log-count ratio."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, bias: float):
        self.at, self.weights, self.bias = at.astype(np.int32), weights.astype(np.float32), bias
        self._dense = None

    def __getstate__(self):
        return self.at, self.weights, self.bias

    def __setstate__(self, state):
        self.at, self.weights, self.bias = state
        self._dense = None

    def score(self, text: str | None) -> float:
        """The probability of label 1; a text without n-grams gets the bias's."""
        if self._dense is None:
            self._dense = np.zeros(1 << BITS, np.float32)
            self._dense[self.at] = self.weights
        z = self.bias
        if text:
            words = f" {' '.join(text.lower().split())} "
            step, over, found = 1 << 18, max(ORDERS) - 1, []
            if words.strip():
                for at in range(0, max(1, len(words) - over), step):
                    b = char_ngrams(words[at : at + step + over], ORDERS, BITS)
                    found.append(np.unique(b[self._dense[b] != 0]))  # buckets of no weight add nothing
                z += float(self._dense[np.unique(np.concatenate(found))].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def class_counts(rows: DataFrame, text: str, label: str) -> tuple[DataFrame, tuple[int, int]]:
    """(bucket, n0, n1): in how many rows of each class each bucket occurs, over all rows; and the numbers of rows.

    A task sums its own rows and gives a row for each bucket it saw."""

    def batches(it):
        n, rows = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for batch in it:
            for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                n[y, buckets(t.as_py())] += 1
                rows[y] += 1
        at = np.flatnonzero(n.any(axis=0))
        trim()
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(at, -1), pa.int32()), "n0": pa.array(np.append(n[0, at], rows[0]), pa.int64()), "n1": pa.array(np.append(n[1, at], rows[1]), pa.int64())})

    found = keep(small_batches(rows).select(text, label).mapInArrow(batches, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    n = found.where("bucket = -1").first()
    return found.where("bucket >= 0"), (n["n0"], n["n1"]) if n else (0, 0)


def train(rows: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", features: int = FEATURES, per_class: int = PER_CLASS) -> Model:
    """Learns from labelled rows (label 0 or 1).

    The log-count ratios are those of all rows given. The classifier on the scaled n-grams is fitted on at most per_class rows
    of each class, drawn by a hash of key and text at a rate that follows from the counted rows; classes count by
    their shares in all rows. Only n-grams whose shares differ between the classes by LEAST_Z standard errors take part,
    the features clearest of them. Without rows of both classes nothing can be told apart: the score is 0.5 with no row,
    and else the share of label 1 with one row of each class added."""
    counts, n = class_counts(rows, text, label)
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    if not all(n):
        return Model(np.zeros(0, np.int64), np.zeros(0), prior)
    p0, p1 = ((F.col(f"n{y}") + 1.0) / (n[y] + 2.0) for y in (0, 1))
    pooled = (F.col("n0") + F.col("n1") + 1.0) / (sum(n) + 2.0)
    z = F.abs(p1 - p0) / F.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]))
    clear = counts.select("bucket", F.ln(p1 / p0).alias("ratio"), z.alias("z")).where((F.col("z") >= min(LEAST_Z, min(n) ** 0.5)) & (F.col("n0") + F.col("n1") >= LEAST_DF))
    clear = sorted((r["bucket"], r["ratio"]) for r in clear.orderBy(F.desc("z"), "bucket").limit(features).collect())
    fit_for, ratio = np.array([c[0] for c in clear], np.int64), np.array([c[1] for c in clear], float)
    sc = rows.sparkSession.sparkContext
    shipped = sc.broadcast(fit_for.astype(np.int32))  # at most as many numbers as features, whatever the rows

    def seen(texts: list[str | None]) -> dict:
        place = np.full(1 << BITS, -1, np.int32)
        place[shipped.value] = np.arange(len(shipped.value))
        at = [place[buckets(t)] for t in texts]
        return {"at": pa.array([a[a >= 0].tobytes() for a in at], pa.binary())}

    drawn = F.abs((F.xxhash64(F.lit("toxicity"), key, text) % F.lit(1 << 20)).cast("double")) / F.lit(float(1 << 20))
    rates = [min(1.0, 1.1 * per_class / int(x)) for x in n]
    sample = rows.where(drawn < F.when(F.col(label) == 1, rates[1]).otherwise(rates[0]))
    got = sorted(by_text(sample, seen, "at binary", text, (label, key)).collect(), key=lambda r: (r[label], str(r[key])))
    kept, used = [], [0, 0]
    for r in got:
        if used[r[label]] < per_class:
            used[r[label]] += 1
            kept.append((np.frombuffer(r["at"], np.int32), r[label]))
    # a row stands for as many as its class has to each drawn, so that the bias fits the shares in all rows
    share = [n[y] / max(1, used[y]) for y in (0, 1)]
    most = max(share)
    x = [(at, np.clip(ratio[at], -8, 8)) for at, _ in kept]
    y = np.array([label for _, label in kept], int)
    model = Ftrl(len(fit_for), 2, alpha=0.1, l1=0.01, l2=0.05)
    w = model.fit(x, y, EPOCHS, weight=np.array([max(share[label] / most, 0.02) for label in y]))
    own = (w[:-1, 1] - w[:-1, 0]) * np.clip(ratio, -8, 8)
    live = own != 0
    return Model(fit_for[live], own[live], float(w[-1, 1] - w[-1, 0]))


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", learn: Column | None = None, most: int = MOST_ROWS) -> DataFrame:
    """(key, text, label): texts of docs with a label of 0 or 1 that may be learned from, at most about most of each class.

    Where a class has more labels, they are drawn by a hash of the key at a rate that follows from their count. So the labels that
    go to all tasks have a bound, and texts stay where they are. A label row is taken once for each document row of its
    key, the labels of a key that has several as often as they stand."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("label"))
    if learn is not None:
        rows = rows.where(learn)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    drawn = F.abs((F.xxhash64(F.lit("label"), key) % F.lit(1 << 30)).cast("double")) / F.lit(float(1 << 30))
    rates = [min(1.0, most / max(1, sizes.get(y, 0))) for y in (0, 1)]
    rows = rows.where(drawn < F.when(F.col("label") == 1, rates[1]).otherwise(rates[0]))
    return docs.where(F.col(text).isNotNull()).select(key, text).join(F.broadcast(rows), key)  # 2 * most short rows, whatever the tables


def score(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in carry and toxicity, the probability of label 1, of every row.

    Only the text goes to Python, and only the probability comes back, whatever columns are carried. Null and empty texts
    get the probability of the bias alone; texts are read whole, however long; repeated rows give a row each, and equal texts
    one score; an empty table gives none. A carried column named toxicity gets an underscore behind its name."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shipped.value
        for batch in batches:
            yield pa.array([m.score(t.as_py()) for t in batch], pa.float64())
        trim()

    return small_batches(docs).select(*(F.col(f"`{c}`").alias(n) for c, n in zip(carry, apart(carry, ["toxicity"]), strict=True)), of(F.col(f"`{text}`")).alias("toxicity"))


def trained(spark, sf_dir: str) -> Model:
    """The model of documents and labels in sf_dir; rows of crc32(doc_id) mod 5 = 0 are held out."""
    return train(labelled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), learn=id_bucket("doc_id", 5) != 0))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every document's score."""
    out = score(read(spark, sf_dir, "documents"), trained(spark, sf_dir))
    held = F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
