"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _slices, apart, drop_kept, keep, mix, read, small_batches, trim

#: Words of a window, and of a k-gram. The smallest of WINDOW - GRAM + 1 neighbouring k-grams is kept, so that
#: every shared run of WINDOW words shares a kept k-gram.
WINDOW, GRAM = 10, 5
#: Bits of the filter of item fingerprints for each of them, and log2 of its least and most bits. It only spares rows that the
#: join would drop: where it is full, all go to the join.
FILTER_BITS, FILTER_LEAST, FILTER_MOST = 32, 20, 27
#: Rows that a task hands on at once.
ROWS = 1 << 15

LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
IS_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


#: Powers that are kept, and bytes of a piece that words' hashes are made of at once; a longer word is a piece of its own.
USUAL, PIECE = 1 << 19, 1 << 18
_made: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; the longest made for usual pieces is kept."""
    if len(_made.get(base, ())) >= n:
        return _made[base][:n]
    out = np.ones(max(n, USUAL), np.uint64)
    done, step = 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while done < len(out):
            out[done : 2 * done] = out[: min(done, len(out) - done)] * step
            step, done = step * step, 2 * done
    if len(out) == USUAL:
        _made[base] = out
    return out[:n]


class Words:
    """The words of one or more texts, given as the bytes of them all with a byte that is no word between two: their
    places in the bytes, and 64-bit hashes that equal words share. Bytes of 128 and more are word characters all.
    Hashes are made piece by piece, so a very long text needs no more memory at once than its bytes and words."""

    def __init__(self, data: np.ndarray, piece: int = PIECE):
        self.data = LOWER[data]
        inside = IS_WORD[self.data]
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hash = np.zeros(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + piece, "right")))
            self.hash[i:j] = self._hashes(self.start[i:j], self.end[i:j])
            i = j

    def _hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A polynomial in each word's bytes, from differences of running sums."""
        a, b = int(start[0]), int(end[-1])
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((self.data[a:b].astype(np.uint64) + np.uint64(1)) * _powers(b - a, BASE), out=total[1:])
        return mix((total[end - a] - total[start - a]) * _powers(b - a, INVERSE)[start - a])

    def runs(self, k: int) -> np.ndarray:
        """A hash of each run of k words."""
        n = len(self.hash) - k + 1
        out = np.zeros(max(n, 0), np.uint64)
        for j in range(k):
            out = mix(out + self.hash[j : j + max(n, 0)]) if n > 0 else out
        return out

    def text(self, at: int, k: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[at : at + k].tolist(), self.end[at : at + k].tolist(), strict=True))


def winnowed(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the k-grams that are smallest in some window of width; ties are all kept."""
    n = len(grams) - width + 1
    if n < 1:
        return np.zeros(0, np.int64)
    low = grams[:n].copy()
    for j in range(1, width):
        np.minimum(low, grams[j : j + n], out=low)
    # the largest of the minima of the windows that hold a place: it is kept if it equals that
    most = np.zeros(len(grams), np.uint64)
    for j in range(width):
        np.maximum(most[j : j + n], low, out=most[j : j + n])
    return np.flatnonzero(most == grams)


def sides(w: Words, doc: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, their places): the kept k-grams of the texts one after the other. Kept are all that are smallest in a
    window of words, so that a shared window has a kept k-gram in common, at the same place in it."""
    grams = w.runs(gram)
    at = winnowed(grams, window - gram + 1)
    at = at[doc[at] == doc[at + gram - 1]]
    return grams[at], at


def short(w: Words, k: int) -> np.ndarray:
    """Fingerprints of all runs of k words, for items that are no longer; apart from those of k-grams and of other k."""
    return mix(w.runs(k) + np.uint64(k))


def identity(w: Words, at: int, k: int) -> tuple[int, int]:
    """128 bits of hash of k words: two runs of words are taken as equal if these are."""
    h = np.frombuffer(xxhash.xxh3_128_digest(w.text(at, k), 10), "<i8")
    return int(h[0]), int(h[1])


def pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """(first row, rows, their words, the row of each word) of runs of texts."""
    for a, n in _slices(column, most):
        texts = [x.encode("utf-8", "surrogatepass") if x else b"" for x in column.slice(a, n).to_pylist()]
        ends = np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)
        w = Words(np.frombuffer(b" ".join([*texts, b""]), np.uint8))
        yield a, n, w, np.searchsorted(ends, w.start, "right")


def item_windows(items: DataFrame, window: int, gram: int) -> DataFrame:
    """(item, k, h1, h2, g): each window of each item, by its number of words and its hash, and its fingerprints: one row for
    each kept k-gram in it. An item of fewer words than a window is one window, and its fingerprint is its own."""

    def batches(it):
        for batch in it:
            cols: list[list] = [[], [], [], [], []]
            for i, text in enumerate(batch.column(1)):
                for *_, w, doc in pieces(pa.array([text.as_py()], pa.string())):
                    n = len(w.hash)
                    if not n:
                        continue
                    k = min(window, n)
                    if k == window:
                        g, at = sides(w, doc, window, gram)
                        g = g.view(np.int64)
                    for s in range(n - k + 1):
                        own = g[np.searchsorted(at, s) : np.searchsorted(at, s + window - gram, "right")].tolist() if k == window else short(w, k).view(np.int64).tolist()
                        h = identity(w, s, k)
                        for x in own:
                            for c, v in zip(cols, (batch.column(0)[i].as_py(), k, *h, x), strict=True):
                                c.append(v)
                        if len(cols[0]) >= ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)
                            cols = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    names, kinds = ["item", "k", "h1", "h2", "g"], [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return small_batches(items).mapInArrow(batches, "item string, k int, h1 long, h2 long, g long")


def filter_of(prints: DataFrame, n: int) -> np.ndarray:
    """A bit for each value that the upper bits of an item's fingerprint have. Its size follows from the number of
    fingerprints and has a bound (2**FILTER_MOST bits), and so has what comes to the driver: a row for each 64 bits."""
    bits = min(FILTER_MOST, max(FILTER_LEAST, (FILTER_BITS * n).bit_length()))
    slot = F.shiftrightunsigned(F.col("g"), 64 - bits)
    rows = prints.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(g, {64 - bits}) & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def passes(filt: np.ndarray, g: np.ndarray) -> np.ndarray:
    slot = g >> np.uint64(64 - (len(filt).bit_length() + 5))
    return (filt[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def scanned(docs: DataFrame, filt: np.ndarray, lengths: list[int], window: int, gram: int) -> DataFrame:
    """(row, key, n_words, prints): every row of docs (key, text) once, with the fingerprints of its text that pass the filter.

    prints holds (g, place, ws): ws are the windows that a hit of g would extend to, as (start, k, h1, h2)."""
    shipped = docs.sparkSession.sparkContext.broadcast(filt)  # 2**FILTER_MOST bits at most
    ws = pa.list_(pa.struct([("at", pa.int32()), ("k", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]))
    prints = pa.list_(pa.struct([("g", pa.int64()), ("ws", ws)]))

    def batches(it):
        f = shipped.value
        for whole in it:
            for a, n, w, doc in pieces(whole.column(2)):
                n_words = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
                first = np.concatenate(([0], np.cumsum(n_words)))
                out: dict[int, list] = {}
                known: dict[int, tuple[int, int]] = {}
                for k in lengths:
                    if len(w.hash) < k:
                        continue
                    if k == window:
                        g, at = sides(w, doc, window, gram)
                    else:
                        g = short(w, k)
                        at = np.flatnonzero(doc[: len(g)] == doc[k - 1 :])
                        g = g[at]
                    live = passes(f, g)
                    reach = window - gram if k == window else 0
                    for x, i in zip(g[live].view(np.int64).tolist(), at[live].tolist()):
                        d, own = int(doc[i]), []
                        for s in range(max(int(first[d]), i - reach), min(i, int(first[d + 1]) - k) + 1):
                            if k != window:
                                h = identity(w, s, k)
                            elif (h := known.get(s)) is None:
                                h = known[s] = identity(w, s, k)
                            own.append({"at": s - int(first[d]), "k": k, "h1": h[0], "h2": h[1]})
                        if own:
                            out.setdefault(d, []).append({"g": x, "ws": own})
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(a, n), whole.column(1).slice(a, n), pa.array(n_words, pa.int64()), pa.array([out.get(i, []) for i in range(n)], prints)], ["row", "key", "n_words", "prints"])
        trim()

    kind = dict(docs.dtypes)["key"]
    return small_batches(docs).select(F.monotonically_increasing_id().alias("row"), "key", "text").mapInArrow(batches, f"row long, key {kind}, n_words long, prints array<struct<g:long,ws:array<struct<at:int,k:int,h1:long,h2:long>>>>")


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, n_words, hit, items), one row for each row of docs: places of the words in any occurrence of an item's window, and
    the items with one.

    Kept k-grams of documents and items are joined by their hashes; what meets is extended to the windows around it, and those are
    joined with the items' windows. Both joins are of tables, whatever the benchmark's size; a window that many items hold is
    one row, and its items are listed once for all windows of the same items. A filter of bounded size, of the
    benchmark's fingerprints, spares documents' fingerprints that could not meet any. Texts stay where they are.

    Null and empty texts have no words; items of a null id hit words without a place in the list of items; an item that
    repeats counts once, and rows of one id are one item. Rows count one by one, whether their key repeats or is null. Texts are
    read whole, however long. A key named as one of the results gets an underscore behind its name; other columns take no
    part. Empty tables of either kind hit nothing."""
    own = items.select(F.col(f"`{item_key}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("text"))
    rows = keep(item_windows(own, window, gram).distinct())
    prints = keep(rows.select("g").distinct())
    lengths = sorted(r["k"] for r in rows.select("k").distinct().collect())  # window numbers at most
    filt = filter_of(prints, prints.count())
    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    scan = keep(scanned(named, filt, lengths, window, gram))
    # a hit of a fingerprint, extended to the windows around it
    cand = scan.where(F.size("prints") > 0).select("row", F.explode("prints").alias("p")).select("row", F.col("p.g").alias("g"), F.col("p.ws").alias("ws"))
    near = cand.join(prints, "g").select("row", F.explode("ws").alias("w")).select("row", "w.*").distinct()
    # windows of the same items have one set of them: the sums of two hashes of the ids, and how many they are
    held = keep(rows.select("item", "h1", "h2").distinct())
    ids = [F.sum(F.when(F.col("item").isNotNull(), F.xxhash64(F.lit(x), "item").cast("decimal(20,0)"))).alias(f"x{x}") for x in (1, 2)]
    windows = keep(held.groupBy("h1", "h2").agg(F.count("item").alias("n"), *ids).withColumn("set", F.when(F.col("n") > 0, F.concat_ws(":", "n", "x1", "x2"))).select("h1", "h2", "set"))
    one = windows.where("set IS NOT NULL").groupBy("set").agg(F.min(F.struct("h1", "h2")).alias("w")).select("set", "w.*")
    sets = keep(one.join(held.where("item IS NOT NULL"), ["h1", "h2"]).select("set", "item"))
    found = keep(near.join(windows, ["h1", "h2"]).select("row", "at", "k", "set"))
    places = found.groupBy("row").agg(F.collect_set(F.struct("at", "k")).alias("x"))
    places = places.select("row", F.array_sort(F.array_distinct(F.flatten(F.transform("x", lambda w: F.sequence(w["at"], w["at"] + w["k"] - 1))))).alias("hit"))
    which = found.where("set IS NOT NULL").select("row", "set").distinct().join(sets, "set").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    out = scan.select("row", "key", "n_words").join(keep(places.join(which, "row", "left")), "row", "left")
    for x in (rows, prints, held, sets, windows, found):
        drop_kept(x)
    return out.select(F.col("key").alias(apart([key], ["n_words", "hit", "items"])[0]), "n_words", none("hit", "array<int>").alias("hit"), none("items", "array<string>").alias("items"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: how much of each document stands in the benchmark."""
    out = hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), found AS (
  SELECT g.doc_id, g.i, g.k, v.item_id FROM grams g JOIN windows v ON g.k = v.k AND g.t = v.t
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places p ON d.doc_id = p.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""
