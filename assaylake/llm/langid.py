"""Language identification: multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Ftrl, by_text, char_ngrams, fit_temperature, id_bucket, read, small_batches

#: Orders of the n-grams, log2 of the buckets they are hashed into, labelled rows that the classifier is fitted on at
#: most for each language and in all, passes over them, and characters of such a row's text that a step sees at once.
ORDERS, BITS, PER_CLASS, MOST_ROWS, EPOCHS = (1, 2, 3), 15, 600, 6000, 2
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
#: Numerals that \d doesn't hold, such as fractions: no letters either.
_NUMERALS = frozenset(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha())
_BLANK = dict.fromkeys(map(ord, _NUMERALS), " ")


def has_letter(text: str) -> bool:
    return next(filter(str.isalpha, text), None) is not None


def letters(text: str | None) -> str:
    """Lower-case words of letters with one space around each."""
    if not text:
        return ""
    if not text.isascii() and not _NUMERALS.isdisjoint(text):
        text = text.translate(_BLANK)
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def counts(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's n-grams, and how often each occurs; nothing if it has no letter."""
    words = letters(text)
    if not words.strip():
        return np.zeros(0, np.int64), np.zeros(0)
    n = np.zeros(1 << bits, np.int64)
    for at in range(0, len(words), 1 << 20):  # n-grams that cross a cut are in the overlap
        part = words[at : at + (1 << 20) + max(ORDERS) - 1] if at + (1 << 20) < len(words) else words[at:]
        n += np.bincount(char_ngrams(part, ORDERS, bits), minlength=1 << bits)
    at = np.flatnonzero(n)
    return at, n[at].astype(float)


def tf_idf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(1 + ln n) * idf, of unit length."""
    x = (1 + np.log(n)) * idf[at]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


def document_frequencies(docs: DataFrame, text: str, bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many texts with a letter each bucket occurs, over all of docs, and how many such texts there are.

    A task sums its own texts and gives a row for each bucket; what comes to the driver is one number for each bucket."""

    def batches(it):
        n, texts = np.zeros(1 << bits, np.int64), 0
        for batch in it:
            for t in batch.column(0):
                at, _ = counts(t.as_py(), bits)
                n[at] += 1
                texts += bool(len(at))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(n[at], texts), pa.int64())})

    rows = small_batches(docs).select(text).mapInArrow(batches, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((1 << bits) + 1, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out[:-1], int(out[-1])


class Model:
    """Languages, inverse document frequencies, weights (a row for each bucket and one for the bias) and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.temperature = langs, idf.astype(np.float32), weights.astype(np.float32), temperature

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return tf_idf(at, n, self.idf) @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its calibrated probability; ('und', 0) without a letter or a language learned."""
        if not self.langs or not text or not has_letter(text):
            return UNKNOWN, 0.0
        z = self.logits(*counts(text)) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def train(docs: DataFrame, text: str = "text", lang: str = "lang", learn: Column | None = None, key: str = "doc_id", per_class: int = PER_CLASS, most_rows: int = MOST_ROWS) -> Model:
    """Learns from the rows where learn holds and lang is known.

    Document frequencies are those of all these rows. The classifier is fitted on at most per_class rows of a language and
    most_rows in all, drawn by a hash of key and text; a fifth of them sets the temperature. The numbers of rows of each
    language are counted first, and the draw's rate follows from them."""
    rows = docs.where(F.col(lang).isNotNull() & (F.lit(True) if learn is None else F.coalesce(learn, F.lit(False)))).select(text, lang, key)
    sizes = {r[lang]: r["count"] for r in rows.groupBy(lang).count().collect()}
    df, n = document_frequencies(rows, text)
    idf = np.log((1 + n) / (1 + df)) + 1
    most = {x: min(per_class, max(1, most_rows // max(1, len(sizes)))) for x in sizes}
    rate = F.create_map(*[y for x, m in most.items() for y in (F.lit(x), F.lit(min(1.0, 1.1 * m / sizes[x])))]) if sizes else None
    if rate is None:
        return Model([], idf, np.zeros(((1 << BITS) + 1, 0)), 1.0)
    drawn = (F.xxhash64(F.lit("langid"), key, text) % F.lit(1 << 20)).cast("double") / F.lit(float(1 << 20))
    sample = rows.where(F.abs(drawn) < F.element_at(rate, F.col(lang)))

    def features(texts: list[str | None]) -> dict:
        both = [counts(t) for t in texts]
        return {c: pa.array([b[i].astype(np.int32).tobytes() for b in both], pa.binary()) for i, c in enumerate(("at", "n"))}

    got = sorted(by_text(sample, features, "at binary, n binary", text, (lang, key)).collect(), key=lambda r: (r[lang], str(r[key])))
    langs, seen, kept = sorted(sizes), dict.fromkeys(sizes, 0), []
    for r in got:
        if r["at"] and seen[r[lang]] < most[r[lang]]:
            seen[r[lang]] += 1
            kept.append((np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int32), langs.index(r[lang])))
    rng = np.random.default_rng(5)
    kept = [kept[i] for i in rng.permutation(len(kept))]
    held = len(kept) // 5 if len(kept) >= 20 else 0
    model = Ftrl(1 << BITS, len(langs), l1=0.02, l2=0.02)
    w = model.fit([(at, tf_idf(at, c, idf)) for at, c, _ in kept[held:]], np.array([y for *_, y in kept[held:]], int), EPOCHS)
    out = Model(langs, idf, w, 1.0)
    out.temperature = fit_temperature(np.array([out.logits(at, c) for at, c, _ in kept[:held]]).reshape(held, len(langs)), np.array([y for *_, y in kept[:held]], int))
    return out


def predict(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in carry, lang_pred and score of every row.

    Null, empty and letterless texts are 'und' with score 0. Texts are read whole, however long. Of languages that are equally
    likely the first in the alphabet counts. Repeated rows give a row each; an empty table gives none. A carried column named
    lang_pred or score gets an underscore behind its name; other columns take no part."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2**15 weights and inverse frequencies for each language, whatever the rows

    def of(texts: list[str | None]) -> dict:
        both = [shipped.value.predict(t) for t in texts]
        return {"lang_pred": pa.array([b[0] for b in both], pa.string()), "score": pa.array([b[1] for b in both], pa.float64())}

    return by_text(docs, of, "lang_pred string, score double", text, carry)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the language of every document; those of crc32(doc_id) mod 3 = 1 are held out from learning."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs, learn=F.coalesce(id_bucket("doc_id", 3) != 1, F.lit(True)))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(id_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
