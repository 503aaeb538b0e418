"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all eligible texts. The weights are fitted on a bounded sample by
follow-the-regularised-leader with elastic-net penalties; a temperature, fitted on rows of the sample
that the weights haven't seen, calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .runtime import beside_text, crc32_text, map_batches, materialize, texts

BITS = 15
ORDERS = (1, 2, 3)
UNKNOWN = "und"


def ngrams(values: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, hashed n-grams with repeats) of each text that has a letter; other characters are spaces."""
    for low, high in textvec.batches(values):
        codes, at = textvec.join([x.lower() for x in values[low:high]])
        letter = textvec.classes()[codes] == 1
        codes = np.where(letter, codes, 32).astype(np.uint64)
        some = np.add.reduceat(letter, at[:-1]) > 0 if len(codes) else []
        mixed = codes * np.uint64(0x9E3779B97F4A7C15) ^ (codes >> np.uint64(7))
        gram = np.zeros(len(codes), np.uint64)
        hashed = []
        for k in ORDERS:
            # the value of order k at i is that of order k-1 at i-1, times an odd number, plus code i
            gram[1:] = gram[:-1] * np.uint64(0xD6E8FEB86659FD93)
            gram[0] = 0
            gram += mixed
            h = gram ^ (gram >> np.uint64(29))
            h *= np.uint64(0xBF58476D1CE4E5B9) + np.uint64(2 * k)
            hashed.append((h >> np.uint64(64 - BITS)).astype(np.uint16))
        for i in np.flatnonzero(some).tolist():
            a, b = at[i], at[i + 1] - 1
            yield low + i, np.concatenate([h[a + k : b] for k, h in enumerate(hashed)])


def tf(values: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i, grams in ngrams(values):
        counts = np.bincount(grams, minlength=1 << BITS)
        slots = counts.nonzero()[0]
        yield i, slots, 1 + np.log(counts[slots])


def unit(slots: np.ndarray, weight: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = weight * idf[slots]
    return x / max(np.sqrt(x @ x), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01, seed: int = 3) -> np.ndarray:
    """Weights (slots and a bias row, classes) by FTRL-proximal, one row at a time."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(slots):
        zs = z[slots]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[slots])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            slots, x = rows[i]
            slots, x = np.r_[slots, size - 1], np.r_[x, 1.0]
            w = weights(slots)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / alpha
            z[slots] += g - sigma * w
            n[slots] += g * g
    return weights(np.arange(size))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, on a fine grid of its logarithm."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 400))
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-15).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, values: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, calibrated probability); ``und`` and 0 for a text without a letter."""
        names, score = [UNKNOWN] * len(values), np.zeros(len(values))
        if self.languages:
            for i, slots, weight in tf(values):
                p = softmax((unit(slots, weight, self.idf) @ self.weights[slots] + self.weights[-1]) / self.temperature)
                k = int(p.argmax())
                names[i], score[i] = self.languages[k], p[k]
        return names, np.clip(score, 0, 1)


def train(docs: DataFrame, eligible: Column, fit_rows: int = 3_000, calibration: float = 0.2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on rows that are ``eligible`` and have a language.

    Document frequencies cover all of them, the weights and the temperature the first ``fit_rows`` by a
    hash of text and id, of which the share ``calibration`` is kept for the temperature. Without any
    such row every text is ``und``.
    """
    rows = docs.where(eligible & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for _, grams in ngrams(texts(b.column(0))):
                seen = np.zeros(1 << BITS, bool)
                seen[grams] = True
                total += seen
                n += 1
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, slots].astype(np.int32)), pa.array(np.r_[n, total[slots]])], ["slot", "n"])

    sums = map_batches(rows.select("_text"), frequency, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    df = np.zeros((1 << BITS) + 1)
    for r in sums.collect():  # one row a slot at most
        df[r["slot"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("_lang").to_pylist()
            found = [(langs[i], s.astype("<u2").tobytes(), w.astype("<f4").tobytes()) for i, s, w in tf(texts(b.column("_text")))]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.binary(), pa.binary()))], ["lang", "slots", "tf"])

    chosen = materialize(rows.select(F.xxhash64("_text", "_id").alias("_order"), "_id").orderBy("_order", "_id").limit(fit_rows))
    sample = rows.withColumn("_order", F.xxhash64("_text", "_id")).join(F.broadcast(chosen.select("_order").distinct()), "_order")  # fit_rows at most
    data = sorted((r["slots"], r["tf"], r["lang"]) for r in map_batches(sample.drop("_order", "_id").limit(fit_rows), counts, "lang string, slots binary, tf binary").collect())
    languages = sorted({x[2] for x in data})
    x = [(s := np.frombuffer(a, "<u2").astype(np.int64), unit(s, np.frombuffer(b, "<f4").astype(float), idf)) for a, b, _ in data]
    y = np.array([languages.index(k) for _, _, k in data], int)
    order = np.random.default_rng(1).permutation(len(x))
    cut = len(x) - int(calibration * len(x))
    fit, held = order[:cut], order[cut:]
    if not languages:
        return Model([], idf, np.zeros(((1 << BITS) + 1, 0)), 1.0)
    w = ftrl([x[i] for i in fit], y[fit], len(languages))
    logits = np.array([x[i][1] @ w[x[i][0]] + w[-1] for i in held]).reshape(-1, len(languages))
    return Model(languages, idf, w.astype(np.float64), temperature(logits, y[held]))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every row of ``docs``, lang_pred and lang_score, from whole texts alone.

    A null or empty text, and any without a letter, is ``und`` with score 0; of languages equally likely the first by
    name is taken; rows that repeat a text have the same result. Columns of ``docs`` called lang_pred or lang_score are
    replaced. An empty table gives no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "lang_score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed number of slots by languages
    source, fields = beside_text(docs, keep, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shared.value.predict(texts(b.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "lang_score"])

    return map_batches(source, run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


def held_out_fifth(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc32_text(id_col) % 5 == 0, F.lit(False))
