"""Quality by importance resampling.

Two generative models over hashed unigrams and bigrams of tokens, one of the target texts and one of
all raw texts, give each document a log ratio; adding Gumbel noise and keeping the largest k is a sample
without replacement with these ratios as weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .runtime import map_batches, materialize, texts

BITS = 16


def grams(values: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, hashed unigrams and bigrams) of each text; tokens are runs of word or of other characters."""
    for low, high in textvec.batches(values):
        codes, at = textvec.join([x.lower() for x in values[low:high]])
        kind = textvec.classes()[codes]
        begin, end = textvec.spans(np.where(kind == 2, 1, kind))
        token = textvec.Hasher(codes).of(begin, end)
        cuts = np.searchsorted(begin, at)
        one = (token >> np.uint64(64 - BITS)).astype(np.uint16)
        pair = token[:-1] * np.uint64(0xD6E8FEB86659FD93) + token[1:] if len(token) else token
        two = ((pair ^ pair >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.uint16)
        for i in range(high - low):
            a, b = cuts[i], cuts[i + 1]
            yield low + i, np.concatenate([one[a:b], two[a : max(a, b - 1)]])


def model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of each hashed n-gram over all rows: one number a slot reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for b in batches:
            for _, g in grams(texts(b.column(0))):
                total += np.bincount(g, minlength=1 << BITS)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total[slots])], ["slot", "n"])

    out = np.zeros(1 << BITS)
    for r in map_batches(docs.select(F.col(text_col).alias("_text")), count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    t, r = target + smoothing, raw + smoothing
    return np.log(t / t.sum()) - np.log(r / r.sum())


def threshold(scores: DataFrame, value: str, k: int, digits: int = 16) -> tuple[int, int, int]:
    """The ``k``-th largest of the long column ``value``, how many rows have it, and how many of them are in the first k.

    A radix selection: each round counts the rows by the next ``digits`` bits, at most 2**digits numbers.
    ``k`` is from 1 to the number of rows.
    """
    above, prefix, same = 0, 0, 0
    flipped = F.col(value).bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    for shift in range(64 - digits, -1, -digits):
        rows = scores if shift == 64 - digits else scores.where(F.shiftrightunsigned(flipped, shift + digits) == F.lit(prefix))
        digit = F.shiftrightunsigned(flipped, shift).bitwiseAND(F.lit((1 << digits) - 1))
        counts = {r["d"]: r["n"] for r in rows.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()}
        for d in sorted(counts, reverse=True):
            if above + counts[d] >= k:
                prefix, same = prefix << digits | d, counts[d]
                break
            above += counts[d]
    return prefix - (1 << 63), same, k - above


def first_k(rows: DataFrame, columns: list[str], k: int) -> Column:
    """Condition that holds for exactly the ``k`` largest rows by the long ``columns``, the last of them unique."""
    n = rows.count()
    if k <= 0 or k >= n:
        return F.lit(k > 0)
    at, same, k = threshold(rows, columns[0], k)
    here = F.col(columns[0])
    if k == same:
        return here >= F.lit(at)
    return (here > F.lit(at)) | ((here == F.lit(at)) & first_k(rows.where(here == F.lit(at)), columns[1:], k))


def resample(docs: DataFrame, target: DataFrame, k: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_grams, log_weight, gumbel_key, selected.

    ``docs`` is the raw corpus and ``target`` the texts to resemble. The ``k`` rows with the largest
    log_weight + Gumbel noise are selected; the noise is a function of seed, identifier and text. Null
    texts are empty and have weight 0 on the log scale. Ties go to the smaller identifier; rows that
    repeat identifier and text count one by one. With k of at least the number of rows all are selected. An
    empty corpus gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ratio = spark.sparkContext.broadcast(log_ratio(model(target, text_col), model(docs, text_col)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for b in batches:
            values = texts(b.column("text"))
            n, total = np.zeros(len(values), np.int64), np.zeros(len(values))
            for i, g in grams(values):
                n[i], total[i] = len(g), table[g].sum()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(total), b.column("noise")], ["doc_id", "n_grams", "log_weight", "noise"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), (-F.log(-F.log(uniform))).alias("noise"))
    weighed = map_batches(source, weigh, "doc_id long, n_grams long, log_weight double, noise double").withColumn("gumbel_key", F.col("log_weight") + F.col("noise"))
    ordered = materialize(
        weighed.drop("noise").withColumns(
            {"_key": _ordered_bits(F.col("gumbel_key")), "_id": F.bitwise_not(F.coalesce("doc_id", F.lit((1 << 63) - 1))), "_row": F.bitwise_not(F.monotonically_increasing_id())}
        )
    )
    return ordered.withColumn("selected", first_k(ordered, ["_key", "_id", "_row"], k)).drop("_key", "_id", "_row").withColumnRenamed("doc_id", id_col)


def _ordered_bits(value: Column) -> Column:
    """A long in the order of the doubles ``value``: fixed-point, 2**-20 apart."""
    return F.round(F.greatest(F.least(value, F.lit(8e12)), F.lit(-8e12)) * F.lit(float(1 << 20))).cast("long")
