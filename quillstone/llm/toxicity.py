"""Toxicity by a factorization machine over hashed terms.

The terms of a passage are its lower-case words and their prefixes of 3, 4 and 5 letters (inflected
insults share a prefix), hashed. The machine adds to the linear weights the products of learned
factors of every pair of terms that occur together. A text is cut into overlapping passages, each scored
alone, and has the score of its worst passage: sums over pairs don't grow with the text, and what is said
together must stand together. The machine learns from every term of a bounded sample of labelled rows; no
term is left out by a test of its own, since a word may be toxic only beside another.
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
from .runtime import beside_text, crc32_text, map_batches, materialize, release_memory, texts

BITS = 20
PREFIXES = (3, 4, 5)
#: Words of one cell; two neighbouring cells of a text are a passage, so any CELL words in a row share one.
CELL = 64
#: Added to AdaGrad's root: a term's first steps follow the size of its gradient.
DAMP = 0.05
#: Ridge on linear weights and on factors, times the root of (mean terms of a passage / number of texts).
RIDGE_LINEAR, RIDGE_FACTORS = 0.07, 0.27
#: Parameters nearer to 0 than this are 0 in the fitted machine.
LEAST = 1e-3
#: Terms whose parameters are gathered at once, and rows of parameters that are made or shrunk at once.
TOGETHER = 1 << 16


def passages(values: list[str], active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each passage, where each passage begins in the terms and their end, terms).

    A passage's terms are distinct and sorted, and only those marked in ``active`` if that is given. Every
    text has one passage at least, which may be empty.
    """
    owners, sizes, terms = [], [], []
    for low, high in textvec.batches(values):
        codes, at = textvec.join([x.lower() for x in values[low:high]])
        begin, end = textvec.spans((textvec.classes()[codes] == 1).astype(np.uint8))
        hasher, first = textvec.Hasher(codes), np.searchsorted(begin, at)
        words = np.diff(first)
        cells = np.maximum(1, -(-words // CELL))
        base = np.cumsum(cells) - cells
        text = np.repeat(np.arange(high - low), words)
        cell = base[text] + (np.arange(len(begin)) - first[text]) // CELL
        owner = np.repeat(np.arange(high - low), cells)
        keys = []
        for k in (0, *PREFIXES):
            some = end - begin > k if k else slice(None)
            b = begin[some]
            term = hasher.of(b, b + k if k else end) ^ np.uint64(k * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)
            term = (term >> np.uint64(64 - BITS)).astype(np.int64)
            key = cell[some] << BITS | term
            keys.append(key[active[term]] if active is not None else key)
        key = np.unique(np.concatenate(keys))
        at_cell = key >> BITS
        # passage c is cells c and c + 1 of a text; the last cell has none of its own unless it is alone
        last = np.zeros(len(owner), bool)
        last[base + cells - 1] = True
        opens = ~last | (cells[owner] == 1)
        follows = np.ones(len(owner), bool)
        follows[base] = False
        key = np.unique(np.concatenate([key[opens[at_cell]], key[follows[at_cell]] - (1 << BITS)]))
        sizes.append(np.bincount(key >> BITS, minlength=len(owner))[opens])
        owners.append(owner[opens] + low)
        terms.append(key & ((1 << BITS) - 1))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *owners]), np.cumsum(np.concatenate([[0], *sizes])).astype(np.int64), np.concatenate([none, *terms])


def sums(rows: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the slices of ``rows`` from each of ``begin`` to the next; an empty slice gives 0."""
    out = np.zeros((len(begin) - 1, *rows.shape[1:]), rows.dtype)
    full = begin[1:] > begin[:-1]
    if full.any():
        out[full] = np.add.reduceat(rows, begin[:-1][full], axis=0)
    return out


def margins(params: np.ndarray, at: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(w.x + (|Vx|^2 - sum of |v_i|^2 x_i) / 2, Vx) of each passage; ``params`` are rows (w, v) that ``at`` points to.

    Parameters are gathered for as many passages at once as have TOGETHER terms, or for one.
    """
    total, squares = np.empty((len(begin) - 1, params.shape[1]), params.dtype), np.empty(len(begin) - 1, params.dtype)
    square = (params[:, 1:] ** 2).sum(axis=1)
    low = 0
    while low < len(total):
        high = max(low + 1, int(np.searchsorted(begin, begin[low] + TOGETHER, "right")) - 1)
        some, edges = at[begin[low] : begin[high]], begin[low : high + 1] - begin[low]
        total[low:high], squares[low:high] = sums(params[some], edges), sums(square[some], edges)
        low = high
    vx = total[:, 1:]
    return total[:, 0].astype(float) + 0.5 * ((vx**2).sum(axis=1) - squares), vx


def gradient(params: np.ndarray, at: np.ndarray, begin: np.ndarray, vx: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``params`` that some passage has, the loss's gradient there) for the loss's ``slope`` at each passage's margin."""
    passage = np.repeat(np.arange(len(slope)), np.diff(begin))
    order = np.argsort(at, kind="stable")
    ranked = at[order]
    edge = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, np.int64)
    hit = ranked[edge]
    each = np.concatenate([slope[:, None], slope[:, None] * vx], axis=1).astype(params.dtype)
    out = np.add.reduceat(each[passage[order]], edge, axis=0) if len(edge) else np.empty((0, params.shape[1]), params.dtype)
    out[:, 1:] -= params[hit, 1:] * out[:, :1]
    return hit, out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def worst(margin: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The passage with the largest margin of each text, the first of equal ones; ``first`` are the texts' first passages."""
    text = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(margin)]))
    top = np.flatnonzero(margin == np.maximum.reduceat(margin, first)[text])
    return top[np.r_[True, text[top][1:] != text[top][:-1]]]


@dataclass
class Machine:
    """``scale`` * (the worst passage's margin) + ``bias``, on the logistic scale."""

    slots: np.ndarray  # 1 + place in params of each hashed term, 0 if it says nothing
    params: np.ndarray  # (w, v) of each term
    scale: float
    bias: float

    def margins(self, values: list[str]) -> np.ndarray:
        if not len(self.params) or not values:
            return np.zeros(len(values))
        owner, begin, term = passages(values, self.slots > 0)
        margin, _ = margins(self.params, self.slots[term] - 1, begin)
        return np.maximum.reduceat(margin, np.searchsorted(owner, np.arange(len(values))))

    def score(self, values: list[str]) -> np.ndarray:
        return sigmoid(self.scale * self.margins(values) + self.bias)


def _batches(x_rows: list[np.ndarray], first: np.ndarray, order: np.ndarray, size: int) -> Iterator[tuple]:
    """(texts, first passage of each, begin of each passage, places in ``cols``, cols) of fixed batches of texts."""
    ends = np.r_[first[1:], len(x_rows)]
    for low in range(0, len(order), size):
        some = order[low : low + size]
        own = [x_rows[p] for i in some for p in range(first[i], ends[i])]
        cols, at = np.unique(np.concatenate(own), return_inverse=True)
        begin = np.cumsum([0, *map(len, own)])
        yield some, np.cumsum(np.r_[0, (ends - first)[some]])[:-1], begin, at.astype(np.uint16 if len(cols) < 1 << 16 else np.int32), cols


def fit(x_rows: list[np.ndarray], y: np.ndarray, terms: int, factors: int = 8, epochs: int = 10, batch: int = 64, rate: float = 0.2, steps: int = 800, first: np.ndarray | None = None, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, w, v) by AdaGrad on the logistic loss of each text's worst passage, both labels with the same weight in sum.

    ``x_rows`` has the places of each passage's terms and ``first`` the first passage of each text (None: each
    passage is a text). The ridge holds factors down more than linear weights, and shrinks every parameter in
    every step, though a term is only touched, and its shrinking made up for, when a passage has it. Few rows
    are gone over until there were ``steps`` steps. ``x_rows`` is emptied as soon as its batches are made, which take half as much.
    """
    rng = np.random.default_rng(seed)
    first = np.arange(len(x_rows)) if first is None else first
    n = len(first)
    share = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    params = np.zeros((terms, 1 + factors), np.float32)
    for low in range(0, terms, TOGETHER):
        params[low : low + TOGETHER, 1:] = rng.normal(0, 0.02, (min(TOGETHER, terms - low), factors))
    noise = np.sqrt(np.mean([len(x) for x in x_rows]) / n) if n else 0.0
    rates = np.r_[rate, np.full(factors, 2.5 * rate)].astype(np.float32)
    pull = rates * np.r_[RIDGE_LINEAR, np.full(factors, RIDGE_FACTORS)].astype(np.float32) * np.float32(noise)
    parts = list(_batches(x_rows, first, rng.permutation(n), batch))
    x_rows.clear()
    energy, seen = np.zeros_like(params), np.zeros(terms)
    epochs = max(epochs, -(-steps // max(1, len(parts))))
    bias = bias_energy = clock = 0.0
    for epoch in range(epochs if terms else 0):
        now = 1 - epoch / epochs
        for k in rng.permutation(len(parts)):
            some, heads, begin, at, cols = parts[k]
            clock += now
            have = energy[cols]
            own = params[cols] * np.exp(-(clock - seen[cols])[:, None].astype(np.float32) * pull / (DAMP + np.sqrt(have)))
            params[cols], seen[cols] = own, clock
            margin, vx = margins(own, at, begin)
            top = worst(margin, heads)
            slope = (sigmoid(bias + margin[top]) - y[some]) * weight[some] / len(some)
            lengths = np.diff(begin)[top]
            edges = np.cumsum(np.r_[0, lengths])
            inside = np.arange(edges[-1]) + np.repeat(begin[top] - edges[:-1], lengths)
            hit, grad = gradient(own, at[inside], edges, vx[top], slope)
            total = have[hit] + grad**2
            energy[cols[hit]] = total
            params[cols[hit]] = own[hit] - np.float32(now) * rates * grad / (DAMP + np.sqrt(total))
            bias_energy += slope.sum() ** 2
            bias -= now * 0.2 * slope.sum() / (DAMP + np.sqrt(bias_energy))
    for low in range(0, terms, TOGETHER):
        some = slice(low, low + TOGETHER)
        params[some] *= np.exp(-(clock - seen[some])[:, None] * pull / (DAMP + np.sqrt(energy[some])))
    return float(bias), params[:, 0], params[:, 1:]


#: Rows that the scale and bias of the fit count for in calibration.
PRIOR = 4.0


def calibrate(margin: np.ndarray, y: np.ndarray, bias: float) -> tuple[float, float]:
    """(scale, bias) that make probabilities of margins that the machine wasn't fitted on.

    Newton steps on the logistic loss; the rarer label counts more by the root of the labels' ratio. A penalty
    worth PRIOR rows, and a thousandth of all, holds the scale near 1 and the bias near what it was, so few rows
    change little; the scale is 0 or more. Without rows of both labels both are as they were.
    """
    if not 0 < y.mean() < 1:
        return 1.0, bias
    scale, start, share = 1.0, bias, y.mean()
    weight = np.where(y > 0, np.sqrt((1 - share) / share), 1.0)
    weight /= weight.mean()
    for _ in range(100):
        p = sigmoid(scale * margin + bias)
        g, h = (p - y) * weight, p * (1 - p) * weight + 1e-9
        pull = PRIOR + 1e-3 * len(y)
        hess = np.array([[(h * margin**2).sum() + pull, (h * margin).sum()], [(h * margin).sum(), h.sum() + PRIOR]])
        step = np.linalg.solve(hess, [(g * margin).sum() + pull * (scale - 1), g.sum() + PRIOR * (bias - start)])
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        scale, bias = max(scale - step[0], 0.0), bias - step[1]
    return float(scale), float(bias)


def train(docs: DataFrame, labels: DataFrame, held_out: Column, fit_rows: int = 12_000, fit_terms: int = 50_000_000, calibration: float = 0.15, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fit on at most ``fit_rows`` labelled rows that aren't ``held_out``, the first by a hash of their id.

    All terms of those rows take part, up to ``fit_terms`` in all (on the driver 4 bytes each as they come, and 2 in a batch, or 4
    if it has many terms): in the order of that hash, an id whose rows would go beyond it is left out. The share ``calibration`` of them, the last by that hash, only sets scale and
    bias. Null labels and ids are left out, an id with several labels counts as the largest, and every
    row that repeats an id counts; null and empty texts are texts without a term. Without labelled rows (an empty table
    on either side) the machine gives 0.5 for every text. Other columns are not read.
    """
    named = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = named.withColumnRenamed("_id", id_col).where(~held_out).orderBy(F.xxhash64(id_col), id_col).limit(fit_rows).withColumnRenamed(id_col, "_id")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(materialize(chosen)), "_id")  # fit_rows at most
    rows = rows.select(F.xxhash64("_id").alias("_order"), "_y", "_text")

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = texts(b.column("_text"))
            owner, begin, term = passages(values)
            data, sizes = term.astype("<i4"), np.diff(begin).astype("<i4")
            cuts = np.searchsorted(owner, np.arange(len(values) + 1))
            blobs = [data[begin[p] : begin[q]].tobytes() for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
            counts = [sizes[p:q].tobytes() for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_order"), b.column("_y"), pa.array(counts, pa.binary()), pa.array(blobs, pa.binary())], ["place", "y", "sizes", "terms"])

    sample = materialize(map_batches(rows, terms_of, "place long, y int, sizes binary, terms binary"))
    used, fitting = 0, []
    # a row an id, fit_rows at most
    sizes_of = sample.groupBy("place").agg(F.sum(F.octet_length("terms")).alias("bytes"), F.sum(F.octet_length("sizes")).alias("of_sizes"), F.count("*").alias("rows")).collect()
    for r in sorted(sizes_of):
        if used + r["bytes"] // 4 <= fit_terms:
            used += r["bytes"] // 4
            fitting.append(r)
    if not fitting:
        return Machine(np.zeros(1 << BITS, np.int32), np.zeros((0, 9)), 1.0, 0.0)
    if len(fitting) < len(sizes_of):
        sample = sample.join(F.broadcast(sample.sparkSession.createDataFrame([(r["place"],) for r in fitting], "place long")), "place", "left_semi")
    # rows come in the order of the fit, each to its place in arrays of their final size, so their terms are held once
    flat, sizes = np.empty(used, np.int32), np.empty(sum(r["of_sizes"] for r in fitting) // 4, np.int32)
    n = sum(r["rows"] for r in fitting)
    first, y, present = np.empty(n, np.int64), np.empty(n), np.zeros(1 << BITS, bool)
    at = passage = 0
    for k, r in enumerate(sample.orderBy("place", "terms", "sizes", "y").toLocalIterator()):
        term, size = np.frombuffer(r["terms"], "<i4"), np.frombuffer(r["sizes"], "<i4")
        first[k], y[k], present[term] = passage, r["y"] > 0, True
        flat[at : at + len(term)], sizes[passage : passage + len(size)] = term, size
        at, passage = at + len(term), passage + len(size)
    slots = np.cumsum(present, dtype=np.int32) * present
    for low in range(0, used, TOGETHER):
        flat[low : low + TOGETHER] = slots[flat[low : low + TOGETHER]] - 1
    cut = n - int(calibration * n)
    end = first[cut] if cut < n else len(sizes)
    edges = np.cumsum(sizes[:end], dtype=np.int64)
    x_rows, rest = np.split(flat[: edges[-1]], edges[:-1]), flat[edges[-1] :].copy()
    del flat  # fit empties x_rows, and nothing holds the whole then
    bias, w, v = fit(x_rows, y[:cut], int(present.sum()), first=first[:cut])
    release_memory()
    params = np.concatenate([w[:, None], v], axis=1, dtype=np.float32)
    params[np.abs(params) < LEAST] = 0
    if cut < n:
        margin, _ = margins(params, rest, np.cumsum(np.r_[0, sizes[end:]]))
        scale, bias = calibrate(np.maximum.reduceat(margin, first[cut:] - end), y[cut:], bias)
    else:
        scale = 1.0
    says = np.flatnonzero(np.any(params != 0, axis=1))
    kept = np.zeros(1 << BITS, np.int32)
    kept[np.flatnonzero(present)[says]] = np.arange(1, len(says) + 1)
    machine = Machine(kept, params[says], scale, bias)
    w = v = params = rest = None
    release_memory()  # the driver lives on, and the sample was most of what it held
    return machine


def score(docs: DataFrame, machine: Machine, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every row of ``docs``, and toxicity_score (0 to 1), from whole texts.

    Null and empty texts have the score of a text without a term, texts of any length that of their worst passage, and
    rows that repeat a text the same score. A column of ``docs`` called toxicity_score is replaced.
    An empty table gives no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "toxicity_score"]
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a slot table, and the terms of fit_rows rows at most
    source, fields = beside_text(docs, keep, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array(shared.value.score(texts(b.column(len(keep)))), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], scores], [*keep, "toxicity_score"])

    return map_batches(source, run, T.StructType([*fields, T.StructField("toxicity_score", T.DoubleType())]))


def held_out_third(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc32_text(id_col) % 3 == 1, F.lit(False))


def reject(docs: DataFrame, machine: Machine, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns as they are.

    Rows are judged one by one, by their text alone: null and empty texts as texts without a term, and rows that
    repeat a text go or stay together. An empty table gives no rows, and a column may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(texts(b.column(at))) < threshold, pa.bool_()))

    numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return map_batches(numbered, run, numbered.schema).toDF(*docs.columns)
