"""Benchmark decontamination by a BM25 inverted index of the test items with block-max WAND.

Every training document is a query, passage by passage: items are put in classes by length, powers of two, and for each
class a document is cut into cells of that length; each two neighbouring cells are a passage, so an item that a
document repeats lies whole in one passage of its class, whatever its length. Scores are divided by an item's
score against itself, so one threshold fits all items; the number of items, the document frequencies and the mean
length are of the whole benchmark, however many passes an index of bounded size takes.

A passage whose terms' largest weights don't add up to the threshold is let go; for the others the block maxima
of their terms are summed for each block of items that a term is in. Where a block can reach the threshold, the
posting lists are walked by WAND: the pivot is the first item, in order, that the lists up to it could lift over the
threshold, its block's maxima are looked at before its postings, and lists skip ahead to it. All items above the
threshold are verified: the word shingles of the question and of the answer must both be in the passage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .runtime import map_batches, materialize, sized_join, texts, word_windows

K1, B = 1.2, 0.75
BLOCK = 4
#: Words of the shortest class of items.
SHORTEST = 64
#: Words of test items in one index, which all executors get (about 50 bytes a word); more items are searched in
#: further passes.
INDEX_WORDS = 500_000
#: Block maxima that are summed at once (24 bytes each), but for a passage that has more alone.
SUMMED = 1 << 20
HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
_SENTENCE = re.compile(r"[.?!:]\s+(?=\S)")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item: the answer is its last sentence, or the last fourth of a single one."""
    cuts = [m.end() for m in _SENTENCE.finditer(text.rstrip())]
    if cuts and re.search(r"\w", text[cuts[-1] :]):
        return text[: cuts[-1]], text[cuts[-1] :]
    words = list(re.finditer(r"\S+", text))
    if len(words) < 4:
        return text, text
    at = words[len(words) - len(words) // 4].start()
    return text[:at], text[at:]


def word_hashes(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words (letters, digits, marks) of all texts, and where each text begins."""
    codes, at = textvec.join([x.lower() for x in values])
    kind = textvec.classes()[codes]
    begin, end = textvec.spans(((kind == 1) | (kind == 2)).astype(np.uint8))
    return textvec.Hasher(codes).of(begin, end), np.searchsorted(begin, at)


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All the numbers of the ranges [begin, end), one range after the other."""
    n = end - begin
    out = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n)
    return out + np.arange(len(out))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    return np.unique(word_windows(words, min(size, len(words)))) if len(words) else np.empty(0, np.uint64)


class Statistics:
    """Number of items, their mean length, and in how many of them a term is."""

    def __init__(self, items: int, mean: float, terms: np.ndarray, frequency: np.ndarray):
        self.items, self.mean = items, max(mean, 1.0)
        order = np.argsort(terms)
        self.terms, self.frequency = terms[order], frequency[order].astype(float)

    @classmethod
    def of(cls, words: list[np.ndarray]) -> Statistics:
        words = [w for w in words if len(w)]
        terms, frequency = np.unique(np.concatenate([np.empty(0, np.uint64), *map(np.unique, words)]), return_counts=True)
        return cls(len(words), sum(map(len, words)) / max(1, len(words)), terms, frequency)

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.frequency[np.searchsorted(self.terms, terms)]
        return np.log(1 + (self.items - df + 0.5) / (df + 0.5))


class Index:
    """Inverted index of items, by class and then in the order given; weights are BM25 parts over the item's own score.

    Postings are sorted by term and then by the item's place in the order of classes; blocks are BLOCK neighbours
    of one class.
    """

    def __init__(self, items: list[tuple[int, str]], shingle: int, statistics: Statistics | None = None):
        self.item, self.parts, words = [], [], []
        for item_id, text in items:
            hashes, at = word_hashes([text, *split_item(text)])
            question, answer = hashes[at[1] : at[2]], hashes[at[2] : at[3]]
            self.item.append(item_id)
            words.append(hashes[: at[1]])
            self.parts.append([(min(shingle, len(p)), shingles(p, shingle)) for p in (question if len(question) else answer, answer if len(answer) else question)])
        statistics = statistics or Statistics.of(words)
        size = np.array([max(SHORTEST, 1 << (max(1, len(w)) - 1).bit_length()) for w in words], np.int64)
        #: The item at each place, and what classes there are: (words, first place, end).
        self.items = np.argsort(size, kind="stable")
        steps, first = np.unique(size[self.items], return_index=True)
        self.classes = list(zip(steps.tolist(), first.tolist(), [*first[1:].tolist(), len(size)], strict=True))
        # blocks begin anew with each class
        cls = np.searchsorted(steps, size[self.items])
        blocks = np.array([-(-(high - low) // BLOCK) for _, low, high in self.classes], np.int64)
        self.block_from = np.cumsum(blocks) - blocks
        self.block_of = self.block_from[cls] + (np.arange(len(size)) - first[cls]) // BLOCK if len(size) else np.empty(0, np.int64)
        unique = [np.unique(words[i], return_counts=True) for i in self.items]
        none = np.empty(0, np.uint64)
        self.terms = np.unique(np.concatenate([none, *(u for u, _ in unique)]))
        term = np.searchsorted(self.terms, np.concatenate([none, *(u for u, _ in unique)]))
        place = np.repeat(np.arange(len(unique)), [len(u) for u, _ in unique])
        tf = np.concatenate([np.empty(0), *(c for _, c in unique)])
        length = np.array([len(words[i]) for i in self.items], float)
        weight = statistics.idf(self.terms)[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[place] / statistics.mean))
        weight /= np.bincount(place, weight, len(unique))[place]
        order = np.lexsort((place, term))
        self.post_place, self.post_weight = place[order], weight[order]
        self.post_at = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.blocks = np.int64(blocks.sum() + 1)
        key = term[order] * self.blocks + self.block_of[self.post_place]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        self.listed = key[head]
        self.block, self.block_max = self.block_of[self.post_place[head]], np.maximum.reduceat(self.post_weight, head) if len(head) else np.empty(0)
        self.block_at = np.searchsorted(term[order][head], np.arange(len(self.terms) + 1))
        self.term_max = np.maximum.reduceat(self.post_weight, self.post_at[:-1]) if len(self.terms) else np.empty(0)
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.terms >> np.uint64(48)).astype(np.int64)] = True

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers of words, -1 for words that no item has."""
        out = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(self.table[(hashes >> np.uint64(48)).astype(np.int64)])
        if len(maybe) and len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, hashes[maybe]), len(self.terms) - 1)
            found = self.terms[at] == hashes[maybe]
            out[maybe[found]] = at[found]
        return out

    def bounds(self, passage: np.ndarray, term: np.ndarray, passages: int, threshold: float = 0.0, low: int = 0, high: int | None = None) -> np.ndarray:
        """The largest sum of block maxima, over the blocks of places ``low`` to ``high``, of each passage's distinct terms.

        No item scores more against the passage than that. A passage whose terms' largest weights don't reach
        ``threshold`` has the sum of those. Sums are kept for blocks that a term is in, and for SUMMED entries at once.
        """
        known = term >= 0
        key = np.unique(passage[known] * np.int64(len(self.terms) + 1) + term[known])
        passage, term = key // (len(self.terms) + 1), key % (len(self.terms) + 1)
        out = np.bincount(passage, self.term_max[term], passages) if len(key) else np.zeros(passages)
        some = out[passage] >= threshold
        passage, term = passage[some], term[some]
        high = len(self.items) if high is None else high
        first, end = (self.block_of[low], self.block_of[high - 1] + 1) if low < high else (0, 0)
        # a term's blocks ascend, so those of the class are one range of its list
        number = self.blocks
        begin, stop = np.searchsorted(self.listed, term * number + first), np.searchsorted(self.listed, term * number + end)
        out[np.unique(passage)] = 0
        total = np.cumsum(stop - begin)
        cut = 0
        while cut < len(term):
            reach = int(np.searchsorted(total, (total[cut - 1] if cut else 0) + SUMMED, "right"))
            if reach < len(term):  # whole passages
                reach = int(np.searchsorted(passage, passage[reach], "left"))
                if reach <= cut:
                    reach = int(np.searchsorted(passage, passage[cut], "right"))
            at = ranges(begin[cut:reach], stop[cut:reach])
            pair = np.repeat(passage[cut:reach], (stop - begin)[cut:reach]) * number + self.block[at]
            pairs, place = np.unique(pair, return_inverse=True)
            np.maximum.at(out, pairs // number if len(pairs) else pairs, np.bincount(place, self.block_max[at], len(pairs)))
            cut = reach
        return out

    def search(self, terms: np.ndarray, threshold: float, low: int = 0, high: int | None = None) -> list[tuple[int, float]]:
        """(item, score) of all items at places ``low`` to ``high`` that score ``threshold`` or more against the distinct ``terms``, by block-max WAND."""
        high = len(self.items) if high is None else high
        least, found = threshold - 1e-9, []
        lists = []  # [place now, largest weight, places, weights, blocks, their maxima, index now]
        for t in terms.tolist():
            a, z = self.post_at[t], self.post_at[t + 1]
            places = self.post_place[a:z]
            i, j = np.searchsorted(places, (low, high)).tolist()
            if i < j:
                c, d = self.block_at[t], self.block_at[t + 1]
                lists.append([int(places[i]), float(self.term_max[t]), places[i:j].tolist(), self.post_weight[a + i : a + j], self.block[c:d].tolist(), self.block_max[c:d], 0])

        def skip(entry: list, to: int) -> None:
            entry[6] = bisect_left(entry[2], to, entry[6])
            entry[0] = entry[2][entry[6]] if entry[6] < len(entry[2]) else high

        while True:
            lists = sorted((e for e in lists if e[0] < high), key=lambda e: e[0])
            reach, pivot = 0.0, -1
            for k, e in enumerate(lists):
                reach += e[1]
                if reach >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            place = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == place:
                pivot += 1
            block = int(self.block_of[place])
            bound = 0.0
            for e in lists[: pivot + 1]:
                b = bisect_left(e[4], block)
                if b < len(e[4]) and e[4][b] == block:
                    bound += float(e[5][b])
            if bound < least:  # nothing in this block: on to the next one, or to the next list's item
                after = int(np.searchsorted(self.block_of, block, "right"))
                after = min(after, lists[pivot + 1][0]) if pivot + 1 < len(lists) else after
                for e in lists[: pivot + 1]:
                    skip(e, after)
            elif lists[0][0] == place:
                score = sum(float(e[3][e[6]]) for e in lists[: pivot + 1])
                if score >= least:
                    found.append((int(self.items[place]), score))
                for e in lists[: pivot + 1]:
                    skip(e, place + 1)
            else:
                for e in lists[:pivot]:
                    if e[0] < place:
                        skip(e, place)

    def verify(self, item: int, words: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and of the answer's shingles that the passage has."""
        out = []
        for size, wanted in self.parts[item]:
            have = word_windows(words, size)
            out.append(float(np.isin(wanted, have).mean()) if len(wanted) else 0.0)
        return out[0], out[1]


def _search(index, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        for b in batches:
            ids, values = b.column(0).to_pylist(), texts(b.column(1))
            rows: list[tuple] = []
            for low, high in textvec.batches(values):
                hashes, at = word_hashes(values[low:high])
                term = own.lookup(hashes)
                best: dict[tuple[int, int], tuple] = {}
                for step, first, end in own.classes:
                    for i, a, z in _passages(own, term, at, step, first, end, threshold):
                        found = np.unique(term[a:z])
                        for item, score in own.search(found[found >= 0], threshold, first, end):
                            q, w = own.verify(item, hashes[a:z])
                            if q >= overlap and w >= overlap:
                                key = (i, own.item[item])
                                best[key] = max(best.get(key, (0.0,)), (score, q, w))
                rows += [(ids[low + i], item, *hit) for (i, item), hit in best.items()]
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def _passages(index: Index, term: np.ndarray, at: np.ndarray, step: int, low: int, high: int, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(text, begin, end) of the passages for items at places ``low`` to ``high`` that one of them may score ``threshold`` in."""
    n_words = np.diff(at)
    cells = np.maximum(1, -(-n_words // step))
    doc = np.repeat(np.arange(len(n_words)), cells)
    cell = np.arange(len(doc)) - (np.cumsum(cells) - cells)[doc]
    opens = (cell < cells[doc] - 1) | (cells[doc] == 1)
    doc, begin = doc[opens], (at[doc] + step * cell)[opens]
    end = np.minimum(begin + 2 * step, at[doc + 1])
    inside = ranges(begin, end)
    reach = index.bounds(np.repeat(np.arange(len(doc)), end - begin), term[inside], len(doc), threshold - 1e-9, low, high)
    for k in np.flatnonzero(reach >= threshold - 1e-9).tolist():
        yield int(doc[k]), int(begin[k]), int(end[k])


def _statistics(listed: DataFrame) -> tuple[int, float, DataFrame]:
    """(number of items with a word, their mean length, table of (term, df)) of the whole benchmark."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, at = word_hashes(texts(b.column("text")))
            each = [np.unique(hashes[x:y]) for x, y in zip(at, at[1:], strict=False)]
            found = np.concatenate([np.empty(0, np.uint64), *each])
            heads = np.zeros(len(found), np.int64)
            # the item's length goes along with its first term
            n, sizes = np.diff(at), np.array([len(e) for e in each], np.int64)
            heads[(np.cumsum(sizes) - sizes)[sizes > 0]] = n[sizes > 0]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(heads)], ["term", "length"])

    rows = materialize(map_batches(listed.select("text"), terms, "term long, length long"))
    total = rows.where("length > 0").agg(F.count("*"), F.avg("length")).first()
    return total[0], total[1] or 0.0, rows.groupBy("term").agg(F.count("*").alias("df"))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.7, overlap: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and a test item it leaks: doc_id, item_id, score, question_overlap, answer_overlap.

    ``score`` is the best passage's BM25 over the item's own. A pair is returned once for each document
    row, with its best passage (of equal scores the one with the larger overlaps). Null and empty texts, on either side,
    match nothing; repeated items with one identifier count as one; texts and items may have any length, by one rule;
    empty tables give no pairs; other columns are not read.
    """
    spark = docs.sparkSession
    words = F.size(F.split(F.col(item_text), r"\s+"))
    listed = materialize(items.where(F.col(item_text).rlike(r"\w")).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"), words.cast("long").alias("words")).distinct())
    passes = -(-(listed.agg(F.sum("words")).first()[0] or 0) // INDEX_WORDS)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not passes:
        return spark.createDataFrame([], HITS)
    n, mean, frequency = _statistics(listed)
    frequency = materialize(frequency) if passes > 1 else frequency
    out = None
    for k in range(passes):
        part = sorted(((r["item_id"], r["text"]) for r in listed.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))  # about INDEX_WORDS words
        own = np.unique(word_hashes([t for _, t in part])[0])
        df = frequency
        if passes > 1:  # of the terms of this pass
            df = frequency.join(F.broadcast(spark.createDataFrame(pd.DataFrame({"term": own.view(np.int64)}), "term long")), "term")
        found = np.array([tuple(r) for r in df.select("term", "df").collect()], np.int64).reshape(-1, 2)
        index = Index(part, shingle, Statistics(n, mean, found[:, 0].copy().view(np.uint64), found[:, 1]))
        hits = map_batches(source, _search(spark.sparkContext.broadcast(index), threshold, overlap), HITS)
        out = hits if out is None else out.unionByName(hits)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose identifier is in no leak, with all their columns; a null identifier never leaks.

    Rows that share an identifier stay or go together; null and empty texts leak nothing; an empty benchmark
    leaves all rows, an empty table gives none.
    """
    found = materialize(leaks(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias(id_col)).where(F.col(id_col).isNotNull()).distinct())
    return sized_join(docs, found, [id_col], "left_anti", found.count())
