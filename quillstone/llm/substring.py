"""Substring deduplication by difference-cover anchors.

Only positions whose remainder modulo PERIOD is in the difference cover are hashed, as anchors of ANCHOR
words. For two equal windows of WINDOW words there is a shift below PERIOD that takes both starts to cover
positions, so the windows share an anchor at the same place, whatever their alignment. Anchors that occur
once in the corpus are let go; the others are extended to the whole windows around them, which are
compared as windows: the earliest start of each word sequence stays, the words under all others go. Word
sequences are equal if the 128-bit BLAKE2b digests of the words themselves are; the 64-bit hashes of
anchors only choose what is looked at.

Documents are read once into chunks, in a table bucketed by chunk. What executors exchange are sorted
arrays, one for each chunk and range of hashes. A hash that repeats within a chunk is sent once, so a
passage that a third of all documents share costs one entry a chunk and never gathers in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .runtime import map_batches, materialize, partitions, shared_dir, texts

WINDOW = 20
#: A perfect difference set: each remainder modulo 13 is a difference of two of them.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Characters of one chunk (a longer document is a chunk of its own).
CHUNK_CHARS = 1 << 21
#: Stands for a null identifier, which is later than any other.
NO_ID = (1 << 63) - 1
CHUNK = "chunk long, chars long, ids binary, sizes binary, data binary"
#: Bytes of one bucket's entries, on average: buckets are as many as the counted characters need.
BUCKET_BYTES = 32 << 20
ENTRIES = "bucket int, chunk long, ids binary, id_at binary, hashes binary, places binary"
MARKS = "chunk long, places binary"


def pack_places(places: np.ndarray) -> bytes:
    """Ascending positions as steps of two bytes, or of four if a step is long."""
    steps = np.diff(places, prepend=0)
    small = not len(steps) or steps.max() < 1 << 16
    return (b"\2" if small else b"\4") + steps.astype("<u2" if small else "<u4").tobytes()


def unpack_places(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u2" if data[:1] == b"\2" else "<u4", offset=1).astype(np.int64))


def covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of the numbers below ``n`` are in one of the ranges [begin, end)."""
    return np.cumsum((np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n]) > 0


def _chunks(chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        held: list[tuple[int, str]] = []
        chars = made = 0

        def row() -> pa.RecordBatch:
            held.sort(key=lambda x: x[0])
            data = [t.encode() for _, t in held]
            packed = zstandard.ZstdCompressor(level=1).compress(b"".join(data))
            out = pa.RecordBatch.from_arrays([pa.array([part << 32 | made]), pa.array([sum(len(t) for _, t in held)]), pa.array([np.array([i for i, _ in held], "<i8").tobytes()]), pa.array([np.array([len(x) for x in data], "<i8").tobytes()]), pa.array([packed])], ["chunk", "chars", "ids", "sizes", "data"])
            held.clear()
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                if held and chars + len(t) > chunk_chars:
                    yield row()
                    made, chars = made + 1, 0
                held.append((NO_ID if i is None else i, t))
                chars += len(t)
        if held:
            yield row()

    return run


class Chunk:
    """The documents of a chunk in order, and their words as hashes."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes, hashed: bool = True):
        self.ids = np.frombuffer(ids, "<i8")
        ends = np.cumsum(np.frombuffer(sizes, "<i8"))
        raw = zstandard.ZstdDecompressor().decompress(data)
        self.texts = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        if hashed:
            codes, at = textvec.join([t.decode() for t in self.texts])
            begin, end = textvec.space_words(codes)
            self.begin = np.searchsorted(begin, at)  # first word of each document, and the number of words
            self.words = textvec.Hasher(textvec.Hasher(codes).of(begin, end))
            self.n = len(begin)

    def last_start(self, size: int) -> np.ndarray:
        """For each word, whether ``size`` words of its document begin there."""
        return covered(self.begin[:-1], np.maximum(self.begin[:-1], self.begin[1:] - size + 1), self.n)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors in documents that have a window."""
        fits = self.last_start(ANCHOR)
        lengths = np.diff(self.begin)
        fits &= np.repeat(lengths >= WINDOW, lengths)
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        fits &= np.resize(cover, self.n)
        at = np.flatnonzero(fits)
        return at, self.words.of(at, at + ANCHOR)

    def digests(self, start: np.ndarray) -> np.ndarray:
        """128-bit digests (two words) of the windows at ``start``, from the words themselves with one space between."""
        words = [t.split() for t in self.texts]  # bytes: splits at the six ASCII white spaces
        ends = np.cumsum([len(w) + 1 for own in words for w in own], dtype=np.int64)
        whole = memoryview(b" ".join(w for own in words for w in own))
        begin = np.r_[0, ends[:-1]][start].tolist() if len(start) else []
        last = (ends[start + WINDOW - 1] - 1).tolist() if len(start) else []
        found = b"".join(hashlib.blake2b(whole[a:z], digest_size=16).digest() for a, z in zip(begin, last, strict=True))
        return np.frombuffer(found, "<u8").reshape(-1, 2)

    def windows(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of these anchors at a shift below PERIOD."""
        near = covered(np.maximum(anchors - PERIOD + 1, 0), anchors + 1, self.n)
        return np.flatnonzero(near & self.last_start(WINDOW))


def _entries(chunk: int, ids: np.ndarray | None, hashes: np.ndarray, places: np.ndarray, buckets: int, keep: int) -> pa.RecordBatch:
    """Rows by bucket of (hash, place), places ascending; ``ids`` of the entries' documents if they matter."""
    hashes = hashes.astype("<u8").reshape(len(hashes), hashes.shape[1] if hashes.ndim > 1 else 1)
    data = hashes.view(np.uint8)
    bucket = ((hashes[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        some = order[cuts[b] : cuts[b + 1]]
        low = np.ascontiguousarray(data[some, :keep]).tobytes()
        own, at = (b"", b"") if ids is None else _runs(ids[some])
        rows.append((b, chunk, own, at, low, pack_places(places[some])))
    types = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["bucket", "chunk", "ids", "id_at", "hashes", "places"])


def _runs(ids: np.ndarray) -> tuple[bytes, bytes]:
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return ids[first].astype("<i8").tobytes(), pack_places(first)


def _hashes(data: bytes, keep: int) -> np.ndarray:
    out = np.zeros((len(data) // keep, 8), np.uint8)
    out[:, :keep] = np.frombuffer(data, np.uint8).reshape(-1, keep)
    return out.view("<u8")[:, 0]


#: Bytes kept of an anchor's hash beside its bucket: a chance match only costs a comparison of windows.
ANCHOR_BYTES = 5
DIGEST_BYTES = 16


def _send_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = Chunk(*(batch.column(n)[k].as_py() for n in ("ids", "sizes", "data")))
                at, hashes = chunk.anchors()
                first = np.sort(np.unique(hashes, return_index=True)[1])
                yield _entries(batch.column("chunk")[k].as_py(), None, hashes[first], at[first], buckets, ANCHOR_BYTES)

    return run


def _marks(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "places": pa.array([r[1] for r in rows], pa.binary())})


def _repeated(group: pa.Table) -> pa.Table:
    """Of one bucket's anchors, each of which a chunk sends once: those that several chunks have."""
    sent = [_hashes(x, ANCHOR_BYTES) for x in group.column("hashes").to_pylist()]
    hashes = np.concatenate(sent)
    ranked = np.sort(hashes)
    several = ranked[1:][ranked[1:] == ranked[:-1]]
    several = several[np.r_[True, several[1:] != several[:-1]]] if len(several) else several
    out = []
    for chunk, places, own in zip(group.column("chunk").to_pylist(), group.column("places").to_pylist(), sent, strict=True):
        if len(several):
            at = np.minimum(np.searchsorted(several, own), len(several) - 1)
            hit = several[at] == own
            if hit.any():
                out.append((chunk, pack_places(unpack_places(places)[hit])))
    return _marks(out)


def _send_windows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column("chunk")[k].as_py()
                chunk = Chunk(*(batch.column(n)[k].as_py() for n in ("ids", "sizes", "data")))
                at, hashes = chunk.anchors()
                _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
                shared = counts[inverse] > 1
                marked = [unpack_places(x) for x in batch.column("marks")[k].as_py() or []]
                shared[np.searchsorted(at, np.concatenate([np.empty(0, np.int64), *marked]))] = True
                # the first place of a hash that other chunks have stands for all its places here
                spread = np.zeros(len(counts), bool)
                spread[inverse[shared]] = True
                start = chunk.windows(at[spread[inverse]])
                found = chunk.digests(start)
                order = np.lexsort((np.arange(len(start)), found[:, 1], found[:, 0]))
                first = np.sort(order[np.r_[True, (found[order[1:]] != found[order[:-1]]).any(axis=1)]]) if len(order) else order
                again = np.ones(len(start), bool)
                again[first] = False
                ids = chunk.ids[np.searchsorted(chunk.begin, start[first], "right") - 1]
                yield _entries(name, ids, found[first], start[first], buckets, DIGEST_BYTES)
                if again.any():  # goes along, to be marked whatever the others say
                    yield pa.RecordBatch.from_arrays([pa.array([name % buckets], pa.int32()), pa.array([name], pa.int64()), pa.array([b""]), pa.array([b""]), pa.array([b""]), pa.array([pack_places(start[again])])], ["bucket", "chunk", "ids", "id_at", "hashes", "places"])

    return run


def _later(group: pa.Table) -> pa.Table:
    """Of one bucket's windows, all but the earliest of each hash; windows sent without hashes as they are."""
    out, sent = [], []
    for chunk, ids, id_at, data, places in zip(*(group.column(n).to_pylist() for n in ("chunk", "ids", "id_at", "hashes", "places")), strict=True):
        if not data:
            out.append((chunk, places))
            continue
        hashes, at = np.frombuffer(data, "<u8").reshape(-1, 2), unpack_places(places)
        runs = np.diff(np.r_[unpack_places(id_at), len(at)])
        sent.append((hashes, np.repeat(np.frombuffer(ids, "<i8"), runs), np.full(len(at), chunk), at))
    if sent:
        hashes, ids, chunks, at = (np.concatenate(x) for x in zip(*sent, strict=True))
        order = np.lexsort((hashes[:, 1], hashes[:, 0]))
        ranked = hashes[order]
        same = (ranked[1:] == ranked[:-1]).all(axis=1)
        order = order[np.r_[same, False] | np.r_[False, same]]
        order = order[np.lexsort((at[order], chunks[order], ids[order], hashes[order, 1], hashes[order, 0]))]
        ranked = hashes[order]
        later = order[np.r_[False, (ranked[1:] == ranked[:-1]).all(axis=1)]] if len(order) else order
        later = later[np.lexsort((at[later], chunks[later]))]
        chunks, at = chunks[later], at[later]
        edges = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1], True]) if len(later) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            out.append((int(chunks[a]), pack_places(at[a:b])))
    return _marks(out)


def _finish(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = Chunk(*(batch.column(n)[k].as_py() for n in ("ids", "sizes", "data")), hashed=False)
                words = [t.split() for t in chunk.texts]  # bytes: splits at the six ASCII white spaces
                begin = np.cumsum([0, *map(len, words)])
                at = np.concatenate([np.empty(0, np.int64), *map(unpack_places, batch.column("marks")[k].as_py() or [])])
                kept = ~covered(at, at + WINDOW, begin[-1])
                rows = []
                for i, w in enumerate(words):
                    own = kept[begin[i] : begin[i + 1]]
                    left = int(own.sum())
                    text = b" ".join(w if left == len(w) else compress(w, own.tolist()))
                    doc = int(chunk.ids[i])
                    rows.append((None if doc == NO_ID else doc, len(w), len(w) - left, hashlib.sha256(text).hexdigest(), text.decode() if keep_text else None))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_removed, kept_sha256, kept_text (null unless ``keep_text``).

    Words are runs of anything but ASCII white space. A word goes if a window of WINDOW consecutive words
    over it has a word sequence that also starts earlier: in a row with a smaller identifier, or before it in
    the same row. Null identifiers are the largest; rows that repeat an identifier are in the order they
    were read. A null or empty text has no words. No rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    path = shared_dir(spark)
    name = "chunks_" + path[-32:]
    # bucketed, so that the two joins below move the marks alone
    map_batches(source, _chunks(chunk_chars), CHUNK).write.bucketBy(n, "chunk").option("path", path).format("parquet").saveAsTable(name)
    try:
        chunks = spark.table(name)
        # entries of words of six characters on average, an anchor at each cover position; windows are fewer, but for a corpus of copies
        entries = (chunks.agg(F.sum("chars")).first()[0] or 0) // 6 * (len(COVER) / PERIOD)
        buckets = max(n, -(-int(entries * (DIGEST_BYTES + 8)) // BUCKET_BYTES))

        def with_marks(marks: DataFrame) -> DataFrame:
            own = marks.repartition(n, "chunk").groupBy("chunk").agg(F.collect_list("places").alias("marks"))
            return chunks.join(own.hint("shuffle_hash"), "chunk", "left")

        anchors = materialize(map_batches(chunks.select("chunk", "ids", "sizes", "data"), _send_anchors(buckets), ENTRIES).groupBy("bucket").applyInArrow(_repeated, MARKS))
        windows = materialize(map_batches(with_marks(anchors), _send_windows(buckets), ENTRIES).groupBy("bucket").applyInArrow(_later, MARKS))
        return map_batches(with_marks(windows), _finish(keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string").withColumnRenamed("doc_id", id_col)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the catalogue's entry; the files are external, and what was planned reads them
