"""Bounded-space online packing of tokenised documents into fixed windows.

Each partition keeps at most ``open_windows`` windows. A document's whole windows leave at once; its
tail goes to the open window it fits best. If none has room, the fullest is topped up with the head
of the tail and emitted, and the rest opens a new window. What is still open when a partition ends is
merged with the leftovers of other partitions in the same way, and the last windows are cut at powers
of two, which need no padding.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_batches, materialize, texts

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
OPEN = ", token_ids binary, leftover boolean"
#: The string of the vocabulary's special token, which the tokenizer encodes as one id.
SPECIAL = "<|endoftext|>"
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """Function from texts to id lists: the ``tokenizers`` file at ``path``, without special tokens added.

    The byte-pair ranks beside that file hold the same vocabulary and give the same ids several times
    faster; a text that contains the special token's string goes to ``tokenizers`` itself.
    """
    if path not in _ENCODERS:
        import base64
        import os

        import public_tokenizers
        import tiktoken

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        slow: list = []

        def by_file(text: str) -> list[int]:
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(path))
            return slow[0].encode(text, add_special_tokens=False).ids

        if os.path.exists(ranks_path):
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            _ENCODERS[path] = lambda text: by_file(text) if SPECIAL in text else fast.encode_ordinary(text)
        else:
            _ENCODERS[path] = by_file
    return _ENCODERS[path]


class Packer:
    """Open windows of one task; ``emit`` gets (pieces, fill) of each window that is closed."""

    def __init__(self, size: int, open_windows: int, emit):
        self.size, self.limit, self.emit = size, open_windows, emit
        self.fills: list[tuple[int, int]] = []  # sorted (fill, key)
        self.windows: dict[int, list] = {}
        self.next = 0

    def _close(self, at: int) -> None:
        fill, key = self.fills.pop(at)
        self.emit(self.windows.pop(key), fill)

    def _put(self, at: int | None, piece: tuple, ids: np.ndarray) -> None:
        if at is None:
            fill, key = 0, self.next
            self.next += 1
            self.windows[key] = []
        else:
            fill, key = self.fills.pop(at)
        self.windows[key].append((*piece, fill, ids))
        bisect.insort(self.fills, (fill + len(ids), key))
        if fill + len(ids) == self.size:
            self._close(len(self.fills) - 1)

    def add(self, doc: int | None, start: int, total: int, ids: np.ndarray) -> None:
        """Place one piece of fewer ids than a window, best fit."""
        at = bisect.bisect_right(self.fills, (self.size - len(ids), self.next)) - 1  # the fullest with room
        if at >= 0:
            return self._put(at, (doc, start, total), ids)
        if len(self.fills) >= self.limit:
            room = self.size - self.fills[-1][0]
            self._put(len(self.fills) - 1, (doc, start, total), ids[:room])
            start, ids = start + room, ids[room:]
        self._put(None, (doc, start, total), ids)

    def rest(self) -> list[list]:
        out = [self.windows[k] for _, k in self.fills]
        self.fills, self.windows = [], {}
        return out


class _Rows:
    def __init__(self, keep_ids: bool):
        self.keep_ids = keep_ids
        self.rows: list[tuple] = []

    def window(self, pieces: list, sequence: int | None, leftover: bool) -> None:
        for doc, start, total, offset, ids in pieces:
            data = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(data), total, sequence, offset, data if leftover or self.keep_ids else None, leftover))

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True) if self.rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)
        self.rows = []
        return out


def _schema(leftover: bool) -> pa.Schema:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.schema([(n, pa.int64()) for n in names] + [("token_ids", pa.binary())] + [("leftover", pa.bool_())] * leftover)


def _pack_partition(path: str, size: int, open_windows: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        rows, made, schema = _Rows(keep_ids), [0], _schema(True)

        def emit(pieces: list, fill: int) -> None:
            rows.window(pieces, part << 36 | made[0], False)
            made[0] += 1

        packer = Packer(size, open_windows, emit)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = np.array([*encode(text), end_id], np.uint32)
                total, whole = len(ids), len(ids) // size * size
                for at in range(0, whole, size):
                    emit([(doc, at, total, 0, ids[at : at + size])], size)
                if whole < total:
                    packer.add(doc, whole, total, ids[whole:])
                if len(rows.rows) >= 4096:
                    yield rows.batch(schema)
        for k, pieces in enumerate(packer.rest()):
            rows.window(pieces, part << 36 | k, True)
        yield rows.batch(schema)

    return run


def _powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def _merge_leftovers(size: int, open_windows: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        rows, made, schema = _Rows(keep_ids), [0], _schema(False)

        def emit(pieces: list, fill: int) -> None:
            rows.window(pieces, 1 << 62 | part << 36 | made[0], False)
            made[0] += 1

        packer = Packer(size, open_windows, emit)
        for batch in batches:
            for doc, start, total, data in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "start", "doc_tokens", "token_ids")), strict=True):
                packer.add(doc, start, total, np.frombuffer(data, "<u4"))
            if len(rows.rows) >= 4096:
                yield _bare(rows, schema)
        # the last open windows, end to end, cut at the window's size and then at powers of two
        pieces = [p for w in packer.rest() for p in w]
        left = sum(len(p[4]) for p in pieces)
        sizes = [size] * (left // size) + _powers(left % size)
        now: list = []
        fill = 0
        for doc, start, total, _, ids in pieces:
            while len(ids):
                take = min(len(ids), sizes[0] - fill)
                now.append((doc, start, total, fill, ids[:take]))
                start, ids, fill = start + take, ids[take:], fill + take
                if fill == sizes[0]:
                    emit(now, fill)
                    now, fill = [], 0
                    sizes.pop(0)
        yield _bare(rows, schema)

    return run


def _bare(rows: _Rows, schema: pa.Schema) -> pa.RecordBatch:
    rows.rows = [r[:-1] for r in rows.rows]
    return rows.batch(schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, open_windows: int = 64, end_id: int = 0, keep_ids: bool = True, leftover_ids: int = 1 << 22) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, token_ids.

    A document's ids are those of its whole text plus ``end_id``; a null text is empty and gives
    ``end_id`` alone. Each row is a document of its own, also if it repeats another or its identifier
    is null. An empty table gives no rows; other columns are not read. ``keep_ids``
    leaves out the ids (little-endian unsigned 32-bit) if false: a layout with checksums only. What is left open
    is counted and dealt to tasks of about ``leftover_ids`` ids, each of which ends in a few windows below ``size``.
    """
    done = PIECE + OPEN
    first = materialize(map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), _pack_partition(tokenizer, size, open_windows, end_id, keep_ids), done))
    tasks = max(1, -(-(first.where("leftover").agg(F.sum("length")).first()[0] or 0) // leftover_ids))
    left = (
        first.where("leftover")
        .withColumn("_task", F.pmod(F.xxhash64("sequence_id"), F.lit(tasks)))
        .repartition(tasks, "_task")
        .sortWithinPartitions("sequence_id", "offset")
        .select("doc_id", "start", "doc_tokens", "token_ids")
    )
    merged = map_batches(left, _merge_leftovers(size, open_windows, keep_ids), PIECE + ", token_ids binary")
    return first.where("NOT leftover").drop("leftover").unionByName(merged)
