"""Streaming source over a growing log: whole lines past the byte that each shard or bulk file was read to.

The offset is {file: bytes}. A torn last line isn't consumed and is looked at again later. New bytes are cut
into partitions that executors read, so the home folder must be one that all of them see.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.log import checked, split

NAME = "quillstone_log"
#: Bytes of one partition; a longer line makes it longer.
SLICE = 64 << 20
#: Pieces of small files share a partition up to so many bytes.
SHARED = 8 << 20
#: Bytes of lines that a task hands on at once.
TOGETHER = 4 << 20
_LINES = pa.schema([(name, pa.string()) for name in ("value", "shard_machine", "shard_month")])
#: Shards, and the files of bulk writes.
PATTERNS = ("log/*/*.jsonl", "bulk/machine=*/month=*/part-*")
#: What the error says if a file has lost lines that were read: what was made of them must be made again, with a new checkpoint.
SHRUNK = "is shorter than what was read of it"
_PLACE = re.compile(r"log/([^/]+)/([^/]+)\.jsonl$|bulk/machine=([^/]+)/month=([^/]+)/")


def local_path(home: str) -> str:
    """The path of a folder that may be given as a file: address."""
    return urlparse(home).path if home.startswith("file:") else home


def last_line_end(path: str, low: int = 0) -> int:
    """The offset after the last line feed at or after ``low``, or ``low``."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        if at < low:
            return at  # shorter than what was read: the caller sees it shrank
        while at > low:
            step = min(1 << 16, at - low)
            f.seek(at - step)
            found = f.read(step).rfind(b"\n")
            if found >= 0:
                return at - step + found + 1
            at -= step
    return low


class Slice(InputPartition):
    """Pieces (path, machine, month, begin, end) that one task reads."""

    def __init__(self, pieces: list[tuple[str, str, str, int, int]]):
        self.pieces = pieces


class LogReader(DataSourceStreamReader):
    def __init__(self, home: str):
        self.home = home
        self.reached: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        there = {}
        for path in sorted(x for pattern in PATTERNS for x in Path(self.home).glob(pattern)):
            name = str(path.relative_to(self.home))
            there[name] = last_line_end(str(path), self.reached.get(name, 0))
        self.reached = there
        return dict(there)

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        out, size = [], SHARED
        for name in start.keys() - end.keys():
            raise RuntimeError(f"{name} {SHRUNK}: it is gone")
        for name, stop in sorted(end.items()):
            begin = start.get(name, 0)
            if stop < begin:
                raise RuntimeError(f"{name} {SHRUNK}: {stop} bytes of {begin}")
            self.reached[name] = max(self.reached.get(name, 0), stop)
            path = os.path.join(self.home, name)
            machine, month = (x for x in _PLACE.match(name).groups() if x)
            while begin < stop:
                cut = min(begin + SLICE, stop)
                if cut < stop:
                    with open(path, "rb") as f:
                        f.seek(cut)
                        cut += len(f.readline())
                cut = min(cut, stop)
                if size + cut - begin > SHARED:
                    out.append(Slice([]))
                    size = 0
                out[-1].pieces.append((path, machine, month, begin, cut))
                size += cut - begin
                begin = cut
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        """The lines of a partition, about TOGETHER bytes at a time."""
        for path, machine, month, at, end in partition.pieces:
            texts, size = [], 0
            with open(path, "rb") as f:
                f.seek(at)
                while at < end:
                    line = f.readline()
                    at += len(line)
                    text = line.decode("utf-8", "replace").strip()
                    if text:
                        texts.append(text)
                        size += len(line)
                    if texts and (size >= TOGETHER or at >= end):
                        yield pa.RecordBatch.from_pydict({"value": texts, "shard_machine": [machine] * len(texts), "shard_month": [month] * len(texts)}, _LINES)
                        texts, size = [], 0


class LogSource(DataSource):
    """Option ``home``: the folder that holds log/ and bulk/."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string, shard_machine string, shard_month string"

    def streamReader(self, schema) -> LogReader:
        return LogReader(local_path(self.options["home"]))


def read_stream(spark: SparkSession, home: str) -> DataFrame:
    # the processes that run a source don't get the session's Python files
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LogSource)
    return spark.readStream.format(NAME).option("home", home).load()


def take_new(spark: SparkSession, home: str, checkpoint: str, ingest: Callable[[DataFrame, int], None]) -> None:
    """Hand on all lines that are new since the last run with this checkpoint, in numbered batches, and end."""
    query = read_stream(spark, home).writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def catch_up(spark: SparkSession, home: str, tables: str, checkpoint: str, verify: bool = True) -> None:
    """Ingest everything new once, exactly once: each batch writes a folder of its own number again if it is retried.

    Late and repeated records need no watermark: the views merge them by rules that don't depend on order,
    and state is the log's tables, which are compacted like any other.
    """

    def ingest(lines: DataFrame, batch: int) -> None:
        rows = checked(lines, verify).persist()
        found = split(rows)
        for name in ("claims", "statuses", "counters", "docs", "warnings"):
            df = getattr(found, name)
            df.write.mode("overwrite").parquet(f"{tables}/{name}/batch={batch}")
        rows.unpersist()

    take_new(spark, home, checkpoint, ingest)


def read_tables(spark: SparkSession, tables: str):
    """The tables that ``catch_up`` has written so far."""
    from ..sources.log import Records

    return Records(*(spark.read.parquet(f"{tables}/{n}").drop("batch") for n in ("claims", "statuses", "counters", "docs", "warnings")))


