"""The sharded JSON-lines log as a batch source and sink: log/<machine>/<yyyy-MM>.jsonl under a home folder."""

from __future__ import annotations

import fcntl
import json
import os
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import document_addresses, with_address
from ..model import RECORD, RECORD_TAGS

PATTERN = "log/*/*.jsonl"
_SHARD = r"log/([^/]+)/([^/]+)\.jsonl$"


@dataclass
class Records:
    """The log by record type, and lines that were left out, with the reason."""

    claims: DataFrame
    statuses: DataFrame
    counters: DataFrame
    docs: DataFrame
    warnings: DataFrame


def shards(spark: SparkSession, home: str) -> DataFrame:
    """(machine, month, bytes) of each shard; contents aren't read."""
    files = spark.read.format("binaryFile").load(f"{home}/{PATTERN}").select("path", "length")
    return files.select(F.regexp_extract("path", _SHARD, 1).alias("machine"), F.regexp_extract("path", _SHARD, 2).alias("month"), F.col("length").alias("bytes"))


def shrunk(current: DataFrame, cursors: DataFrame) -> DataFrame:
    """Shards shorter than the cursor that was reached in them: their views must be rebuilt."""
    return cursors.withColumnRenamed("bytes", "reached").join(current, ["machine", "month"], "left").where(F.coalesce("bytes", F.lit(0)) < F.col("reached"))


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))


def read_lines(spark: SparkSession, home: str) -> DataFrame:
    """All lines that aren't blank, of shards and of bulk writes; a home without a log has none."""
    out = spark.createDataFrame([], "value string, shard_machine string, shard_month string")
    if _exists(spark, f"{home}/{PATTERN}"):
        path = F.col("_metadata.file_path")
        out = out.unionByName(spark.read.text(f"{home}/{PATTERN}").select("value", F.regexp_extract(path, _SHARD, 1).alias("shard_machine"), F.regexp_extract(path, _SHARD, 2).alias("shard_month")))
    if _exists(spark, f"{home}/bulk"):
        bulk = spark.read.text(f"{home}/bulk")
        out = out.unionByName(bulk.select("value", F.col("machine").cast("string").alias("shard_machine"), F.col("month").cast("string").alias("shard_month")))
    return out.where(F.trim("value") != "")


def _judged(lines: DataFrame, verify: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decoded claims, documents and other lines, each with ``value`` and with why it is left out (``warning``; null for records)."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX"}
    decoded = lines.select("value", F.from_json("value", RECORD, options).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull() | F.col("r").isNull()
    tag = F.coalesce(F.col("r.rec").isin(*RECORD_TAGS), F.lit(False))
    reason = F.when(bad, "not a record").when(~tag, "unknown record type").when(F.col("r.id").isNull(), "no id")
    rows = decoded.select("r.*", "value", reason.alias("warning")).drop("_corrupt_record")
    good = F.col("warning").isNull()
    claims, docs = (rows.where(good & (F.col("rec") == r)) for r in ("claim", "doc"))
    if verify:
        wrong = F.when(~F.coalesce(F.col("_address") == F.col("cid"), F.lit(False)), "address does not match")
        claims = with_address(claims, "_address").withColumn("warning", wrong).drop("_address")
        docs = docs.withColumn("_address", document_addresses("body")).withColumn("warning", wrong).drop("_address")
    return claims, docs, rows.where(~(good & F.coalesce(F.col("rec").isin("claim", "doc"), F.lit(False))))


def checked(lines: DataFrame, verify: bool = True) -> DataFrame:
    """All decoded lines with their ``warning``, for who keeps them and reads them more than once (``split``)."""
    claims, docs, others = _judged(lines, verify)
    return claims.unionByName(docs).unionByName(others)


def _records(claims: DataFrame, docs: DataFrame, others: DataFrame) -> Records:
    of = lambda rows, tag: rows.where(F.col("warning").isNull() & (F.col("rec") == tag)).drop("value", "warning")
    warnings = None
    for rows in dict.fromkeys((claims, docs, others)):
        left_out = rows.where("warning IS NOT NULL").select("value", "warning")
        warnings = left_out if warnings is None else warnings.unionByName(left_out)
    return Records(of(claims, "claim"), of(others, "status"), of(others, "counter"), of(docs, "doc"), warnings)


def split(rows: DataFrame) -> Records:
    """The records of checked rows by type."""
    return _records(rows, rows, rows)


def parse(lines: DataFrame, verify: bool = True) -> Records:
    """Decode lines (column ``value``). Bad JSON, unknown tags and wrong addresses become warnings, never failures."""
    return _records(*_judged(lines, verify))


def read(spark: SparkSession, home: str, verify: bool = True) -> Records:
    return parse(read_lines(spark, home), verify)


def month(t: Column | str) -> Column:
    """The month of a record's shard, in UTC (the session's zone)."""
    return F.date_format(t, "yyyy-MM")


def shard_path(machine: str, at: datetime) -> str:
    return f"log/{machine}/{at.astimezone(timezone.utc):%Y-%m}.jsonl"


def append(home: str, machine: str, record: dict, at: datetime) -> str:
    """Append one record as the only writer of its shard: under a lock, after a whole line, and synced."""
    path = os.path.join(home, shard_path(machine, at))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a+b") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        size = f.seek(0, os.SEEK_END)
        torn = False
        if size:
            f.seek(size - 1)
            torn = f.read(1) != b"\n"
        line = json.dumps({k: v for k, v in record.items() if v is not None}, ensure_ascii=False).encode() + b"\n"
        f.write(b"\n" * torn + line)
        f.flush()
        os.fsync(f.fileno())
    return path


def write(records: DataFrame, home: str, machine: Column | str, at: Column | str) -> None:
    """Append many records: files of their own under bulk/, by machine and month, which readers take with the shards."""
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns]))
    rows = records.select(body.alias("value"), F.lit(machine).alias("machine"), month(at).alias("month"))
    rows.write.mode("append").partitionBy("machine", "month").text(f"{home}/bulk")
