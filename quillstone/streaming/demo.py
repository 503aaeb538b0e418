"""All records of the driver's tables, written to a log in two parts and caught up as a stream: the rows of the batch view."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import document_addresses, with_address
from ..sources import log
from ..sources.shared import fresh_folder
from .kept import KeptView
from .source import catch_up, local_path, read_tables

#: Whose shard a record goes to; claims and documents of the tables have no machine.
MACHINES = {"claim": "'m0'", "status": "src", "counter": "machine", "doc": "'m0'"}


def shared_home(spark: SparkSession) -> str:
    """A fresh folder that all executors see."""
    return fresh_folder(spark, "home")


def records(adapted) -> dict[str, DataFrame]:
    """All records by ``rec``."""
    first = F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    said = F.timestamp_seconds(first + F.expr("CAST(id AS LONG) div 1000") * 60)  # documents have no time of their own
    claims = with_address(adapted.raw).select("id", "cid", "kind", "branch", "text", "why", "refs", "entities", "supersedes", "status", "confidence", "src", "t_valid", "t_tx")
    moved = adapted.statuses.select("id", "claim", "to", "reason", "src", F.col("t_tx").cast("timestamp"))
    gone = adapted.doc_statuses.select("id", "claim", "to", F.lit(None).cast("string").alias("reason"), F.lit("m0").alias("src"), F.timestamp_seconds(first + F.expr("CAST(claim AS LONG) div 1000") * 60).alias("t_tx"))
    counters = adapted.counters.select("id", "claim", "machine", "helpful", "harmful", F.col("t_tx").cast("timestamp"))
    docs = adapted.docs_all.select("id", document_addresses("body").alias("cid"), "branch", "name", "body", said.alias("t_tx"))
    return {"claim": claims, "status": moved.unionByName(gone), "counter": counters, "doc": docs}


def catch_up_twice(adapted, home: str) -> DataFrame:
    """(rec, branch, n, last) of what the stream has read; lines that it left out have the rec ``warning``.

    Half of all records goes to bulk files before the first catch-up, half after it. The newest claim is a line
    of a shard, torn at the first.
    """
    spark, found = adapted.spark, records(adapted)
    args = (spark, home, f"{home}/tables", f"{home}/checkpoint")
    newest = found["claim"].agg(F.max("id")).first()[0]
    last = found["claim"].where(F.col("id") == newest).select(F.to_json(F.struct(F.lit("claim").alias("rec"), "*")))
    lines = "".join(r[0] + "\n" for r in last.collect()).encode()
    found["claim"] = found["claim"].where(~F.coalesce(F.col("id") == newest, F.lit(False)))
    path = os.path.join(local_path(home), "log/m0/2024-01.jsonl")
    os.makedirs(os.path.dirname(path))
    for half, part in enumerate((lines[:20], lines[20:])):
        with open(path, "ab") as f:
            f.write(part)
        for rec, df in found.items():
            some = df.where(F.pmod(F.xxhash64("id"), F.lit(2)) == half)
            log.write(some.select(F.lit(rec).alias("rec"), "*"), home, F.expr(MACHINES[rec]), "t_tx")
        catch_up(*args)
    return summary(read_tables(spark, args[2]))


def keep_twice(adapted, home: str) -> KeptView:
    """The kept view of a log that half of all records are written to before it is first brought up to date, and half after.

    An id of a log is of one record, and a status can be of any. The tables number claims and documents alike, so
    here documents, which the statuses D... are about, go by ids of their own.
    """
    kept, found = KeptView(adapted.spark, home, f"{home}/view"), records(adapted)
    own = lambda c: F.concat(F.lit("T"), F.substring(c, 2, 25))
    found["doc"] = found["doc"].withColumn("id", own("id"))
    found["status"] = found["status"].withColumn("claim", F.when(F.col("id").startswith("D"), own("claim")).otherwise(F.col("claim")))
    for half in (0, 1):
        for rec, df in found.items():
            some = df.where(F.pmod(F.xxhash64("id"), F.lit(2)) == half)
            log.write(some.select(F.lit(rec).alias("rec"), "*"), home, F.expr(MACHINES[rec]), "t_tx")
        kept.catch_up()
    return kept


def summary(r: log.Records) -> DataFrame:
    out = None
    for rec, df in (("claim", r.claims), ("status", r.statuses), ("counter", r.counters), ("doc", r.docs), ("warning", r.warnings)):
        df = df.select(F.lit(rec).alias("rec"), "branch" if rec in ("claim", "doc") else F.lit(None).cast("string").alias("branch"), "id" if rec != "warning" else F.lit(None).cast("string").alias("id"))
        out = df if out is None else out.unionByName(df)
    return out.groupBy("rec", "branch").agg(F.count("*").alias("n"), F.max("id").alias("last"))
