"""Usage ledger: what each claim went through each day, from a growing table of events.

The events are a file stream: its checkpoint says which files were taken, and a run takes all that are new and ends. Each
batch first writes its own facts, the least that the days need of it (one row a day, claim and machine), to a folder
of its number, and then writes the days it touches again from the facts of all batches. Counters are maxima by machine and
a status is the highest said, so neither the order nor the lateness of events matters: an old day that gets late events
is written again. A batch that is retried replaces its own facts, and a day that is written again has the same rows.

    python -m jobs.usage_ledger --events DIR --target DIR --checkpoint DIR [--config FILE]
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main
from quillstone.model import rank, status_of

NAME = "usage_ledger"
FACTS = "claim long, machine string, helpful long, harmful long, rank int, records long, last_id long, batch long, day string"
LEDGER = "claim long, status string, helpful long, harmful long, machines long, records long, last_id long, day string"
#: Day of events without a time.
UNDATED = "undated"


def facts(events: DataFrame, config: dict) -> DataFrame:
    """One row a day, claim and machine. A claim that can't be read is null, which is a claim of its own."""
    said = events.select(
        F.coalesce(F.expr(config["day"]), F.lit(UNDATED)).alias("day"),
        F.expr(config["claim"]).cast("long").alias("claim"),
        F.expr(config["machine"]).alias("machine"),
        *[F.coalesce(F.expr(config[c]).cast("long"), F.lit(0)).alias(c) for c in ("helpful", "harmful")],
        rank(F.expr(config["status"])).alias("rank"),
        F.col("event_id").cast("long").alias("event_id"),
    )
    most = [F.max(c).alias(c) for c in ("helpful", "harmful", "rank")]
    return said.groupBy("day", "claim", "machine").agg(*most, F.count("*").alias("records"), F.max("event_id").alias("last_id"))


def ledger(found: DataFrame) -> DataFrame:
    """The days of facts: maxima of each machine over all batches, then sums over the machines."""
    most = [F.max(c).alias(c) for c in ("helpful", "harmful", "rank", "last_id")]
    each = found.groupBy("day", "claim", "machine").agg(*most, F.sum("records").alias("records"))
    sums = [F.sum(c).alias(c) for c in ("helpful", "harmful")]
    days = each.groupBy("day", "claim").agg(F.max("rank").alias("rank"), *sums, F.count("machine").alias("machines"), F.sum("records").alias("records"), F.max("last_id").alias("last_id"))
    return days.select("claim", status_of("rank").alias("status"), "helpful", "harmful", "machines", "records", "last_id", "day")


def read_ledger(spark: SparkSession, target: str) -> DataFrame:
    """The ledger as it stands; ``day`` is a partition."""
    return spark.read.schema(LEDGER).parquet(f"{target}/ledger")


def run(spark: SparkSession, events: str, target: str, checkpoint: str, config: dict) -> dict:
    """Take the events that are new since the last run with this checkpoint; (batches, rows read, days written).

    ``events`` is a folder or file that Spark reads as Parquet. A run without new files leaves everything as it is.
    """
    done = {"batches": 0, "rows": 0, "days": 0}
    schema = spark.read.parquet(events).schema
    path = events.rstrip("/")
    # a stream reads folders; as a pattern, which matches only itself, the path may also be that of one file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(f"{path[:-1]}[{path[-1]}]")

    def take(new: DataFrame, batch: int) -> None:
        folder = f"{target}/facts/batch={batch}"
        facts(new, config).write.mode("overwrite").partitionBy("day").parquet(folder)
        all_facts = spark.read.schema(FACTS).parquet(f"{target}/facts")
        mine = all_facts.where(F.col("batch") == batch).groupBy("day").agg(F.sum("records").alias("records")).collect()  # a row a day
        days = [r["day"] for r in mine]
        if days:
            again = ledger(all_facts.where(F.col("day").isin(*days)))
            again.repartition("day").sortWithinPartitions("claim").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{target}/ledger")
        done["batches"] += 1
        done["rows"] += sum(r["records"] for r in mine)
        done["days"] += len(days)
        log.info("%s: batch %d read %d events of %s, wrote %d days", NAME, batch, sum(r["records"] for r in mine), events, len(days))

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %d batches, %d events read, %d days written to %s/ledger", NAME, done["batches"], done["rows"], done["days"], target)
    return done


if __name__ == "__main__":
    main(NAME, __doc__.split("\n")[0], run, {"events": "folder of events, Parquet", "target": "folder of the ledger", "checkpoint": "folder of the stream's checkpoint"})
