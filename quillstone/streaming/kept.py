"""A view of the log that is kept, and brought up to date by what is new alone.

Records are facts, written once for each batch of new lines and dealt by the id they are about into a fixed number of buckets. A batch
then writes the buckets it touches again, from the facts of all batches: everything known of a claim is in its bucket, so
no other bucket changes. Merges are maxima, sums and unions, so the order of batches doesn't matter, and a batch that
is retried replaces its own facts and gives the same buckets.

A log that has lost lines, or a view that another version of the schema has written, is made again: in a folder of its own, a
generation, which readers see only when it is whole and its row is added to the list of generations.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import RECORD
from ..operators import views
from ..sources.log import Records, checked, split
from .source import SHRUNK, take_new

#: Record types, and the column that names whom a record is about.
ABOUT = {"claims": "id", "statuses": "claim", "counters": "claim", "docs": "id"}
_FACTS = T.StructType([f for f in RECORD.fields if f.name != "_corrupt_record"])
_VIEWS = {
    "claims": T.StructType([f for f in _FACTS.fields if f.name not in ("helpful", "harmful")] + [T.StructField("base_status", T.StringType()), T.StructField("helpful", T.LongType()), T.StructField("harmful", T.LongType())]),
    "docs": T.StructType([*_FACTS.fields, T.StructField("visible", T.BooleanType())]),
}
#: Bumped when the meaning of what is kept changes though its schema doesn't.
RULES = 1
#: Of facts, those that are records of the log; the others are told by records of other types.
_SAID = f"id <> '' AND NOT startswith(id, '{views.IMPLIED}')"
_GENERATION = "number long, generation string, version string, buckets int"


class KeptView:
    """The view of the log under ``home`` that is kept under ``root``; one writer, any number of readers."""

    def __init__(self, spark: SparkSession, home: str, root: str, buckets: int = 16):
        self.spark, self.home, self.root, self.buckets = spark, home, root.rstrip("/"), buckets

    # --- generations -----------------------------------------------------------

    @property
    def version(self) -> str:
        """Of the schemas and rules that the view is written by."""
        said = "|".join([str(RULES), _FACTS.json(), *(v.json() for v in _VIEWS.values())])
        return hashlib.sha256(said.encode()).hexdigest()[:16]

    def _exists(self, path: str) -> bool:
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(found)

    def current(self) -> T.Row | None:
        """The newest generation that is whole; None before the first."""
        if not self._exists(f"{self.root}/generations"):
            return None
        return self.spark.read.schema(_GENERATION).json(f"{self.root}/generations").orderBy(F.desc("number")).first()

    def rebuild(self) -> None:
        """Make a new generation of the whole log, and let readers see it. Older ones stay for those who are reading them."""
        last = self.current()
        generation, number = uuid.uuid4().hex, last["number"] + 1 if last else 0
        take_new(self.spark, self.home, f"{self.root}/{generation}/checkpoint", self._ingest(f"{self.root}/{generation}", self.buckets))
        row = self.spark.createDataFrame([(number, generation, self.version, self.buckets)], _GENERATION)
        row.coalesce(1).write.mode("append").json(f"{self.root}/generations")

    def catch_up(self) -> KeptView:
        """Take what is new in the log; all of it if there is no view yet, if the log has lost lines, or if the view is of another version."""
        last = self.current()
        if last is None or last["version"] != self.version:
            self.rebuild()
            return self
        folder = f"{self.root}/{last['generation']}"
        try:
            take_new(self.spark, self.home, f"{folder}/checkpoint", self._ingest(folder, last["buckets"]))
        except StreamingQueryException as e:
            if SHRUNK not in str(e):
                raise
            self.rebuild()
        return self

    # --- writing ---------------------------------------------------------------

    def _ingest(self, folder: str, buckets: int):
        def bucket(about: str) -> Column:
            return F.pmod(F.xxhash64(about), F.lit(buckets)).cast("int").alias("bucket")

        def told(name: str, about: str, when: Column) -> Column:
            return F.when(when, F.struct(F.lit(name).alias("name"), bucket(about)))

        def ingest(lines: DataFrame, batch: int) -> None:
            rows = checked(lines).persist()
            rec = F.when(F.col("warning").isNotNull(), "warning").otherwise(F.col("rec"))
            own = [told(name, ABOUT.get(name, "id"), rec == tag) for tag, name in (("claim", "claims"), ("status", "statuses"), ("counter", "counters"), ("doc", "docs"), ("warning", "warnings"))]
            # a claim may also say something of the one that it replaces, and have counts of its own
            more = [told("statuses", "supersedes", (rec == "claim") & F.col("supersedes").isNotNull()), told("counters", "id", (rec == "claim") & (F.col("helpful").isNotNull() | F.col("harmful").isNotNull()))]
            there = rows.select(F.explode(F.array_compact(F.array(*own, *more))).alias("t")).select("t.*").distinct().collect()  # six for each bucket at most
            names = {r["name"] for r in there}
            found = split(rows)
            inline = views.inline_counters(found.claims).withColumns({c: F.col(c).cast("string") for c in ("helpful", "harmful")})
            parts = {
                "claims": found.claims,
                "statuses": found.statuses.unionByName(views.implied_statuses(found.claims), allowMissingColumns=True),
                "counters": found.counters.unionByName(inline, allowMissingColumns=True),
                "docs": found.docs,
            }
            for name in names & parts.keys():
                out = parts[name].select(*_FACTS.names, bucket(ABOUT[name])).repartition("bucket")
                out.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/facts/{name}/batch={batch}")
            if "warnings" in names:
                found.warnings.write.mode("overwrite").parquet(f"{folder}/warnings/batch={batch}")
            rows.unpersist()
            self._renew(folder, sorted({r["bucket"] for r in there if r["name"] in ("claims", "statuses", "counters")}), sorted({r["bucket"] for r in there if r["name"] in ("docs", "statuses")}))

        return ingest

    def _facts(self, folder: str, name: str) -> DataFrame:
        schema = T.StructType([*_FACTS.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
        path = f"{folder}/facts/{name}"
        return self.spark.read.schema(schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    def _renew(self, folder: str, claims: list[int], docs: list[int]) -> None:
        """Write these buckets again, of claims and of documents."""
        known = lambda name, touched: self._facts(folder, name).where(F.col("bucket").isin(*touched)).drop("batch")
        made = {}
        if claims:
            # what supersession implies is among the statuses, by the claim that is replaced, whatever bucket the one that replaces it is in
            made["claims"] = views.hydrate(views.unique_records(known("claims", claims)), known("statuses", claims), known("counters", claims))
        if docs:
            archived = known("statuses", docs).where("to = 'archived'").select(F.col("claim").alias("id"), F.lit(False).alias("visible")).distinct()
            made["docs"] = views.unique_records(known("docs", docs)).join(archived, "id", "left").withColumn("visible", F.coalesce("visible", F.lit(True)))
        for name, df in made.items():
            out = df.select(*_VIEWS[name].names, "bucket").repartition("bucket")
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{folder}/view/{name}")

    # --- reading ---------------------------------------------------------------

    def _folder(self) -> str:
        last = self.current()
        if last is None:
            raise ValueError("nothing is kept yet: catch up first")
        return f"{self.root}/{last['generation']}"

    def _read(self, path: str, schema: T.StructType, partition: str) -> DataFrame:
        kind = T.IntegerType() if partition == "bucket" else T.LongType()
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField(partition, kind)])).parquet(path).drop(partition)

    def claims(self) -> DataFrame:
        """Claims as readers see them: effective status and counter totals."""
        return self._read(f"{self._folder()}/view/claims", _VIEWS["claims"], "bucket")

    def docs(self) -> DataFrame:
        """The newest visible version of each document."""
        kept = self._read(f"{self._folder()}/view/docs", _VIEWS["docs"], "bucket")
        return views.newest_docs(kept.where("visible").drop("visible"))

    def records(self) -> Records:
        """The facts by type, and the lines that were left out; nothing is parsed again."""
        folder, warnings = self._folder(), T.StructType([T.StructField("value", T.StringType()), T.StructField("warning", T.StringType())])
        facts = {name: self._facts(folder, name).drop("batch", "bucket").where(_SAID) for name in ABOUT}
        return Records(**facts, warnings=self._read(f"{folder}/warnings", warnings, "batch"))

    def taken(self) -> DataFrame:
        """(batch, records) that each batch has taken of the log."""
        folder, out = self._folder(), None
        for name in ABOUT:
            df = self._facts(folder, name).where(_SAID).select("batch")
            out = df if out is None else out.unionByName(df)
        return out.groupBy("batch").agg(F.count("*").alias("records"))

    def changed(self, since: int) -> DataFrame:
        """Ids that records of batches from ``since`` on are about: what must be looked at again by whoever looked before."""
        folder, out = self._folder(), None
        for name, about in ABOUT.items():
            df = self._facts(folder, name).where(F.col("batch") >= since).select(F.col(about).alias("id"))
            out = df if out is None else out.unionByName(df)
        return out.distinct()
