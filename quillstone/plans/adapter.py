"""The driver's tables as record tables of the log: the same expressions here and in ADAPTER_SQL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_line
from ..operators import views
from ..operators.branches import Branches
from ..operators.index import token_table

#: Branches of the adapted documents: <lang>/research and <lang>/code, with lateral and ancestor edges.
PROJECTS = {
    "en": {
        "research": {"holds": ["fact", "question", "claim", "rejected", "decision", "constraint"], "inherits": {"fr/research": ["fact"]}},
        "code": {"parent": "research", "holds": ["decision", "constraint", "rejected", "question", "fact"], "inherits": {"research": ["decision", "constraint", "rejected"], "de/code": ["decision"]}, "budget": 700},
    },
    "de": {"research": {}, "code": {"parent": "research", "inherits": {"research": ["decision"]}}},
    "fr": {"research": {"holds": ["fact", "decision", "question"]}, "code": {"parent": "research", "holds": ["decision", "rejected"]}},
    "es": {"research": {}},
}
BRANCHES = Branches(PROJECTS)

ADAPTER_SQL = r"""
WITH RECURSIVE claims_raw AS (
  SELECT lpad(CAST(doc_id AS VARCHAR), 26, '0') AS id, doc_id,
         ['fact', 'decision', 'rejected', 'constraint', 'question', 'claim'][doc_id % 6 + 1] AS kind,
         lang || CASE WHEN doc_id % 3 = 0 THEN '/research' ELSE '/code' END AS branch,
         text, CASE WHEN doc_id % 2 = 0 THEN string_split(text, chr(10))[1] END AS why,
         [lang, source] AS entities, ['src/' || source || '.md'] AS refs,
         CASE WHEN doc_id % 50 = 0 THEN 'proposed' ELSE 'active' END AS base_status,
         ['high', 'medium', 'low'][doc_id % 3 + 1] AS confidence, source AS src,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS t_tx,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id) - to_days(CAST(doc_id % 90 AS INTEGER)) AS t_valid,
         CASE WHEN doc_id % 11 = 0 AND doc_id >= 7 THEN lpad(CAST(doc_id - 7 AS VARCHAR), 26, '0') END AS supersedes,
         'b3:' || sha256(CAST(doc_id % 6 AS VARCHAR) || chr(10) || text) AS cid
  FROM documents
), n AS (SELECT count(*) AS n_docs FROM documents),
statuses AS (
  SELECT 'S' || lpad(CAST(event_id AS VARCHAR), 25, '0') AS id,
         lpad(CAST(event_id % n_docs AS VARCHAR), 26, '0') AS claim,
         CASE WHEN (event_id % n_docs) % 100 = 0 THEN 'proposed' WHEN event_type = 'error' THEN 'archived' WHEN event_type = 'purchase' THEN 'rejected' WHEN event_type = 'signup' THEN 'superseded' ELSE 'active' END AS to_status,
         event_type AS reason, 'm' || CAST(user_id % 5 AS VARCHAR) AS src, ts AS t_tx
  FROM events, n WHERE event_id % 7 = 0
), counters AS (
  SELECT 'C' || lpad(CAST(event_id AS VARCHAR), 25, '0') AS id,
         lpad(CAST(event_id % n_docs AS VARCHAR), 26, '0') AS claim, 'm' || CAST(user_id % 5 AS VARCHAR) AS machine,
         CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS helpful,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS harmful
  FROM events, n WHERE event_type IN ('view', 'error')
), implied AS (
  SELECT supersedes AS claim, 'superseded' AS to_status FROM claims_raw WHERE supersedes IS NOT NULL
), ranks(status, r) AS (VALUES ('proposed', 0), ('active', 1), ('superseded', 2), ('rejected', 3), ('archived', 4)),
moved AS (
  SELECT claim, max(r) AS r FROM (SELECT claim, to_status FROM statuses UNION ALL SELECT * FROM implied) JOIN ranks ON to_status = status GROUP BY claim
), totals AS (
  SELECT claim, CAST(sum(helpful) AS BIGINT) AS helpful, CAST(sum(harmful) AS BIGINT) AS harmful
  FROM (SELECT claim, machine, max(helpful) AS helpful, max(harmful) AS harmful FROM counters GROUP BY ALL) GROUP BY claim
), claims AS (
  SELECT c.*, coalesce(t.helpful, 0) AS helpful, coalesce(t.harmful, 0) AS harmful,
         (SELECT status FROM ranks WHERE r = greatest(b.r, coalesce(m.r, 0))) AS status
  FROM claims_raw c JOIN ranks b ON b.status = c.base_status LEFT JOIN moved m ON m.claim = c.id LEFT JOIN totals t ON t.claim = c.id
), docs_all AS (
  SELECT lpad(CAST(conv_id * 1000 + turn AS VARCHAR), 26, '0') AS id, ['en', 'de', 'fr', 'es'][conv_id % 4 + 1] || '/research' AS branch,
         'd' || CAST(conv_id // 3 AS VARCHAR) AS name, text AS body, role, conv_id
  FROM conversations
), docs AS (SELECT * FROM docs_all WHERE role <> 'system')
"""


@dataclass
class Adapted:
    """Record tables and views of one folder of driver tables."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        d, kinds = F.col("doc_id"), ("fact", "decision", "rejected", "constraint", "question", "claim")
        name = lambda x: F.lpad(x.cast("string"), 26, "0")
        at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + d * 60)
        return self.table("documents").select(
            name(d).alias("id"),
            d.alias("doc_id"),
            F.element_at(F.array(*map(F.lit, kinds)), (d % 6 + 1).cast("int")).alias("kind"),
            F.concat("lang", F.when(d % 3 == 0, "/research").otherwise("/code")).alias("branch"),
            "text",
            F.when(d % 2 == 0, first_line("text")).alias("why"),
            F.array("lang", "source").alias("entities"),
            F.array(F.concat(F.lit("src/"), "source", F.lit(".md"))).alias("refs"),
            F.when(d % 50 == 0, "proposed").otherwise("active").alias("status"),
            F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (d % 3 + 1).cast("int")).alias("confidence"),
            F.col("source").alias("src"),
            at.alias("t_tx"),
            F.timestamp_seconds(F.unix_timestamp(at) - (d % 90) * 86400).alias("t_valid"),
            F.when((d % 11 == 0) & (d >= 7), name(d - 7)).alias("supersedes"),
            # an address from a built-in function, so that SQL can say the same; canonical addresses are q_cid_blake3's
            F.concat(F.lit("b3:"), F.sha2(F.concat((d % 6).cast("string"), F.lit("\n"), "text"), 256)).alias("cid"),
        )

    @cached_property
    def _targets(self) -> DataFrame:
        n = F.broadcast(self.table("documents").agg(F.count("*").alias("n_docs")))  # one row
        return self.table("events").crossJoin(n).withColumns({"claim": F.lpad((F.col("event_id") % F.col("n_docs")).cast("string"), 26, "0"), "machine": F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string"))})

    @cached_property
    def statuses(self) -> DataFrame:
        # every second proposal stays one
        stays = (F.col("event_id") % F.col("n_docs")) % 100 == 0
        to = F.when(stays, "proposed").when(F.col("event_type") == "error", "archived").when(F.col("event_type") == "purchase", "rejected").when(F.col("event_type") == "signup", "superseded").otherwise("active")
        return self._targets.where(F.col("event_id") % 7 == 0).select(F.concat(F.lit("S"), F.lpad(F.col("event_id").cast("string"), 25, "0")).alias("id"), "claim", to.alias("to"), F.col("event_type").alias("reason"), F.col("machine").alias("src"), F.col("ts").alias("t_tx"))

    @cached_property
    def counters(self) -> DataFrame:
        helpful = F.when(F.col("event_type") == "view", F.floor("value")).otherwise(0)
        return self._targets.where(F.col("event_type").isin("view", "error")).select(F.concat(F.lit("C"), F.lpad(F.col("event_id").cast("string"), 25, "0")).alias("id"), "claim", "machine", helpful.cast("long").alias("helpful"), (F.col("event_type") == "error").cast("long").alias("harmful"), F.col("ts").alias("t_tx"))

    @cached_property
    def claims(self) -> DataFrame:
        return views.hydrate(self.raw, self.statuses, self.counters)

    @cached_property
    def kept(self) -> DataFrame:
        """``claims``, kept for queries that read them several times."""
        return self.claims.persist()

    @cached_property
    def index(self) -> DataFrame:
        """Tokens without stems, kept for the several passes of a search."""
        return token_table(self.kept, stemmed=False).persist()

    @cached_property
    def docs_all(self) -> DataFrame:
        c = F.col("conv_id")
        lang = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (c % 4 + 1).cast("int"))
        return self.table("conversations").select(F.lpad((c * 1000 + F.col("turn")).cast("string"), 26, "0").alias("id"), F.concat(lang, F.lit("/research")).alias("branch"), F.concat(F.lit("d"), F.expr("conv_id div 3").cast("string")).alias("name"), F.col("text").alias("body"), "role")

    @cached_property
    def doc_statuses(self) -> DataFrame:
        return self.docs_all.where("role = 'system'").select(F.concat(F.lit("D"), "id").alias("id"), F.col("id").alias("claim"), F.lit("archived").alias("to"))

    @cached_property
    def docs(self) -> DataFrame:
        return views.visible_docs(self.docs_all, self.doc_statuses)
