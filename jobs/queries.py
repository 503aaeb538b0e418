"""The jobs as registered queries: each runs twice into one new folder, and returns the output as it then stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import search_index, usage_ledger
from jobs.common import defaults
from quillstone.sources.shared import fresh_folder


def job1_usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "job1")
    for _ in range(2):
        usage_ledger.run(spark, f"{sf_dir}/events.parquet", f"{folder}/output", f"{folder}/checkpoint", defaults(usage_ledger.NAME))
    return usage_ledger.read_ledger(spark, f"{folder}/output")


def job2_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "job2")
    for _ in range(2):
        search_index.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/output", defaults(search_index.NAME))
    return search_index.read_index(spark, f"{folder}/output").postings.drop("shard")


QUERIES = {f.__name__: f for f in (job1_usage_ledger, job2_search_index)}

USAGE_LEDGER = r"""
WITH said AS (
  SELECT coalesce(strftime(ts, '%Y-%m-%d'), 'undated') AS day, CAST(props->>'k' AS BIGINT) AS claim, 'm' || CAST(user_id % 5 AS VARCHAR) AS machine,
         coalesce(CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) ELSE 0 END, 0) AS helpful, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS harmful,
         CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS r, event_id
  FROM events
), machines AS (
  SELECT day, claim, machine, max(helpful) AS helpful, max(harmful) AS harmful, max(r) AS r, count(*) AS records, max(event_id) AS last_id FROM said GROUP BY ALL
)
SELECT claim, ['proposed', 'active', 'superseded', 'rejected', 'archived'][max(r) + 1] AS status, CAST(sum(helpful) AS BIGINT) AS helpful, CAST(sum(harmful) AS BIGINT) AS harmful,
       count(machine) AS machines, CAST(sum(records) AS BIGINT) AS records, max(last_id) AS last_id, day
FROM machines GROUP BY day, claim
"""

SEARCH_INDEX = r"""
WITH fields AS (
  SELECT lpad(CAST(doc_id AS VARCHAR), 26, '0') AS id, f.field, regexp_extract_all(lower(coalesce(f.content, '')), '[\p{L}\p{N}]+') AS words
  FROM documents, LATERAL (
    SELECT 'text' AS field, text AS content UNION ALL SELECT 'entities', concat_ws(' ', lang, source) UNION ALL SELECT 'refs', 'src/' || source || '.md') f
), lengths AS (SELECT id, CAST(sum(len(words)) AS BIGINT) AS length FROM fields GROUP BY id),
tokens AS (SELECT id, field, unnest(words) AS token FROM fields)
SELECT t.token, t.field, t.id, count(*) AS tf, any_value(l.length) AS length FROM tokens t JOIN lengths l USING (id) GROUP BY t.token, t.field, t.id
"""

SQL = {"job1_usage_ledger": USAGE_LEDGER, "job2_search_index": SEARCH_INDEX}
