"""The registered queries over the driver's tables, each with the DuckDB statement it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical, text
from ..operators import index, listing, mutations, packer, views, weights
from ..operators.branches import find_docs, holds_violations, pool
from ..sources.shared import fresh_folder
from .adapter import ADAPTER_SQL, BRANCHES, Adapted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: What the search queries look for, and what the packs of a task are about.
WORDS = "the thing onthe shstand"
LIMIT = 20


def query(sql: str | None = None, adapted: bool = True):
    def register(f: Callable[[Adapted], DataFrame]) -> Callable[[Adapted], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Adapted(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = (ADAPTER_SQL if adapted else "") + sql
        return f

    return register


# --- scans, filters, lookups ---------------------------------------------------


@query("SELECT id, kind, branch, status FROM claims WHERE branch = 'en/code' AND kind IN ('fact', 'decision') AND status IN ('active', 'superseded') AND t_tx >= TIMESTAMP '2024-01-01 01:00:00'")
def q_scan_filter(a: Adapted) -> DataFrame:
    return views.scan(a.claims, "en/code", ("fact", "decision"), ("active", "superseded"), "2024-01-01 01:00:00").select("id", "kind", "branch", "status")


@query("SELECT id, branch FROM claims_raw ORDER BY id DESC LIMIT 25")
def q_scan_limit_recent(a: Adapted) -> DataFrame:
    return views.scan(a.raw, limit=25).select("id", "branch")


@query("SELECT id FROM claims_raw WHERE starts_with(id, '0000000000000000000000001') OR starts_with(cid, 'b3:0000000000000000000000001') ORDER BY id LIMIT 20")
def q_resolve_prefix(a: Adapted) -> DataFrame:
    return views.resolve(a.raw, "0000000000000000000000001").select("id")


@query("SELECT id, status FROM claims WHERE id = lpad('42', 26, '0')")
def q_get(a: Adapted) -> DataFrame:
    return a.claims.where(F.col("id") == "42".rjust(26, "0")).select("id", "status")


@query("SELECT cid, branch, min(id) AS id FROM claims_raw GROUP BY ALL")
def q_find_by_cid_branch(a: Adapted) -> DataFrame:
    return views.find_by_address(a.raw)


@query("SELECT id FROM claims WHERE status = 'proposed'")
def q_proposals(a: Adapted) -> DataFrame:
    return views.scan(a.claims, statuses=("proposed",)).select("id")


@query("SELECT id FROM claims WHERE status <> 'archived'")
def q_visible(a: Adapted) -> DataFrame:
    return views.visible(a.claims).select("id")


@query(r"SELECT doc_id, nfc_normalize(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\x{a0}]+(\n|$)', '\1', 'g'), '\n+$', '')) AS text FROM documents", adapted=False)
def q_normalize_text(a: Adapted) -> DataFrame:
    return a.table("documents").select("doc_id", canonical.normalized("text").alias("text"))


@query("SELECT cid, branch, count(*) AS copies, min(id) AS first_id, max(id) AS last_id FROM claims_raw GROUP BY cid, branch")
def q_dedup_content(a: Adapted) -> DataFrame:
    return views.duplicates(a.raw)


@query("SELECT id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM claims_raw")
def q_token_estimate(a: Adapted) -> DataFrame:
    return a.raw.select("id", text.estimate("text").alias("tokens"))


@query(r"SELECT id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug, string_split(text, chr(10))[1] AS first_line, string_split(branch, '/')[-1] AS lane, string_split(branch, '/')[1] AS project, substr(cid, 4, 4) AS tag FROM claims_raw")
def q_scalar_names(a: Adapted) -> DataFrame:
    return a.raw.select("id", text.slug("text").alias("slug"), text.first_line("text").alias("first_line"), text.lane("branch").alias("lane"), text.project("branch").alias("project"), text.short_tag("cid").alias("tag"))


@query()
def q_cid_blake3(a: Adapted) -> DataFrame:
    return canonical.with_address(a.raw).select("id", "cid")


@query()
def q_merkle_root_by_branch(a: Adapted) -> DataFrame:
    return canonical.merkle_roots(canonical.with_address(a.raw).where("status = 'active'"), ["branch"])


# --- merges and aggregates -----------------------------------------------------


@query("SELECT id, base_status, status FROM claims")
def q_effective_status(a: Adapted) -> DataFrame:
    return views.effective_status(a.raw, a.statuses).select("id", "base_status", "status")


@query("SELECT id, claim, to_status, reason, src FROM statuses")
def q_status_history(a: Adapted) -> DataFrame:
    return views.status_history(a.statuses).select("id", "claim", F.col("to").alias("to_status"), "reason", "src")


@query("SELECT 'sup:' || id AS id, supersedes AS claim FROM claims_raw WHERE supersedes IS NOT NULL")
def q_supersede_implied(a: Adapted) -> DataFrame:
    return views.implied_statuses(a.raw).select("id", "claim")


@query("SELECT claim, helpful, harmful FROM totals")
def q_gcounter(a: Adapted) -> DataFrame:
    return views.counter_totals(a.counters)


@query("SELECT branch, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'proposed') AS proposed, count(*) AS total, max(t_tx) AS last FROM claims GROUP BY branch")
def q_branch_summary(a: Adapted) -> DataFrame:
    return views.branch_summary(a.claims)


@query("SELECT kind, branch, count(*) AS n FROM claims GROUP BY GROUPING SETS ((kind), (branch), ())")
def q_stats(a: Adapted) -> DataFrame:
    return views.stats(a.claims)


@query("SELECT greatest((SELECT max(id) FROM claims_raw), (SELECT max(id) FROM statuses), (SELECT max(id) FROM counters), (SELECT max(id) FROM docs_all)) AS generation")
def q_generation(a: Adapted) -> DataFrame:
    return views.generation(a.raw, a.statuses, a.counters, a.docs_all)


@query("SELECT branch, name, max(id) AS id, arg_max(body, id) AS body FROM docs GROUP BY branch, name")
def q_current_docs(a: Adapted) -> DataFrame:
    return views.current_docs(a.docs_all, a.doc_statuses).select("branch", "name", "id", "body")


@query("SELECT id, branch, name FROM docs WHERE branch = 'en/research'")
def q_doc_versions(a: Adapted) -> DataFrame:
    return views.doc_versions(a.docs_all, a.doc_statuses, "en/research").select("id", "branch", "name")


@query("SELECT branch, name, CAST(ceil(length(arg_max(body, id)) / 4.0) AS BIGINT) AS tokens, 'documents/' || branch || '/' || name AS location FROM docs GROUP BY branch, name")
def q_doc_listing(a: Adapted) -> DataFrame:
    rows = views.current_docs(a.docs_all, a.doc_statuses).withColumn("title", text.title_of("body", "name"))
    return views.doc_listing(rows).select("branch", "name", "tokens", "location")


_POOL_VALUES = ", ".join(f"('{b}', '{s}', " + ("NULL" if k is None else "[" + ", ".join(f"'{x}'" for x in k) + "]") + ")" for b in BRANCHES.all() for s, k in BRANCHES.pool_sources(b).items())

_RULES = []
for _b in BRANCHES.all():
    _d = BRANCHES.get(_b) or {}
    for _n, _k in (_d.get("inherits") or {}).items():
        _RULES.append((_b, BRANCHES.qualify(_b, _n), "parent" if _n == _d.get("parent") else "lateral", _k))
    if _d.get("parent") and _d["parent"] not in (_d.get("inherits") or {}):
        _RULES.append((_b, BRANCHES.qualify(_b, _d["parent"]), "parent", None))
_ALL_KINDS = "['fact', 'decision', 'rejected', 'constraint', 'question', 'claim']"
_list = lambda ks: _ALL_KINDS if not ks else "[" + ", ".join(f"'{k}'" for k in ks) + "]"
#: The pool from the edges themselves, walked by a recursive query that narrows the kinds at each hop.
_POOL_SQL = f"""
, edges(child, parent, how, kinds) AS (VALUES {", ".join(f"('{c}', '{p}', '{h}', {_list(k)})" for c, p, h, k in _RULES)}),
defs(branch, holds) AS (VALUES {", ".join(f"('{b}', {_list((BRANCHES.get(b) or {}).get('holds'))})" for b in BRANCHES.all())}),
walk AS (
  SELECT d.branch, d.branch AS node, d.holds AS kinds FROM defs d
  UNION ALL
  SELECT w.branch, e.parent, list_intersect(w.kinds, e.kinds) FROM walk w JOIN edges e ON e.child = w.node AND e.how = 'parent'
), granted AS (
  SELECT branch, node AS source, unnest(kinds) AS kind FROM walk WHERE node <> branch
  UNION SELECT child, parent, unnest(kinds) FROM edges WHERE how = 'lateral'
  UNION SELECT branch, branch, unnest({_ALL_KINDS}) FROM defs
)
SELECT g.branch AS for_branch, c.id, c.branch FROM claims c JOIN granted g ON g.source = c.branch AND g.kind = c.kind WHERE c.status IN ('active', 'superseded')
"""


@query(_POOL_SQL)
def q_pool(a: Adapted) -> DataFrame:
    return pool(a.claims, BRANCHES.pool_table(a.spark)).select("for_branch", "id", "branch")


@query(f", defs(branch, holds) AS (VALUES {', '.join(f'''('{b}', {_list((BRANCHES.get(b) or {}).get('holds'))})''' for b in BRANCHES.all())}) SELECT c.id, c.branch, c.kind FROM claims_raw c JOIN defs d ON c.branch = d.branch WHERE NOT list_contains(d.holds, c.kind)")
def q_holds_violations(a: Adapted) -> DataFrame:
    return holds_violations(a.raw, BRANCHES.holds_table(a.spark)).select("id", "branch", "kind")


@query(f""", sources(branch, source, kinds) AS (VALUES {_POOL_VALUES}), newest AS (
  SELECT branch, name, max(id) AS id FROM docs GROUP BY branch, name
), seen AS (
  SELECT s.branch AS for_branch, n.name, n.id, n.branch AS doc_branch, CASE WHEN s.source = s.branch THEN 0 ELSE 1 END AS priority FROM sources s JOIN newest n ON n.branch = s.source
  UNION ALL
  SELECT b.branch, n.name, n.id, n.branch, 2 FROM (SELECT DISTINCT branch FROM sources) b JOIN newest n ON split_part(n.branch, '/', 1) = split_part(b.branch, '/', 1)
)
SELECT for_branch, name, id, doc_branch, priority FROM (
  SELECT *, row_number() OVER (PARTITION BY for_branch, name ORDER BY priority, CASE WHEN priority < 2 THEN doc_branch END, id DESC) AS turn FROM seen
) WHERE turn = 1""")
def q_doc_fallback(a: Adapted) -> DataFrame:
    return find_docs(views.current_docs(a.docs_all, a.doc_statuses), BRANCHES.pool_table(a.spark)).select("for_branch", "name", "id", "doc_branch", "priority")


# --- weights and rendering -----------------------------------------------------

_WEIGHT = """, weighted AS (
  SELECT *, CASE kind WHEN 'constraint' THEN 1.0 WHEN 'decision' THEN 1.0 WHEN 'rejected' THEN 0.9 WHEN 'fact' THEN 0.8 WHEN 'question' THEN 0.7 ELSE 0.6 END::DOUBLE
    * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.8 ELSE 0.5 END::DOUBLE
    * CASE status WHEN 'active' THEN 1.0 WHEN 'superseded' THEN 0.15 ELSE 0.0 END::DOUBLE
    * CASE WHEN kind = 'constraint' THEN 1.0::DOUBLE ELSE exp(-(ln(2.0::DOUBLE) / 180) * (epoch((SELECT max(t_tx) FROM claims)) - epoch(t_valid)) / 86400.0::DOUBLE) END
    * ((1.0::DOUBLE + helpful) / (1.0::DOUBLE + helpful + 2.0::DOUBLE * harmful)) AS weight
  FROM claims
) """


@query(_WEIGHT + "SELECT id, round(weight, 9) AS weight FROM weighted")
def q_claim_weight(a: Adapted) -> DataFrame:
    return weights.weighted(a.claims).select("id", F.round("weight", 9).alias("weight"))


@query(_WEIGHT + "SELECT tag, round(max(weight), 9) AS best, count(*) AS n FROM (SELECT unnest(entities) AS tag, weight FROM weighted) GROUP BY tag")
def q_tag_coverage(a: Adapted) -> DataFrame:
    return packer.tag_coverage(weights.weighted(a.claims)).select("tag", F.round("best", 9).alias("best"), "n")


@query("""SELECT id, CAST(ceil(length(line) / 4.0) AS BIGINT) AS cost,
  CAST(ceil((length(line) + CASE WHEN why IS NULL THEN 0 ELSE 10 + length(why) END) / 4.0) AS BIGINT) - CAST(ceil(length(line) / 4.0) AS BIGINT) AS why_cost
FROM (SELECT id, why, '- ' || CASE WHEN status = 'superseded' THEN 'Previously: ' ELSE '' END || replace(text, chr(10), chr(10) || '  ') || ' (`' || refs[1] || '`)'
  || CASE WHEN branch <> 'en/code' THEN ' _(' || string_split(branch, '/')[-1] || ')_' ELSE '' END || ' [c:' || substr(cid, 4, 4) || ']' || chr(10) AS line FROM claims)""")
def q_bullet_cost(a: Adapted) -> DataFrame:
    base, why = weights.bullet_cost(F.lit("en/code"))
    return a.claims.select("id", base.alias("cost"), why.alias("why_cost"))


@query("""SELECT part, title, count(*) AS n FROM (SELECT CASE WHEN status = 'superseded' THEN 3 WHEN kind IN ('decision', 'claim') THEN 0 WHEN kind = 'fact' THEN 1 WHEN kind = 'constraint' THEN 2 WHEN kind = 'rejected' THEN 3 ELSE 4 END AS part FROM claims)
JOIN (VALUES (0, 'Thesis'), (1, 'Evidence'), (2, 'Constraints'), (3, 'Contradictions and rejected paths'), (4, 'Open questions')) t(p, title) ON p = part GROUP BY ALL""")
def q_section_counts(a: Adapted) -> DataFrame:
    order, title = weights.section("dossier")
    return a.claims.groupBy(order.alias("part"), title.alias("title")).agg(F.count("*").alias("n"))


# --- retrieval -----------------------------------------------------------------

_TERMS = text.query_terms(WORDS)


def _prefix(column: str, terms=_TERMS) -> str:
    return " OR ".join(f"starts_with({column}, '{t}')" for t in terms)


_INDEX = r""", fields AS (
  SELECT id, f.field, f.w, regexp_extract_all(lower(coalesce(f.content, '')), '[\p{L}\p{N}]+') AS words FROM claims, LATERAL (
    SELECT 'text' AS field, 1.0::DOUBLE AS w, text AS content UNION ALL SELECT 'why', 0.5, why
    UNION ALL SELECT 'entities', 2.0, array_to_string(entities, ' ') UNION ALL SELECT 'refs', 1.5, array_to_string(refs, ' ')) f
), lengths AS (SELECT id, CAST(sum(len(words)) AS BIGINT) AS length FROM fields GROUP BY id),
tokens AS (SELECT id, field, w, unnest(words) AS token FROM fields),
corpus AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(length) AS average FROM lengths WHERE length > 0)"""
_BM25 = _INDEX + f""", hits AS (
  SELECT t.id, q.term, sum(t.w) AS wtf FROM tokens t JOIN (SELECT unnest({_TERMS!r}) AS term) q ON starts_with(t.token, q.term) GROUP BY ALL
), frequencies AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM hits GROUP BY term),
scored AS (
  SELECT h.id, count(*) AS matched, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * l.length / average))) AS score
  FROM hits h JOIN frequencies USING (term) JOIN lengths l ON l.id = h.id, corpus GROUP BY h.id
)"""
_HYBRID = _BM25 + f""", passing AS (SELECT s.* FROM scored s JOIN claims c USING (id) WHERE c.status <> 'archived'),
lists AS (
  SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id DESC) AS rank FROM passing
  QUALIFY rank <= 80
), strict AS (
  SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id DESC) AS rank FROM passing WHERE matched = {len(_TERMS)} QUALIFY rank <= 80
), fused AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM lists UNION ALL SELECT * FROM strict) GROUP BY id)"""


@query(_BM25 + " SELECT id, matched, round(score, 9) AS score FROM scored")
def q_search_bm25(a: Adapted) -> DataFrame:
    return index.bm25(a.index, _TERMS, stemmed=False).select("id", "matched", F.round("score", 9).alias("score"))


@query(_INDEX + " SELECT t.token, t.field, t.id, count(*) AS tf, any_value(l.length) AS length FROM tokens t JOIN lengths l USING (id) GROUP BY t.token, t.field, t.id")
def q_postings(a: Adapted) -> DataFrame:
    return index.postings(index.token_table(a.claims, stemmed=False))


@query(_HYBRID + " SELECT id, round(score, 12) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, id DESC) AS rank FROM fused QUALIFY rank <= 20")
def q_search_hybrid(a: Adapted) -> DataFrame:
    found = index.search(a.index, views.visible(a.kept).select("id", "kind", "branch"), WORDS, LIMIT, stemmed=False)
    return found.select("id", F.round("score", 12).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_BM25 + " SELECT id, matched, round(score, 9) AS score FROM scored")
def q_search_stored(a: Adapted) -> DataFrame:
    """The index is written first, of what claims say, which no status or count alters; the search then reads the ranges of its words."""
    stored = index.write_index(index.token_table(a.raw, stemmed=False), fresh_folder(a.spark, "index"))
    return index.bm25(stored, _TERMS, stemmed=False).select("id", "matched", F.round("score", 9).alias("score"))


@query(_HYBRID + " SELECT id, round(score, 12) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, id DESC) AS rank FROM fused QUALIFY rank <= 20")
def q_search_stored_hybrid(a: Adapted) -> DataFrame:
    stored = index.write_index(index.token_table(a.raw, stemmed=False), fresh_folder(a.spark, "index"))
    found = index.search(stored, views.visible(a.claims).select("id", "kind", "branch"), WORDS, LIMIT, stemmed=False)
    return found.select("id", F.round("score", 12).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def q_search_stemmed(a: Adapted) -> DataFrame:
    return index.search(index.token_table(a.kept).persist(), views.visible(a.kept).select("id", "kind", "branch"), "running things and nations", LIMIT)


@query(r"""SELECT id, matched FROM (SELECT id, len(list_intersect(list_distinct(regexp_extract_all(lower(concat_ws(' ', text, why, array_to_string(entities, ' '), array_to_string(refs, ' '))), '[\p{L}\p{N}]+')), ['the', 'thing', 'onthe', 'shstand'])) AS matched FROM claims WHERE status IN ('active', 'superseded')) WHERE matched > 0 ORDER BY matched DESC, id DESC LIMIT 20""")
def q_search_worker(a: Adapted) -> DataFrame:
    return index.keyword_search(a.claims.where(F.col("status").isin("active", "superseded")), WORDS, LIMIT).select("id", F.col("matched").cast("long").alias("matched"))


_SEEDS = "SELECT id FROM claims_raw WHERE doc_id % 20 = 0"
_NEIGHBORS = f""", seeds AS ({_SEEDS}),
history AS (
  SELECT supersedes AS id FROM claims_raw WHERE supersedes IS NOT NULL AND id IN (SELECT id FROM seeds)
  UNION SELECT id FROM claims_raw WHERE supersedes IN (SELECT id FROM seeds)
), marks AS (SELECT id, unnest(list_distinct(list_transform(list_concat(entities, refs), lambda x: lower(x)))) AS tag FROM claims_raw),
tags AS (SELECT tag, min(id) AS first FROM marks WHERE id IN (SELECT id FROM seeds) AND length(tag) > 1 GROUP BY tag ORDER BY first, tag LIMIT 24),
both_ AS (
  SELECT id, 0 AS hop, 0 AS shared FROM history
  UNION ALL SELECT id, 1, count(*) FROM marks JOIN tags USING (tag) GROUP BY id
)
SELECT id, CAST(min(hop) AS INTEGER) AS hop, CAST(max(shared) AS BIGINT) AS shared FROM both_ WHERE id NOT IN (SELECT id FROM seeds) GROUP BY id ORDER BY hop, shared DESC, id DESC LIMIT 50
"""


@query(_NEIGHBORS)
def q_neighbors(a: Adapted) -> DataFrame:
    """Seeds: every row whose number is divisible by 20."""
    return index.neighbors(a.raw, a.raw.where("doc_id % 20 = 0").select("id"), 50)


@query()
def q_task_relevance(a: Adapted) -> DataFrame:
    seen = pool(a.kept, BRANCHES.pool_table(a.spark, ["en/code"]))
    return index.task_relevance(a.index, views.visible(a.kept), seen, WORDS, stemmed=False)


_WORDS_SQL = "list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', text, why)), '[\\p{L}\\p{N}]+'), lambda w: length(w) >= 3 AND NOT list_contains(" + repr(text.SIMILARITY_STOPWORDS) + ", w)))"


@query(f""", sets AS (SELECT id, text, why, {_WORDS_SQL} AS words FROM claims),
members AS (SELECT id, words, min(id) OVER (PARTITION BY text, why) AS node FROM sets WHERE len(words) > 0),
each AS (SELECT id, unnest(words) AS w, len(words) AS size FROM members WHERE id = node),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n, any_value(a.size) AS sa, any_value(b.size) AS sb FROM each a JOIN each b ON a.w = b.w AND a.id < b.id AND least(a.size, b.size) >= 0.8 * greatest(a.size, b.size) GROUP BY a.id, b.id)
SELECT a, b, round(n / (sa + sb - n)::DOUBLE, 9) AS similarity FROM shared WHERE n / (sa + sb - n)::DOUBLE >= 0.8 - 1e-12
UNION ALL SELECT node, id, 1.0::DOUBLE FROM members WHERE id <> node""")
def q_refine_pairs(a: Adapted) -> DataFrame:
    """Each two different texts that are alike, by the first claims that have them, and each copy with the first."""
    return listing.similar_pairs(a.raw, 0.8, by_text=True).select("a", "b", F.round("similarity", 9).alias("similarity"))


# --- writes --------------------------------------------------------------------

def _now() -> Column:
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


@query("""SELECT c.id AS origin, 'de/code' AS branch, c.kind, list_sort(list_concat(refs, ['merged:' || c.id])) AS refs FROM claims c WHERE branch = 'en/code' AND status = 'active'""")
def q_merge_branch(a: Adapted) -> DataFrame:
    return mutations.merge_branch(a.claims, "en/code", "de/code", BRANCHES.holds_table(a.spark)).select("origin", "branch", "kind", "refs")


@query("""SELECT c.id AS origin, 'N' || c.id AS id, 'uk/' || string_split(c.branch, '/')[2] AS branch, CASE WHEN o.id IS NOT NULL THEN 'N' || o.id END AS supersedes
FROM claims c LEFT JOIN claims o ON o.id = c.supersedes AND starts_with(o.branch, 'en/') AND o.status <> 'archived' WHERE starts_with(c.branch, 'en/') AND c.status <> 'archived'""")
def q_rename_project(a: Adapted) -> DataFrame:
    return mutations.rename_project(a.claims, "en", "uk", F.concat(F.lit("N"), "id")).select("origin", "id", "branch", "supersedes")


@query("""SELECT claim, 'archived' AS to_status, reason FROM (SELECT id AS claim, 'branch ' || branch || ' removed' AS reason FROM claims WHERE starts_with(branch, 'fr/') AND status <> 'archived' UNION ALL SELECT id, 'branch ' || branch || ' removed' FROM docs WHERE starts_with(branch, 'fr/'))""")
def q_remove_project(a: Adapted) -> DataFrame:
    return mutations.remove_project(a.claims, a.docs, "fr", _now()).select("claim", F.col("to").alias("to_status"), "reason")


@query("""SELECT branch, count(*) FILTER (r = 'claim') AS claims, count(*) FILTER (r = 'doc') AS docs FROM (SELECT branch, 'claim' AS r FROM claims WHERE status <> 'archived' UNION ALL SELECT branch, 'doc' FROM docs) GROUP BY branch""")
def q_removal_counts(a: Adapted) -> DataFrame:
    return mutations.removal_counts(a.claims, a.docs)


@query("""SELECT n.claim, 'm0' AS machine, coalesce(o.helpful, 0) + n.up AS helpful, coalesce(o.harmful, 0) + n.down AS harmful FROM (
  SELECT claim, count(*) FILTER (to_status = 'active') AS up, count(*) FILTER (to_status <> 'active') AS down FROM statuses GROUP BY claim) n
LEFT JOIN (SELECT claim, max(helpful) AS helpful, max(harmful) AS harmful FROM counters WHERE machine = 'm0' GROUP BY claim) o ON o.claim = n.claim""")
def q_rate(a: Adapted) -> DataFrame:
    ratings = a.statuses.select("claim", (F.col("to") == "active").alias("helpful"))
    return mutations.rate(views.counter_state(a.counters), ratings, "m0")


@query("SELECT id AS claim, 'active' AS to_status FROM claims WHERE status = 'proposed'")
def q_review_accept(a: Adapted) -> DataFrame:
    return mutations.review(a.claims, a.raw.select("id"), True, _now()).select("claim", F.col("to").alias("to_status"))


@query("""SELECT kind, branch, outcome, count(*) AS n FROM (
  SELECT kind, branch, CASE WHEN known OR turn > 1 THEN 'duplicate' ELSE 'saved' END AS outcome FROM (
    SELECT i.kind, 'es/research' AS branch, row_number() OVER (PARTITION BY i.cid ORDER BY i.id) AS turn,
           EXISTS (SELECT 1 FROM claims c WHERE c.cid = i.cid AND c.branch = 'es/research' AND c.status <> 'archived') AS known
    FROM claims_raw i)) GROUP BY ALL""")
def q_save_batch(a: Adapted) -> DataFrame:
    inputs = a.raw.select("kind", "cid", F.lit("es/research").alias("branch"), F.col("id").alias("place"), F.lit(None).cast("string").alias("error"))
    return mutations.save(inputs, a.claims, BRANCHES.holds_table(a.spark)).groupBy("kind", "branch", "outcome").agg(F.count("*").alias("n"))


# --- listings, packs, evaluation, streams --------------------------------------


@query(f""", defined AS (SELECT unnest({BRANCHES.all()!r}) AS branch), summary AS (
  SELECT branch, count(*) FILTER (status = 'active') AS active, max(t_tx) AS last FROM claims GROUP BY branch
), d AS (SELECT branch, count(*) AS docs FROM (SELECT DISTINCT branch, name FROM docs) GROUP BY branch),
all_ AS (SELECT branch FROM defined UNION SELECT branch FROM summary UNION SELECT branch FROM d)
SELECT string_split(x.branch, '/')[1] AS project, count(*) AS branches, CAST(sum(coalesce(active, 0)) AS BIGINT) AS claims, CAST(sum(coalesce(docs, 0)) AS BIGINT) AS docs, max(last) AS last,
  bool_and(NOT (coalesce(active, 0) > 0 OR coalesce(docs, 0) > 0)) AS gone
FROM all_ x LEFT JOIN summary s ON s.branch = x.branch LEFT JOIN d ON d.branch = x.branch GROUP BY 1""")
def q_list_ideas(a: Adapted) -> DataFrame:
    docs = views.current_docs(a.docs_all, a.doc_statuses)
    return listing.ideas(views.branch_summary(a.claims), docs, listing.defined_table(a.spark, BRANCHES))


@query("""SELECT branch, id, lag(id) OVER (PARTITION BY branch ORDER BY id) AS previous FROM (SELECT branch, id, row_number() OVER (PARTITION BY branch ORDER BY id DESC) AS r FROM claims WHERE status <> 'archived') WHERE r <= 8""")
def q_map_stations(a: Adapted) -> DataFrame:
    return listing.stations(views.visible(a.claims)).select("branch", "id", "previous")


@query()
def q_map_text(a: Adapted) -> DataFrame:
    shown = listing.stations(views.visible(a.claims))
    return listing.map_text(shown, listing.station_links(shown, a.claims))


@query(f""", defined AS (SELECT unnest({BRANCHES.all()!r}) AS branch), summary AS (
  SELECT branch, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'proposed') AS proposed, max(t_tx) AS last FROM claims GROUP BY branch)
SELECT coalesce(s.branch, d.branch) AS branch, coalesce(active, 0) AS active, coalesce(proposed, 0) AS proposed, last FROM summary s FULL JOIN defined d ON s.branch = d.branch""")
def q_index_overview(a: Adapted) -> DataFrame:
    return listing.overview(views.branch_summary(a.claims), listing.defined_table(a.spark, BRANCHES)).drop("note")


def _packs(a: Adapted, name: str, **more) -> DataFrame:
    return packer.packs(a.claims, BRANCHES.pool_table(a.spark), name, addressed=False, **more)


@query()
def q_pack_agents(a: Adapted) -> DataFrame:
    return _packs(a, "agents-md", budget=2000)


@query()
def q_pack_dossier(a: Adapted) -> DataFrame:
    return _packs(a, "dossier")


@query()
def q_pack_prose(a: Adapted) -> DataFrame:
    return _packs(a, "prose", budget=20_000)


@query()
def q_pack_task(a: Adapted) -> DataFrame:
    seen = pool(a.kept, BRANCHES.pool_table(a.spark, ["en/code"]))
    ranks = index.task_relevance(a.index, views.visible(a.kept), seen, WORDS, stemmed=False)
    return packer.packs(a.kept, BRANCHES.pool_table(a.spark, ["en/code"]), "markdown", relevance=ranks, addressed=False)


@query()
def q_eval_recall(a: Adapted) -> DataFrame:
    """Every line of every text that is labelled good is asked for."""
    good = a.table("labels").where("quality = 1").select("doc_id").distinct()
    wanted = a.raw.select("doc_id", "branch", F.expr("filter(split(text, '\\n'), x -> trim(x) <> '')").alias("expect")).join(good, "doc_id").select("branch", "expect")
    out = packer.packs_of_budgets(a.claims, BRANCHES.pool_table(a.spark), "markdown", [1000, 4000], addressed=False)
    return packer.score_eval(out, wanted)


#: Claims that the root to be verified is behind by, where the pool has twice as many.
BEHIND = 50


@query()
def q_verify_prefix(a: Adapted) -> DataFrame:
    seen = pool(a.claims, BRANCHES.pool_table(a.spark, ["es/research"])).where("status = 'active'")
    part = canonical.with_address(seen).select("for_branch", "id", "cid").persist()
    newest = part.orderBy(F.desc("id"), F.desc("cid")).select("id").limit(min(BEHIND, part.count() // 2))
    root = canonical.merkle_roots(part.join(F.broadcast(newest), "id", "left_anti"), ["for_branch"]).first()
    return listing.verify(part, root["root"][:11] if root else canonical.merkle_root([]))


@query()
def q_stream_catch_up(a: Adapted) -> DataFrame:
    from ..streaming.demo import catch_up_twice, shared_home

    return catch_up_twice(a, shared_home(a.spark))


@query("SELECT id, kind, branch, base_status, status, helpful, harmful FROM claims")
def q_kept_view(a: Adapted) -> DataFrame:
    """All records go to a log in two parts; the kept view takes each part alone and equals a view of everything."""
    from ..streaming.demo import keep_twice

    return keep_twice(a, fresh_folder(a.spark, "home")).claims().select("id", "kind", "branch", "base_status", "status", "helpful", "harmful")
