"""Materialised views of the log: merges that don't depend on the order of records.

Inputs are record tables: claims (with their own ``status``), statuses (id, claim, to, reason, src, t_tx),
counters (id, claim, machine, helpful, harmful), docs (id, branch, name, title, body, cid, src, t_tx). Every
merge is a maximum, a sum or a newest row, so partial aggregates run before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate
from ..model import IMPLIED, rank, status_of


def unique_records(records: DataFrame) -> DataFrame:
    """One row per id: repeated lines of one record are the same."""
    return records.dropDuplicates(["id"])


def implied_statuses(claims: DataFrame) -> DataFrame:
    """The status record that each superseding claim implies for the one it replaces."""
    return claims.where("supersedes IS NOT NULL").select(F.concat(F.lit(IMPLIED), "id").alias("id"), F.col("supersedes").alias("claim"), F.lit("superseded").alias("to"), F.lit(None).cast("string").alias("reason"), "src", "t_tx")


def effective_status(claims: DataFrame, statuses: DataFrame) -> DataFrame:
    """``claims`` with the highest status of their own, of status records and of supersession."""
    moved = statuses.select("claim", "to").unionByName(implied_statuses(claims).select("claim", "to"))
    highest = moved.groupBy(F.col("claim").alias("id")).agg(F.max(rank("to")).alias("_rank"))
    own = F.coalesce(rank("status"), F.lit(1))
    out = claims.join(highest, "id", "left").withColumn("base_status", F.col("status"))
    return out.withColumn("status", status_of(F.greatest(own, F.coalesce("_rank", F.lit(0))))).drop("_rank")


def counter_state(counters: DataFrame) -> DataFrame:
    """The grow-only counter of each (claim, machine): the maximum of each count."""
    return counters.groupBy("claim", "machine").agg(F.max(F.col("helpful").cast("long")).alias("helpful"), F.max(F.col("harmful").cast("long")).alias("harmful"), F.max("id").alias("rec_id"))


def counter_totals(counters: DataFrame) -> DataFrame:
    return counter_state(counters).groupBy("claim").agg(F.sum("helpful").alias("helpful"), F.sum("harmful").alias("harmful"))


def inline_counters(claims: DataFrame) -> DataFrame:
    """The counts that claims carry themselves (maps of machine to count, as JSON) as counter records without id."""
    parts = [claims.select(F.col("id").alias("claim"), F.explode(F.from_json(c, "map<string,bigint>")).alias("machine", "n"), F.lit(c).alias("which")) for c in ("helpful", "harmful")]
    most = [F.max(F.when(F.col("which") == c, F.col("n"))).alias(c) for c in ("helpful", "harmful")]
    return parts[0].unionByName(parts[1]).groupBy("claim", "machine").agg(*most).withColumn("id", F.lit(""))


def hydrate(claims: DataFrame, statuses: DataFrame, counters: DataFrame) -> DataFrame:
    """Claims as readers see them: effective status and counter totals (0 without a record)."""
    totals = counter_totals(counters).withColumnRenamed("claim", "id")
    rows = effective_status(claims.drop("helpful", "harmful"), statuses).join(totals, "id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("helpful", "harmful")})


def status_history(statuses: DataFrame, claim: str | None = None) -> DataFrame:
    """Written status records in order; what supersession implies isn't among them."""
    rows = statuses.where(~F.col("id").startswith(IMPLIED))
    return (rows if claim is None else rows.where(F.col("claim") == claim)).orderBy("id")


def scan(claims: DataFrame, branch: str | None = None, kinds=(), statuses=(), since=None, limit: int | None = None) -> DataFrame:
    """Claims that pass all given filters, oldest first; with a limit the newest of them."""
    rows = claims
    for column, values in (("branch", [branch] if branch else ()), ("kind", kinds), ("status", statuses)):
        if values:
            rows = rows.where(F.col(column).isin(*values))
    if since is not None:
        rows = rows.where(F.col("t_tx") >= F.lit(since).cast("timestamp"))
    if limit is not None:
        rows = rows.orderBy(F.desc("id")).limit(limit)
    return rows.orderBy("id")


def visible(claims: DataFrame, include_archived: bool = False) -> DataFrame:
    return claims if include_archived else claims.where("status <> 'archived'")


def resolve(claims: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    """Claims whose id, or whose address, begins with ``prefix`` (c: and b3: may lead an address)."""
    if not prefix:
        return claims.limit(0)
    tag = prefix.lower()
    for lead in ("c:", "b3:"):
        tag = tag.removeprefix(lead)
    match = F.col("id").startswith(prefix.upper()) | F.col("cid").startswith("b3:" + tag)
    return claims.where(match).orderBy("id").limit(limit)


def find_by_address(claims: DataFrame) -> DataFrame:
    """The oldest claim of each (address, branch)."""
    return claims.groupBy("cid", "branch").agg(F.min("id").alias("id"))


def duplicates(claims: DataFrame) -> DataFrame:
    """How often each content was recorded on a branch, and first where."""
    return claims.groupBy("cid", "branch").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def branch_summary(claims: DataFrame) -> DataFrame:
    return claims.groupBy("branch").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "proposed").alias("proposed"), F.count("*").alias("total"), F.max("t_tx").alias("last"))


def stats(claims: DataFrame) -> DataFrame:
    """Counts by kind, by branch and of all claims in one pass: (kind, branch, n), null where summed over."""
    sets = claims.groupingSets([["kind"], ["branch"], []], "kind", "branch")
    return sets.agg(F.count("*").alias("n"))


def generation(*tables: DataFrame) -> DataFrame:
    """The newest id in any of the tables; implied records don't count."""
    newest = [t.where(~F.col("id").startswith(IMPLIED)).agg(F.max("id").alias("id")) for t in tables]
    out = newest[0]
    for t in newest[1:]:
        out = out.unionByName(t)
    return out.agg(F.max("id").alias("generation"))


def visible_docs(docs: DataFrame, statuses: DataFrame) -> DataFrame:
    """Document versions that aren't archived (an anti join: nulls hide nothing)."""
    return docs.join(statuses.where("to = 'archived'").select(F.col("claim").alias("id")).distinct(), "id", "left_anti")


def current_docs(docs: DataFrame, statuses: DataFrame) -> DataFrame:
    """The newest visible version of each (branch, name)."""
    return newest_docs(visible_docs(docs, statuses))


def newest_docs(rows: DataFrame) -> DataFrame:
    """The newest version of each (branch, name)."""
    others = [c for c in rows.columns if c not in ("branch", "name")]
    newest = rows.groupBy("branch", "name").agg(F.max_by(F.struct(*others), "id").alias("v"))
    return newest.select("branch", "name", *[F.col(f"v.{c}").alias(c) for c in others])


def doc_versions(docs: DataFrame, statuses: DataFrame, branch: str | None = None) -> DataFrame:
    rows = visible_docs(docs, statuses)
    return (rows if branch is None else rows.where(F.col("branch") == branch)).orderBy("id")


def doc_listing(docs: DataFrame, location: Column | str = "documents") -> DataFrame:
    """What a reader needs to choose a document: name, title, tokens, where."""
    where = F.lit(location) if isinstance(location, str) else location
    return docs.select("branch", "name", "title", estimate("body").alias("tokens"), F.concat(where, F.lit("/"), "branch", F.lit("/"), "name").alias("location"))


def new_only(existing: DataFrame, wanted: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows of ``wanted`` whose value is new or has changed: what an output must be written for."""
    old = existing.select(*key, F.col(value).alias("_old"))
    return wanted.join(old, key, "left").where(~F.col(value).eqNullSafe(F.col("_old"))).drop("_old")


def stale(existing: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Outputs that nothing wants any more."""
    return existing.join(wanted.select(*key).distinct(), key, "left_anti")
