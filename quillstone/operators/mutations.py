"""Writes: each returns the records to append; nothing is edited."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import document_addresses, normalized, with_address
from ..functions.text import estimate, is_document_name, lane, project, title_of
from ..model import MERGE_PREFIX, kind_of

#: The digits of ids, in their order.
_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _base32(value: Column, digits: int) -> Column:
    digit = lambda k: F.substring(F.lit(_DIGITS), (F.shiftrightunsigned(value, 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(k) for k in range(digits - 1, -1, -1)])


def time_id(at: Column, place: Column | None = None, operation: int | None = None) -> Column:
    """A 26-character id in base 32 that sorts by time: the milliseconds, 15 bits of the operation, and the row's place.

    The place is Spark's own numbering of rows, so no two rows of one write share an id; who reads such a column twice, in a join
    say, writes it first. ``operation`` is drawn at random, so that two writers of the same millisecond differ.
    """
    operation = secrets.randbits(15) if operation is None else operation
    place = F.monotonically_increasing_id() if place is None else place
    return F.concat(_base32(F.unix_millis(at), 10), F.lit("".join(_DIGITS[operation >> s & 31] for s in (10, 5, 0))), _base32(place, 13))


def drafts(inputs: DataFrame, at: Column) -> DataFrame:
    """Claims of raw inputs (kind, text, why, refs, entities, branch, ...): normalised and addressed; ``error`` says why not."""
    rows = inputs.withColumn("kind", kind_of("kind")).withColumn("text", normalized("text"))
    why = normalized("why")
    rows = rows.withColumn("why", F.when(why != "", why))
    error = F.when(F.col("kind").isNull(), "unknown kind").when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty text")
    rows = with_address(rows.withColumn("error", error).withColumn("tokens", estimate("text")))
    return rows.withColumns({"status": F.lit("active"), "t_tx": at, "t_valid": F.coalesce("t_valid", at) if "t_valid" in rows.columns else at})


def save(inputs: DataFrame, claims: DataFrame, refused: DataFrame, proposed: bool = False) -> DataFrame:
    """``inputs`` (addressed drafts in order of ``place``) with ``outcome``: saved, duplicate or error.

    A duplicate has the address of a claim on the same branch, or of an earlier input. An archived claim
    doesn't count for a save, but does for a proposal. A branch that refuses the kind, or a superseded
    claim that doesn't exist, is an error.
    """
    there = claims if proposed else claims.where("status <> 'archived'")
    known = there.groupBy("cid", "branch").agg(F.min("id").alias("existing"))
    rows = refuse(inputs, refused).join(known, ["cid", "branch"], "left")
    if "supersedes" in inputs.columns and not proposed:
        real = claims.select(F.col("id").alias("supersedes"), F.lit(True).alias("_real")).distinct()
        rows = rows.join(real, "supersedes", "left").withColumn("error", F.coalesce("error", F.when(F.col("supersedes").isNotNull() & F.col("_real").isNull(), "no such claim to supersede"))).drop("_real")
    turn = F.row_number().over(Window.partitionBy("cid", "branch").orderBy("place"))
    good = F.col("error").isNull()
    outcome = F.when(~good, "error").when(F.col("existing").isNotNull() | (turn > 1), "duplicate").otherwise("saved")
    return rows.withColumn("outcome", outcome)


def refuse(inputs: DataFrame, refused: DataFrame) -> DataFrame:
    """``inputs`` with an error for kinds that their branch doesn't hold, naming a branch that does."""
    said = F.concat(F.lit("branch does not hold this kind"), F.coalesce(F.concat(F.lit("; try "), "suggestion"), F.lit("")))
    rows = inputs.join(F.broadcast(refused.withColumn("_no", F.lit(True))), ["branch", "kind"], "left")
    return rows.withColumn("error", F.coalesce("error", F.when(F.col("_no"), said))).drop("_no", "suggestion")


def batch_report(saved: DataFrame) -> DataFrame:
    return saved.groupBy("outcome").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("cid")).alias("cids"))


def transitions(targets: DataFrame, to: str, reason: Column | None, src: str, at: Column) -> DataFrame:
    """A status record for each id in ``targets``."""
    return targets.select(F.lit("status").alias("rec"), time_id(at).alias("id"), F.col("id").alias("claim"), F.lit(to).alias("to"), (F.lit(None).cast("string") if reason is None else reason).alias("reason"), F.lit(src).alias("src"), at.alias("t_tx"))


def review(claims: DataFrame, targets: DataFrame, accept: bool, at: Column) -> DataFrame:
    """Accept or reject proposals among ``targets`` (ids); claims that aren't proposed get nothing."""
    rows = claims.where("status = 'proposed'").join(targets.select("id").distinct(), "id", "left_semi")
    return transitions(rows, "active" if accept else "rejected", F.lit("review"), "review", at)


def rate(state: DataFrame, ratings: DataFrame, machine: str) -> DataFrame:
    """Counter records after ``ratings`` (claim, helpful boolean): this machine's absolute counts so far, plus the new ones."""
    new = ratings.groupBy("claim").agg(F.count_if("helpful").alias("up"), F.count_if(~F.col("helpful")).alias("down"))
    own = state.where(F.col("machine") == machine).select("claim", F.col("helpful").alias("h"), F.col("harmful").alias("x"))
    return new.join(own, "claim", "left").select("claim", F.lit(machine).alias("machine"), (F.coalesce("h", F.lit(0)) + F.col("up")).alias("helpful"), (F.coalesce("x", F.lit(0)) + F.col("down")).alias("harmful"))


def merge_branch(claims: DataFrame, source: str, target: str, refused: DataFrame) -> DataFrame:
    """Copies of the source's active claims for the target, with a reference to each original; what was merged
    before, or the target refuses, is left out, so merging again adds nothing."""
    marker = F.concat(F.lit(MERGE_PREFIX), "id")
    before = claims.where(F.col("branch") == target).select(F.explode("refs").alias("marker")).where(F.col("marker").startswith(MERGE_PREFIX)).distinct()
    kinds = refused.where(F.col("branch") == target).select("kind")
    rows = claims.where((F.col("branch") == source) & (F.col("status") == "active")).withColumn("marker", marker)
    rows = rows.join(before, "marker", "left_anti").join(F.broadcast(kinds), "kind", "left_anti")
    refs = F.array_sort(F.array_distinct(F.concat("refs", F.array("marker"))))
    return rows.withColumns({"refs": refs, "branch": F.lit(target), "src": F.lit("merge"), "origin": F.col("id")}).drop("marker")


def archive_branch(claims: DataFrame, branch: str, at: Column) -> DataFrame:
    rows = claims.where((F.col("branch") == branch) & (F.col("status") != "archived"))
    return transitions(rows, "archived", F.lit(f"branch {branch} archived"), "cli", at)


def removal(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """(branch, id, kind of record) of all that removing a branch would hide: live claims and visible documents."""
    live = claims.where("status <> 'archived'").select("branch", "id", F.lit("claim").alias("record"))
    return live.unionByName(docs.select("branch", "id", F.lit("doc").alias("record")))


def removal_counts(claims: DataFrame, docs: DataFrame) -> DataFrame:
    return removal(claims, docs).groupBy("branch").agg(F.count_if(F.col("record") == "claim").alias("claims"), F.count_if(F.col("record") == "doc").alias("docs"))


def remove_project(claims: DataFrame, docs: DataFrame, name: str, at: Column) -> DataFrame:
    """Status records that archive every live claim and document version of a project."""
    rows = removal(claims, docs).where(project("branch") == name)
    return transitions(rows.drop("record"), "archived", F.concat(F.lit("branch "), "branch", F.lit(" removed")), "cli", at)


def numbered(ids: DataFrame, at: Column, folder: str) -> DataFrame:
    """``ids`` (column id) with a new id each (column fresh), written to ``folder`` so that all who read it see the same."""
    ids.select("id", time_id(at).alias("fresh")).write.mode("overwrite").parquet(folder)
    return ids.sparkSession.read.schema("id string, fresh string").parquet(folder)


def rename_project(claims: DataFrame, old: str, new: str, new_id: Column) -> DataFrame:
    """Copies of a project's live claims under another name: new ids, the same valid time, and the supersession
    chain carried over to the new ids where the replaced claim is copied too. ``origin`` is the old id. ``new_id`` is read
    twice, so it must say the same each time: a function of the row, or a column that was written (``numbered``)."""
    rows = claims.where((project("branch") == old) & (F.col("status") != "archived")).withColumn("fresh", new_id)
    ids = rows.select(F.col("id").alias("supersedes"), F.col("fresh").alias("chained"))
    moved = rows.join(ids, "supersedes", "left")
    return moved.withColumns({"origin": F.col("id"), "id": F.col("fresh"), "supersedes": F.col("chained"), "branch": F.concat(F.lit(f"{new}/"), lane("branch"))}).drop("fresh", "chained")


def save_docs(inputs: DataFrame, current: DataFrame) -> DataFrame:
    """Document versions of (branch, name, title, body): normalised, titled and addressed, with ``outcome``
    saved, unchanged (the current version has the same body) or error."""
    title = normalized("title")
    rows = inputs.withColumns({"name": F.lower(F.trim("name")), "body": normalized("body")})
    rows = rows.withColumn("title", F.when(F.coalesce(F.trim(title), F.lit("")) != "", F.trim(title)).otherwise(title_of("body", "name"))).withColumn("cid", document_addresses("body"))
    error = F.when(~is_document_name("name"), "invalid name").when(F.coalesce(F.trim("body"), F.lit("")) == "", "empty body")
    old = current.select("branch", "name", F.col("cid").alias("_cid"))
    return rows.withColumn("error", error).join(old, ["branch", "name"], "left").withColumn("outcome", F.when(F.col("error").isNotNull(), "error").when(F.col("cid") == F.col("_cid"), "unchanged").otherwise("saved")).drop("_cid")
