"""Listings and reports: ideas, overview, map, refinement pairs, verification, evaluation grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.blake3 import blake3
from ..functions.canonical import ADDRESS_PREFIX, RUN, climb, climb_all, merkle_root, placed_leaves
from ..functions.text import label_of, project, short_tag
from .similar import similar_sets


def ideas(summary: DataFrame, docs: DataFrame, defined: DataFrame) -> DataFrame:
    """Per project: branches, claims, documents, newest time, and whether all of it is gone.

    Full outer over branches with claims, with documents and with a definition (branch, archived).
    """
    d = docs.groupBy("branch").agg(F.count("*").alias("docs"))
    rows = summary.select("branch", "active", "total", "last").join(d, "branch", "full_outer").join(defined, "branch", "full_outer")
    per = rows.groupBy(project("branch").alias("project"))
    live = (F.coalesce("active", F.lit(0)) > 0) | (F.coalesce("docs", F.lit(0)) > 0)
    return per.agg(F.count("*").alias("branches"), F.sum(F.coalesce("active", F.lit(0))).alias("claims"), F.sum(F.coalesce("docs", F.lit(0))).alias("docs"), F.max("last").alias("last"), F.bool_and(~live).alias("gone"))


def project_branches(claims: DataFrame, docs: DataFrame, defined: DataFrame, name: str) -> DataFrame:
    rows = claims.select("branch").union(docs.select("branch")).union(defined.select("branch"))
    return rows.where(project("branch") == name).distinct().orderBy("branch")


def overview(summary: DataFrame, defined: DataFrame) -> DataFrame:
    """(branch, active, proposed, last, note): branches that are defined or hold claims, newest first."""
    rows = summary.join(defined, "branch", "full_outer")
    note = F.when(F.coalesce("archived", F.lit(False)), "archived").when(F.col("total").isNull(), "empty")
    return rows.select("branch", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("active", "proposed")], "last", note.alias("note"))


def stations(claims: DataFrame, most: int = 8) -> DataFrame:
    """The newest claims of each branch, oldest first, each linked to the one before it."""
    newest = Window.partitionBy("branch").orderBy(F.desc("id"))
    rows = claims.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= most)
    return rows.select("branch", "id", label_of("text").alias("label"), F.lag("id").over(Window.partitionBy("branch").orderBy("id")).alias("previous"))


def station_links(shown: DataFrame, claims: DataFrame) -> DataFrame:
    """Supersessions between claims that are both shown."""
    ids = shown.select("id")
    edges = claims.where("supersedes IS NOT NULL").select("id", "supersedes")
    return edges.join(ids, "id", "left_semi").join(ids.withColumnRenamed("id", "supersedes"), "supersedes", "left_semi").select("id", "supersedes")


def map_text(shown: DataFrame, links: DataFrame) -> DataFrame:
    """The map as flow-chart lines, one text a branch and one for the links (branch null)."""
    node = F.concat(F.lit("  n"), "id", F.lit('["'), "label", F.lit('"]'))
    arrow = F.when(F.col("previous").isNotNull(), F.concat(F.lit("\n  n"), "previous", F.lit(" --> n"), "id")).otherwise("")
    per = shown.groupBy("branch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", F.concat(node, arrow).alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    across = links.select(F.lit(None).cast("string").alias("branch"), F.concat(F.lit("  n"), "id", F.lit(" -. replaces .-> n"), "supersedes").alias("t"))
    return per.unionByName(across.groupBy("branch").agg(F.array_join(F.sort_array(F.collect_list("t")), "\n").alias("text")))


def similar_pairs(claims: DataFrame, threshold: float = 0.5, by_text: bool = False) -> DataFrame:
    """(a, b, similarity): the pairs of nodes, and each other claim of a node with that (similarity 1).

    ``by_text``: a class is of equal texts and reasons, not of equal words, so each two different texts that are alike make
    a pair of the smallest ids of their classes, and only copies are told by the class they are in.
    """
    members, pairs = similar_sets(claims, threshold)
    if by_text:
        classes = members.groupBy("node", "copy").agg(F.min("id").alias("first"))
        x, y = classes.select("node", F.col("first").alias("x")), classes.select("node", F.col("first").alias("y"))
        same = x.join(y, "node").where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("similarity"))
        several = lambda texts, node: F.explode(F.coalesce(texts, F.array(node)))
        across = pairs.withColumn("x", several("xs", "a")).withColumn("y", several("ys", "b"))
        pairs = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity").unionByName(same)
        members = members.join(classes, ["node", "copy"]).select("id", F.col("first").alias("node"))
    pairs = pairs.select("a", "b", "similarity")
    return pairs.unionByName(members.where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))


def refine(claims: DataFrame, threshold: float = 0.5, most: int = 30) -> DataFrame:
    """The ``most`` most similar pairs of claims, as a report: of equals the smaller ids first.

    Only the first ``most`` pairs of nodes, by the least of their members, and the first members of a node can be among them.
    """
    members, pairs = similar_sets(claims, threshold)
    first = members.drop("copy").withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= most + 1).drop("r")
    first = first.persist()  # read five times
    x, y = first.toDF("a", "node"), first.toDF("b", "node")
    same = x.join(y, "node").where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    best = pairs.orderBy(F.desc("similarity"), "a", "b").limit(most).select(F.col("a").alias("na"), F.col("b").alias("nb"), "similarity")
    across = best.join(first.toDF("x", "na"), "na").join(first.toDF("y", "nb"), "nb").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    return same.unionByName(across).orderBy(F.desc("similarity"), "a", "b").limit(most)


def verify(pool: DataFrame, root: str, back: int = 500) -> DataFrame:
    """(behind, root): how many of the newest claims must be left out for the pool to have ``root``; none if it never had.

    0 is in sync, more is behind by so many, and no row is ahead or diverged (``verdict`` says it in words). ``root`` may be
    the beginning of a root, in either case and with white space around it; an empty one is an error. An empty pool
    has the root of no claim; claims without an address are left out, and repeated rows count once in a tree.

    Looks at most ``back`` records back, which is the feature, in growing steps: at the whole pool, then at 1 to 8 claims fewer,
    at 9 to 64, and so on, and no further than the first that has the root. Without its newest claims the pool's tree keeps
    the order of its leaves, so run j of each state of a step lies within RUN leaves and as many as the step leaves out from
    place j * RUN of the whole: a task takes those, whatever the size of the pool, and gives the run's subtree in
    all states of the step, which share their nodes.
    """
    root = root.strip().lower()
    if not root.removeprefix(ADDRESS_PREFIX):
        raise ValueError("no root to verify")
    spark = pool.sparkSession
    pool = pool.select("id", "cid").where("cid IS NOT NULL").persist()  # read three times
    newest = pool.orderBy(F.desc("id"), F.desc("cid")).limit(back + 1).collect()
    whole, newest = len(newest) <= back, newest[:back]  # whether all of it can be left out
    # an address goes with the oldest of its claims: in state k if that is among the k newest
    last = {r["cid"]: k + 1 for k, r in enumerate(newest)}
    gone = spark.createDataFrame([(c, k, sum(r["cid"] == c for r in newest)) for c, k in last.items()], "cid string, gone int, _new long")
    counts = pool.groupBy("cid").agg(F.count("*").alias("_all"))
    leaves = counts.join(F.broadcast(gone), "cid", "left").select(F.lit(0).alias("_g"), "cid", F.when(F.col("_all") == F.col("_new"), F.col("gone")).alias("gone"))
    placed = placed_leaves(leaves, ["_g"]).select("_p", "cid", "gone").persist()  # read once a step
    removed = np.array(sorted(map(tuple, placed.where("gone IS NOT NULL").select("_p", "gone").collect())), np.int64).reshape(-1, 2)

    @F.pandas_udf("string")
    def top(node: pd.Series) -> str:
        return ADDRESS_PREFIX + climb([bytes.fromhex(x[8:]) for x in sorted(node)]).hex()

    found = []
    for first, most in steps(len(newest)):
        runs = F.expr(f"explode(sequence(greatest(0, (_p - {most}) div {RUN}), _p div {RUN}))")
        nodes = placed.select("_p", "cid", "gone", runs.alias("run")).groupBy("run").applyInPandas(_run_nodes(removed, range(first, most + 1), RUN), "behind long, run long, node string")
        roots = nodes.groupBy("behind").agg(top(F.concat(F.lpad(F.hex("run"), 8, "0"), "node")).alias("root"))
        found = roots.where(F.col("root").startswith(root)).orderBy("behind").limit(1).collect()
        if found:
            break
    if not found and newest and whole and merkle_root([]).startswith(root):
        found = [(len(newest), merkle_root([]))]
    placed.unpersist()
    pool.unpersist()
    return spark.createDataFrame(found, "behind long, root string")


def steps(most: int) -> list[tuple[int, int]]:
    """Numbers 0 to ``most`` in steps (first, last): 0 alone, up to 8, up to 64, ..."""
    found, last = [(0, 0)], 0
    while last < most:
        found.append((last + 1, min(most, max(8, 8 * last))))
        last = found[-1][1]
    return found


def verdict(found: DataFrame) -> str:
    """What ``verify`` found: in sync, behind n, or ahead or diverged."""
    row = found.first()
    return "ahead or diverged" if row is None else "in sync" if row["behind"] == 0 else f"behind {row['behind']}"


def unseen(claims: DataFrame, pack: str, branch: str) -> DataFrame:
    """The live claims of a branch that a pack's text doesn't name: its short tag isn't in it. Oldest first.

    A null address is never named; an empty pack names nothing; repeated rows stay repeated.
    """
    tag = F.concat(F.lit("[c:"), short_tag("cid"), F.lit("]"))
    live = claims.where((F.col("branch") == branch) & F.col("status").isin("active", "superseded"))
    return live.where(~F.coalesce(F.contains(F.lit(pack), tag), F.lit(False))).orderBy("id")


def _run_nodes(removed: np.ndarray, states: range, size: int):
    """The subtree of a run in each of ``states``: removed are the (place, state it is gone in) of leaves that go."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        j = int(key[0])
        group = group.sort_values("_p")
        leaf = [bytes.fromhex(x) for x in blake3([b"\0" + c.encode() for c in group["cid"]])]
        gone = group["gone"].fillna(states.stop).to_numpy(np.int64)
        before = removed[removed[:, 0] < j * size, 1]
        picks, at = {}, []
        for k in states:
            skip, left = int((before <= k).sum()), np.flatnonzero(gone > k)
            state = (skip, len(left))  # leaves only go, so the number tells which are left
            if len(left) > skip:
                picks.setdefault(state, left[skip : skip + size])
                at.append((k, state))
        rows = np.full((len(picks), max(map(len, picks.values()), default=1)), -1)
        for row, pick in zip(rows, picks.values(), strict=True):
            row[: len(pick)] = pick
        node = dict(zip(picks, (x.hex() for x in climb_all(leaf, rows)), strict=True))
        return pd.DataFrame([(k, j, node[state]) for k, state in at], columns=["behind", "run", "node"])

    return run


def defined_table(spark: SparkSession, branches) -> DataFrame:
    rows = [(b, bool((branches.get(b) or {}).get("archived"))) for b in branches.all()]
    return spark.createDataFrame(rows, "branch string, archived boolean")


