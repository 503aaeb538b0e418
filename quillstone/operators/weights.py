"""The weight of a claim, and what its rendered line costs, as column expressions."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lane, short_tag, visible_refs
from ..model import Weights, lookup


def weight(now: Column, w: Weights | None = None) -> Column:
    """kind x confidence x status x recency x usefulness; ``now`` is the newest time of the pool."""
    w = w or Weights()
    seconds = F.greatest(F.unix_timestamp(now) - F.unix_timestamp("t_valid"), F.lit(0))
    decayed = F.exp(F.lit(-log(2) / w.half_life_days) * (seconds / F.lit(86400.0))) if w.half_life_days > 0 else F.lit(1.0)
    recency = F.when(F.col("kind") == "constraint", 1.0).otherwise(decayed)
    helpful, harmful = F.coalesce("helpful", F.lit(0)), F.coalesce("harmful", F.lit(0))
    useful = (1.0 + helpful) / (1.0 + helpful + 2.0 * harmful)
    return lookup(w.kind, "kind", 0.5) * lookup(w.confidence, "confidence", 0.8) * lookup(w.status, "status", 0.0) * recency * useful


def weighted(pool: DataFrame, by: list[str] | None = None, w: Weights | None = None) -> DataFrame:
    """``pool`` with ``weight``; the clock is the newest record of the pool, or of each group ``by``."""
    if by:
        clock = pool.groupBy(*by).agg(F.max("t_tx").alias("_now"))
        rows = pool.join(F.broadcast(clock), by)  # a row a branch
    else:
        rows = pool.crossJoin(F.broadcast(pool.agg(F.max("t_tx").alias("_now"))))  # one row
    return rows.withColumn("weight", weight(F.col("_now"), w)).drop("_now")


def bullet(branch: Column | str, with_why: bool) -> Column:
    """The rendered line of a claim for readers of ``branch``."""
    branch = F.col(branch) if isinstance(branch, str) else branch
    refs = visible_refs("refs")
    parts = [
        F.lit("- "),
        F.when(F.col("status") == "superseded", "Previously: ").otherwise(""),
        F.replace("text", F.lit("\n"), F.lit("\n  ")),
        F.when(F.size(refs) > 0, F.concat(F.lit(" ("), F.array_join(F.transform(refs, lambda r: F.concat(F.lit("`"), r, F.lit("`"))), ", "), F.lit(")"))).otherwise(""),
        F.when(F.col("branch") != branch, F.concat(F.lit(" _("), lane("branch"), F.lit(")_"))).otherwise(""),
        F.concat(F.lit(" [c:"), short_tag("cid"), F.lit("]\n")),
    ]
    if with_why:
        parts.append(F.when(F.col("why").isNotNull(), F.concat(F.lit("  - why: "), F.replace("why", F.lit("\n"), F.lit(" ")), F.lit("\n"))).otherwise(""))
    return F.concat(*parts)


def bullet_cost(branch: Column | str) -> tuple[Column, Column]:
    """(tokens of the line, further tokens with its reason)."""
    tokens = lambda text: F.ceil(F.length(text) / F.lit(4.0)).cast("long")
    base = tokens(bullet(branch, False))
    return base, tokens(bullet(branch, True)) - base


# Sections of each projection: kind -> (order, title); superseded claims have one of their own.
SECTIONS = {
    "agents-md": {"constraint": (0, "Constraints"), "decision": (1, "Decisions"), "rejected": (2, "Rejected: do not propose these again"), "fact": (3, "Facts"), "question": (4, "Open questions"), "claim": (5, "Claims"), "superseded": (6, "Changed over time")},
    "dossier": {"decision": (0, "Thesis"), "claim": (0, "Thesis"), "fact": (1, "Evidence"), "constraint": (2, "Constraints"), "rejected": (3, "Contradictions and rejected paths"), "question": (4, "Open questions"), "superseded": (3, "Contradictions and rejected paths")},
    "prose": {"decision": (0, "Where things stand"), "fact": (0, "Where things stand"), "claim": (0, "Where things stand"), "rejected": (1, "What we tried and rejected"), "constraint": (2, "Constraints you must respect"), "question": (3, "Open questions"), "superseded": (4, "What changed along the way")},
}
SECTIONS["markdown"] = SECTIONS["agents-md"]


def section(name: str) -> tuple[Column, Column]:
    """(order, title) of a claim's section in a projection."""
    key = F.when(F.col("status") == "superseded", "superseded").otherwise(F.col("kind"))
    table = SECTIONS[name]
    return lookup({k: v[0] for k, v in table.items()}, key), lookup({k: v[1] for k, v in table.items()}, key)
