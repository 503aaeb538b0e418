"""Line deduplication by a fixed-depth tree of line templates, in DataFrame operations only.

A line's path in the tree is its number of tokens and its leading tokens, tokens with a digit counting
as a variable field. In a leaf that enough documents reach, a token is constant where that token is at
that place in enough lines, and a variable field otherwise; lines that agree in their constants have one
template. Templates that recur across documents, and are constant for the most part, are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import BROADCAST_ROWS, join_groups, materialize, sized_join

FIELD = "<*>"
#: A row of a digest and an array takes as much of a broadcast as so many ids.
WIDE = 4


def _digest(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    line = F.col("line")
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(line)
    count = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    return (
        docs.select("doc", F.posexplode(F.split("text", "\n")).alias("place", "line"))
        .where(F.trim(line) != "")
        .select("doc", "place", masked.alias("masked"))
        # the number has no space, so it and the path can be told apart
        .withColumn("leaf", _digest(F.concat_ws(" ", count.cast("string"), F.substring_index("masked", " ", depth))))
    )


def template_lines(docs: DataFrame, min_docs: int = 10, depth: int = 3, constant: float = 0.5) -> DataFrame:
    """(doc, place) of the lines of (doc, text) whose template recurs in at least ``min_docs`` documents.

    Tokens are compared as they are; leaves, lines, templates and documents by 128-bit digests.
    """
    lines = _lines(docs, depth)
    leaves = materialize(lines.groupBy("leaf", "doc").agg(F.count("*").alias("n")).groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("n").alias("lines")).where(F.col("docs") >= min_docs).select("leaf", "lines"))
    n_leaves, n_lines = leaves.agg(F.count("*"), F.sum("lines")).first()
    if WIDE * n_leaves <= BROADCAST_ROWS:  # rows of 24 bytes
        reached = lines.join(F.broadcast(leaves), "leaf")
    else:  # a leaf may hold most lines
        reached = join_groups(lines, leaves, ["leaf"], "lines", max(1, n_lines or 0)).where("lines IS NOT NULL")
    inside = materialize(reached.select("doc", "place", "leaf", "masked", _digest(F.col("masked")).alias("line")))
    # equal lines once, with their number; only leaves with different lines need the tokens by place
    distinct = materialize(inside.groupBy("line").agg(F.first("leaf").alias("leaf"), F.first("masked").alias("masked"), F.count("*").alias("n")))
    tokens = distinct.select("line", "leaf", "n", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    path = tokens.where(F.col("at") < depth).select("line", "at", "token")
    deep = tokens.where(F.col("at") >= depth)
    places = materialize(deep.groupBy("leaf", "at", "token").agg(F.sum("n").alias("lines"), F.count("*").alias("size")))
    frequent = places.where(F.col("lines") >= min_docs)
    total = max(1, places.agg(F.sum("size")).first()[0] or 0)
    fixed = join_groups(deep.select("line", "leaf", "at", "token"), frequent, ["leaf", "at", "token"], "size", total).select("line", "at", F.when(F.col("size").isNotNull(), F.col("token")).otherwise(FIELD).alias("token"))
    part = F.struct("at", "token")
    whole = path.unionByName(fixed).groupBy("line").agg(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["token"]).alias("parts"))
    share = F.size(F.filter("parts", lambda x: x != FIELD)) / F.size("parts")
    # tokens have no space, so a template's tokens with spaces between are that template's alone
    named = whole.where(share >= constant).select("line", _digest(F.array_join("parts", " ")).alias("template")).join(distinct.select("line", "n"), "line")
    named = materialize(named)
    held = materialize(join_groups(inside.select("doc", "place", "line"), named, ["line"], "n", max(1, inside.count())).where("template IS NOT NULL").select("doc", "place", "template"))
    recurring = materialize(held.select("template", "doc").distinct().groupBy("template").agg(F.count("*").alias("size")).where(F.col("size") >= min_docs))
    return join_groups(held, recurring, ["template"], "size", max(1, held.count())).where("size IS NOT NULL").select("doc", "place")


def drop_template_lines(docs: DataFrame, min_docs: int = 10, depth: int = 3, constant: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_lines, n_removed, kept_text (the lines left, in order).

    Lines end at line feeds and tokens at single spaces. Blank lines stay; lines of any number of tokens are judged,
    those of fewer than ``depth`` by the tokens they have. Documents with the same identifier and text count as one. A null text is empty: one line,
    which is blank. No rows give no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("ident"), _digest(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\0"), text)).alias("doc"), text.alias("text"))
    found = template_lines(source, min_docs, depth, constant)
    marks = materialize(found.distinct().groupBy("doc").agg(F.collect_list("place").alias("places")))
    size = marks.agg(F.count("*") * WIDE + F.sum(F.size("places")) / 2).first()[0] or 0
    out = sized_join(source, marks, ["doc"], "left", min(int(size), BROADCAST_ROWS + 1)).withColumn("lines", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "places")
    kept = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return out.select(F.col("ident").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept_text"))
