"""Canonical form and content address of claims and documents, and Merkle roots over addresses."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blake3 import blake3

# The code points with the White_Space property that the form strips.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
ADDRESS_PREFIX = "b3:"
_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE_SPACE if c != "\n") + "]"


def normalize_text(text: str) -> str:
    """NFC, line feeds alone, nothing white at the end of a line, no line feed at the end."""
    lines = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return "\n".join(line.rstrip(WHITE_SPACE) for line in lines).rstrip("\n")


def normalize_token(text: str) -> str:
    """As a text, and nothing white at its begin either."""
    return normalize_text(text).lstrip(WHITE_SPACE)


def content(kind: str, text: str, why: str | None = None, refs=(), entities=()) -> dict:
    """The normalised fields that are addressed: an empty reason is none, lists are sets in code-point order."""
    unique = lambda items: sorted({x for x in items if x})
    return {
        "kind": kind,
        "text": normalize_text(text),
        "why": (normalize_text(why) if why is not None else "") or None,
        "refs": unique(normalize_token(r) for r in refs or ()),
        "entities": unique(normalize_token(e.lower()) for e in entities or ()),
    }


def canonical_line(fields: dict) -> bytes:
    """The canonical JSON of normalised content, and a line feed."""
    return (json.dumps(fields, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n").encode()


def address(data: list[bytes]) -> list[str]:
    return [ADDRESS_PREFIX + x for x in blake3(data)]


#: Bytes that are hashed at once; a longer string is by itself.
TOGETHER = 4 << 20
#: Rows of a batch that are Python's objects at once.
OBJECTS = 256


def addresses(data: Iterable[bytes]) -> Iterator[str]:
    """The address of each string, of which only those that are hashed at once are held."""
    held, size = [], 0
    for one in data:
        held.append(one)
        size += len(one) + 1024  # what the hash pads a string with, at most
        if size >= TOGETHER:
            yield from address(held)
            held, size = [], 0
    yield from address(held)


def _rows(*columns: pa.Array) -> Iterator[tuple]:
    for at in range(0, len(columns[0]), OBJECTS):
        yield from zip(*(c.slice(at, OBJECTS).to_pylist() for c in columns), strict=True)


def claim_address(kind: str, text: str, why: str | None = None, refs=(), entities=()) -> str:
    return address([canonical_line(content(kind, text, why, refs, entities))])[0]


def document_address(body: str) -> str:
    return address([(normalize_text(body) + "\n").encode()])[0]


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalized(text: Column | str, composed: bool = False) -> Column:
    """``normalize_text`` as a column; ``composed`` leaves out the NFC step, the only one in Python."""
    text = F.col(text) if isinstance(text, str) else text
    text = text if composed else F.when(text.rlike(r"[^\x{0}-\x{2ff}]"), nfc(text)).otherwise(text)
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.rtrim(F.regexp_replace(text, f"{_CLASS}+(?=\n|$(?!\n))", ""), F.lit("\n"))


def with_address(claims: DataFrame, column: str = "cid") -> DataFrame:
    """``claims`` with their content address; null lists are empty."""

    @F.arrow_udf(T.StringType())
    def compute(kind: pa.Array, text: pa.Array, why: pa.Array, refs: pa.Array, entities: pa.Array) -> pa.Array:
        lines = (canonical_line(content(k, t or "", w, r or (), e or ())) for k, t, w, r, e in _rows(kind, text, why, refs, entities))
        return pa.array(list(addresses(lines)), pa.string())

    return claims.withColumn(column, compute("kind", "text", "why", "refs", "entities"))


@F.arrow_udf(T.StringType())
def document_addresses(body: pa.Array) -> pa.Array:
    return pa.array(list(addresses((normalize_text(b or "") + "\n").encode() for (b,) in _rows(body))), pa.string())


def merkle_levels(addresses) -> list[list[bytes]]:
    """Levels of the tree over the sorted distinct addresses, leaves first; an odd last node moves up."""
    level = [bytes.fromhex(x) for x in blake3([b"\0" + a.encode() for a in sorted(set(addresses))])]
    levels = [level]
    while len(level) > 1:
        pairs = [b"\1" + level[k] + level[k + 1] for k in range(0, len(level) - 1, 2)]
        odd = level[-1:] if len(level) % 2 else []
        level = [bytes.fromhex(x) for x in blake3(pairs)] + odd
        levels.append(level)
    return levels


def merkle_root(addresses) -> str:
    """The root; that of no address is the hash of nothing."""
    top = merkle_levels(addresses)[-1]
    return ADDRESS_PREFIX + (top[0].hex() if top else blake3([b""])[0])


def climb(level: list[bytes]) -> bytes:
    """The node above all of ``level``, which has one node at least; an odd last node moves up."""
    while len(level) > 1:
        odd = level[-1:] if len(level) % 2 else []
        level = [bytes.fromhex(x) for x in blake3([b"\1" + level[k] + level[k + 1] for k in range(0, len(level) - 1, 2)])] + odd
    return level[0]


def climb_all(leaves: list[bytes], picks: np.ndarray) -> list[bytes]:
    """The node above the leaves of each row of ``picks``: places in ``leaves``, one at least, and -1 behind the last.

    Trees over much the same leaves have many nodes in common: each is hashed once.
    """
    if not len(picks):
        return []
    nodes, at = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, 32), picks.astype(np.int64)
    while at.shape[1] > 1:
        if at.shape[1] % 2:
            at = np.concatenate([at, np.full((len(at), 1), -1)], axis=1)
        base = len(nodes) + 1
        pair = np.where(at[:, ::2] < 0, -1, at[:, ::2] * base + at[:, 1::2] + 1)
        distinct, at = np.unique(pair, return_inverse=True)
        at = at.reshape(pair.shape)
        if distinct[0] < 0:
            distinct, at = distinct[1:], at - 1
        left, right = distinct // base, distinct % base - 1
        above, both = nodes[left], right >= 0  # an odd last node moves up
        hashed = blake3([b"\1" + nodes[a].tobytes() + nodes[b].tobytes() for a, b in zip(left[both], right[both], strict=True)])
        if hashed:
            above[both] = np.frombuffer(bytes.fromhex("".join(hashed)), np.uint8).reshape(-1, 32)
        nodes = above
    return [nodes[i].tobytes() for i in at[:, 0]]


#: Leaves of one subtree of a distributed tree.
RUN = 1 << 12


def placed_leaves(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Distinct (by, cid, ...) with the place ``_p`` of each address in its group; no group is sorted in one task."""
    from pyspark.sql import Window

    # by ranges of the address first, then within the range
    ranged = distinct.withColumn("_range", F.substring("cid", len(ADDRESS_PREFIX) + 1, 3))
    counts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("cid")) - 1
    return ranged.withColumn("_place", place).join(offsets, [*by, "_range"]).withColumn("_p", F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def merkle_roots(claims: DataFrame, by: list[str]) -> DataFrame:
    """(by, root, n) over the distinct addresses of each group, in a tree of bounded tasks.

    The leaves of a group are cut, in order, into runs of 2**12; each run is a perfect subtree, so the runs'
    roots are the leaves of the rest of the tree, and a group of any size never meets in one task whole.
    """
    placed = placed_leaves(claims.select(*by, "cid").where("cid IS NOT NULL").distinct(), by).withColumn("_run", F.expr(f"_p div {RUN}"))

    @F.pandas_udf(T.StringType())
    def subtree(cids: pd.Series) -> str:
        return merkle_levels(cids)[-1][0].hex()

    @F.pandas_udf(T.StringType())
    def top(nodes: pd.Series) -> str:
        return ADDRESS_PREFIX + climb([bytes.fromhex(x[8:]) for x in sorted(nodes)]).hex()

    runs = placed.groupBy(*by, "_run").agg(subtree("cid").alias("_node"))
    numbers = placed.groupBy(*by, "_run").agg(F.count("*").alias("_n"))
    joined = runs.join(numbers, [*by, "_run"]).withColumn("_key", F.concat(F.lpad(F.hex("_run"), 8, "0"), "_node"))
    roots = joined.groupBy(*by).agg(top("_key").alias("root"))
    return roots.join(joined.groupBy(*by).agg(F.sum("_n").alias("n")), by)
