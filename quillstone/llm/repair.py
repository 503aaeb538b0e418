"""Repair of a conversation's structure by the cheapest edits, found by A* on the edit lattice.

A node of the lattice is (rows read, state of the pattern ``(s?(ua)+)?``), and an edit is an arc: Keep, Rerole,
Delete, Insert. The heuristic is a suffix sum: what the rows still to be read must cost whatever is done, 2 for a row
that has to go and 2 for a truncated one (to delete it is the least that it can cost). It never exceeds the cost and
falls by no more than an arc costs, so nodes come off the queue, keyed (cost plus heuristic, audit), in the order
of the result: cheapest first, and of equals the audit that is first in ASCII order.

A conversation may hold most rows, so it is read in segments of at most SEGMENT rows. Each is searched for every state
it can be entered and left in, by whatever task has its rows; then the segments' costs are added from the end, and a
walk from the start takes the least audit of each. An insertion belongs to the row after it, so audits of a segment
end with a row's edit, none is the beginning of another, and segment by segment the least is the least of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import join_groups, map_batches, materialize, partitions

#: States of the pattern: nothing read, a system turn read, a user's turn read, an assistant's turn read.
START, OPENED, USER, ASSISTANT = STATES = range(4)
#: Where a turn of the role that is due leads from each state, that role, and the insertions that end the pattern.
NEXT = (USER, USER, ASSISTANT, USER)
DUE = ("user", "user", "assistant", "user")
CLOSING = ("", "II", "I", "")
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
# What each edit costs.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Rows that one search reads at most.
SEGMENT = 512
#: What trailing white space may be.
SPACES = " \t\n\x0b\x0c\r"


def heuristic(faults: list[int]) -> list[int]:
    """For each number of rows read the least that the rest can cost."""
    out = [0]
    for fault in reversed(faults):
        out.append(out[-1] + (DELETE if fault in (BLANK, DUPLICATE) else min(DELETE, CUT_OFF) if fault == TRUNCATED else 0))
    return out[::-1]


def search(initials: list[str], faults: list[int], entry: int) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) from ``entry`` before the first row to every state after the last, least audit of equals."""
    n, rest = len(initials), heuristic(faults)
    queue, settled, exits = [(rest[0], "", 0, entry)], set(), {}
    while queue:
        estimate, audit, i, state = heappop(queue)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        cost = estimate - rest[i]
        if i == n:
            exits[state] = (cost, audit)
            continue

        def go(letter: str, price: int, j: int, to: int, cost: int = cost, audit: str = audit) -> None:
            if (j, to) not in settled:
                heappush(queue, (cost + price + rest[j], audit + letter, j, to))

        go("D", DELETE, i + 1, state)
        go("I", INSERT, i, NEXT[state])
        if faults[i] not in (BLANK, DUPLICATE):
            charge = CUT_OFF if faults[i] == TRUNCATED else 0
            go("R", REROLE + charge, i + 1, NEXT[state])
            if state == START and initials[i] == "s":
                go("K", charge, i + 1, OPENED)
            elif initials[i] == DUE[state][0]:
                go("K", charge, i + 1, NEXT[state])
    return exits


def repair_rows(rows: list[tuple[str, str]], audit: str, state: int) -> tuple[list[tuple[str, str, str]], int]:
    """What ``audit`` makes of (role, text) rows from ``state``: (role, text, edit) turns, and the state after them."""
    out, i = [], 0
    for letter in audit:
        if letter == "I":
            out.append((DUE[state], "", letter))
        elif letter == "R":
            out.append((DUE[state], rows[i][1], letter))
        elif letter == "K":
            out.append((*rows[i], letter))
        if letter != "D":
            state = OPENED if letter == "K" and state == START and rows[i][0][:1] == "s" else NEXT[state]
        i += letter != "I"
    return out, state


def choose(costs: list[list[int]], ranks: list[list[int]]) -> list[tuple[int, int]]:
    """(entry, exit) of each segment on the cheapest way, least audit of equals.

    ``costs`` and ``ranks`` have, at 4 * entry + exit, the cost (below 0: no way) and the place of the audit among those of
    the same entry.
    """
    togo = [[INSERT * len(x) for x in CLOSING]]
    for table in reversed(costs):
        ways = [[table[4 * s + t] + togo[-1][t] if table[4 * s + t] >= 0 else None for t in STATES] for s in STATES]
        togo.append([min((w for w in row if w is not None), default=1 << 60) for row in ways])
    togo.reverse()
    state, out = START, []
    for k, table in enumerate(costs):
        best = [t for t in STATES if table[4 * state + t] >= 0 and table[4 * state + t] + togo[k + 1][t] == togo[k][state]]
        to = min(best, key=lambda t: ranks[k][4 * state + t])
        out.append((state, to))
        state = to
    return out


SEGMENT_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("segment", pa.int32()), ("rows", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64())]
    + [("first_initial", pa.string()), ("last_initial", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64())]
    + [("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("audits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
)
_SEGMENT_DDL = (
    "conv_id long, part int, segment int, rows long, first_turn long, last_turn long, turns long, first_initial string, last_initial string, "
    "blank long, duplicate long, truncated long, illegal long, costs array<long>, ranks array<int>, audits array<string>, roles array<string>, texts array<string>"
)
_LEGAL = ("su", "ua", "au")


def _segment(conv: int | None, part: int, k: int, rows: list[tuple], entries: tuple[int, ...]) -> dict:
    """One segment of (conv_id, turn, role, text, fault) rows, searched from each of ``entries``."""
    faults, initials = [r[4] for r in rows], [r[2][:1] for r in rows]
    costs, ranks, audits = [-1] * 16, [0] * 16, [""] * 16
    for s in entries:
        exits = search(initials, faults, s)
        for rank, t in enumerate(sorted(exits, key=lambda t: exits[t][1])):
            costs[4 * s + t], audits[4 * s + t] = exits[t]
            ranks[4 * s + t] = rank
    turns = [r[1] for r in rows if r[1] is not None]
    return {
        **{"conv_id": conv, "part": part, "segment": k, "rows": len(rows), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns))},
        **{"first_initial": initials[0], "last_initial": initials[-1], "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED)},
        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        **{"costs": costs, "ranks": ranks, "audits": audits, "roles": [r[2] for r in rows], "texts": [r[3] for r in rows]},
    }


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            some = batch.slice(low, 64)
            yield from zip(*(some.column(n).to_pylist() for n in names), strict=True)


def _in_batches(dicts: Iterator[dict], schema: pa.Schema, most: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for d in dicts:
        held.append(d)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _cut(size: int):
    """The segments, of ``size`` rows at most, of a partition's rows, which are in order. Its first conversation may have begun before it."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        k = 0
        for place, (conv, rows) in enumerate(groupby(_rows(batches, ("conv_id", "turn", "role", "text", "fault")), key=lambda r: r[0])):
            held: list[tuple] = []
            begun = place > 0
            for row in rows:
                if len(held) == size:
                    yield _segment(conv, part, k, held, (START,) if begun else STATES)
                    k, held, begun = k + 1, [], False
                held.append(row)
            yield _segment(conv, part, k, held, (START,) if begun else STATES)
            k += 1

    return lambda batches: _in_batches(segments(batches), SEGMENT_SCHEMA, 8)


_LIGHT = ("costs", "ranks")
_HEAVY = ("rows", "first_turn", "last_turn", "turns", "first_initial", "last_initial", "blank", "duplicate", "truncated", "illegal", "costs", "audits", "roles", "texts")
REPORT = pa.schema(
    [("conv_id", pa.int64())] + [(n, pa.int64()) for n in ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)
REPORT_DDL = "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
TURNS_DDL = "conv_id long, place long, role string, text string, edit string"


def _conversations(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[dict]:
    """The report of each conversation, or its repaired turns. Of each, the costs of all segments come before their rows."""
    names = ("conv_id", "heavy", *dict.fromkeys(_LIGHT + _HEAVY))
    for conv, records in groupby((dict(zip(names, r, strict=True)) for r in _rows(batches, names)), key=lambda r: r["conv_id"]):
        costs, ranks, way = [], [], None
        out = {"conv_id": conv, **dict.fromkeys(REPORT.names[1:8], 0)}
        digest, audit, place, last, low, high, distinct = hashlib.sha256(), [], 0, None, None, None, 0
        for r in records:
            if not r["heavy"]:
                costs.append(r["costs"])
                ranks.append(r["ranks"])
                continue
            if way is None:
                ways = choose(costs, ranks)
                way, n_segments, done = iter(ways), len(ways), 0
                costs = ranks = None
            entry, leave = next(way)
            done += 1
            letters = r["audits"][4 * entry + leave] + (CLOSING[leave] if done == n_segments else "")
            audit.append(letters)
            made, _ = repair_rows(list(zip(r["roles"], r["texts"], strict=True)), letters, entry)
            for role, text, edit in made:
                if turns:
                    yield {"conv_id": conv, "place": place, "role": role, "text": text, "edit": edit}
                digest.update(("\n" * (place > 0) + role + ":" + text).encode())
                place += 1
            out["cost"] += r["costs"][4 * entry + leave] + (INSERT * len(CLOSING[leave]) if done == n_segments else 0)
            out["n_rows"] += r["rows"]
            for n in ("blank", "duplicate", "truncated", "illegal"):
                out[n] += r[n]
            if last is not None:  # the border between two segments
                out["illegal"] += last[0] + r["first_initial"] not in _LEGAL
                distinct -= last[1] is not None and last[1] == r["first_turn"]
            last = (r["last_initial"], r["last_turn"] if r["last_turn"] is not None else last and last[1])
            distinct += r["turns"]
            low = r["first_turn"] if low is None else low
            high = r["last_turn"] if r["last_turn"] is not None else high
        if not turns:
            out["gaps"] = 0 if low is None else high - low + 1 - distinct
            yield {**out, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


def _fault(text: str) -> Column:
    """The fault that a text's own characters show."""
    trimmed = F.rtrim(F.col(text), F.lit(SPACES))
    return F.when(trimmed == "", BLANK).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)


def segments(rows: DataFrame) -> DataFrame:
    """A written table of searched segments, by the partition and place they were cut in."""
    spark = rows.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    tie = F.unhex(F.md5(F.concat(role, F.lit(":"), text)))
    same = F.unhex(F.md5(F.concat(F.coalesce(conv.cast("string"), F.lit("")), F.lit(":"), F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    # written once, so that row numbers are the same for all who read them
    all_rows = materialize(rows.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), tie.alias("tie"), same.alias("same"), F.monotonically_increasing_id().alias("row_id")).withColumn("fault", _fault("text")))
    again = all_rows.groupBy("same").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn", "row_id")).alias("first"), F.count("*").alias("copies"))
    again = materialize(again.where("copies > 1").select("same", F.col("first.row_id").alias("first_row"), "copies"))
    marked = join_groups(all_rows, again, ["same"], "copies", max(1, all_rows.count()))
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("first_row").isNotNull() & (F.col("row_id") != F.col("first_row")), DUPLICATE).otherwise(F.col("fault"))
    order = ("conv_id", "turn", "tie", "row_id")
    dealt = marked.select(*order, "role", "text", fault.alias("fault")).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    return materialize(map_batches(dealt, _cut(SEGMENT), _SEGMENT_DDL))


def _stream(rows: DataFrame, turns: bool) -> DataFrame:
    found = segments(rows)
    keys = ("conv_id", "part", "segment")
    kinds = dict(found.dtypes)
    columns = [c for c in dict.fromkeys(_LIGHT + _HEAVY)]
    light = found.select(*keys, F.lit(False).alias("heavy"), *[F.col(c) if c in _LIGHT else F.lit(None).cast(kinds[c]).alias(c) for c in columns])
    heavy = found.select(*keys, F.lit(True).alias("heavy"), *columns)
    dealt = light.unionByName(heavy).repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "heavy", "part", "segment")
    schema, ddl = (TURNS, TURNS_DDL) if turns else (REPORT, REPORT_DDL)
    return map_batches(dealt, lambda batches: _in_batches(_conversations(batches, turns), schema), ddl)


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text) ``rows``: n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are read by turn, a null turn first; those of one turn follow a digest of role and text, so that the order
    is the same however the table is split. Null roles and texts are one space; an empty role has no initial, which fits
    nowhere. Repeated rows are rows: all but the first are duplicates. Rows of a null conv_id are one conversation.
    No rows give no conversations. Texts may have any length, and other columns are not read. An audit and a digest
    are one value a conversation; its rows are held by segments of SEGMENT rows.
    """
    return _stream(rows, False)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired turns of (conv_id, turn, role, text) ``rows``: conv_id, place from 0, role, text, and the edit (K, R or I) that made each.

    Rows are read as in ``repair_report``; a conversation all of whose rows go has no turns.
    """
    return _stream(rows, True)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of ``rows`` with faults put in by crc32 of conv_id and turn; nulls are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    how = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    hurt = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(how == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(how == 1, "").when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(how == 3, F.array(F.lit(1), F.lit(2))).when(how == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return hurt.drop("copy")
