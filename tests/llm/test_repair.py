"""Conversation repair against the textbook recursion, over odd tables and any number of segments."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import connect, table
from quillstone.llm import queries, repair, sql

ROWS = "conv_id long, turn long, role string, text string, edit string, place string, fault int, part string, `same` string"


def cheapest(rows, faults):
    """(cost, audit, repaired lines) by a table of the least of every state, row by row; insertions are tried before each row and at the end."""
    due = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                role = due[state]
                new = (cost + 5, audit + "I", [*lines, f"{role}:"])
                if role[0] not in best or new[:2] < best[role[0]][:2]:
                    best[role[0]] = new
        return best

    best = {"": (0, "", [])}
    for (role, text), fault in zip(rows, faults, strict=True):
        best, before = {}, inserted(best)
        for state, (cost, audit, lines) in before.items():
            ways = [(state, (cost + 2, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                x = 5 * (fault == "truncated")
                ways.append((due[state][0], (cost + 1 + x, audit + "R", [*lines, f"{due[state]}:{text}"])))
                if role[:1] == due[state][0] or role[:1] == "s" and state == "":
                    ways.append((role[0], (cost + x, audit + "K", [*lines, f"{role}:{text}"])))
            for to, way in ways:
                if to not in best or way[:2] < best[to][:2]:
                    best[to] = way
    best = inserted(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "fine")
        seen.add((role, text))
    return out


def report(turns):
    """The row of one conversation of (turn, role, text)."""
    space = lambda x: " " if x is None else x
    turns = [(t, space(r), space(x)) for t, r, x in turns]
    turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).digest()))
    rows = [r[1:] for r in turns]
    faults = faults_of(rows)
    cost, audit, lines = cheapest(rows, faults)
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (len(rows), gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, n=60):
    rng, out = random.Random(seed), {}
    for conv in [None, *range(n)]:
        turns = []
        for k in range(rng.choice((1, 2, 3, 5, 8, 40))):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None))
            text = rng.choice(("Fine.", "Is it?", "cut off", "", " \n\t", None, f"Text {rng.randrange(5)}.  ", f"say {k}!", "ends in a break.\n\x0b", "émoji 🚀."))
            turns.append((rng.choice((k, k, k, None, k + 3)), role, text))
        out[conv] = turns + turns[:1] * rng.randrange(2)
    out[n] = [(k, rng.choice(("user", "assistant")), rng.choice(("Yes.", f"No {k}.", "cut"))) for k in range(3000)]
    out[n + 1] = [(0, "user", "again and again.")] * 500
    return out


@pytest.fixture(scope="module")
def talks(spark):
    made = conversations(5)
    rows = [(c, t, r, x, "e", "p", 1, "x", "y") for c, turns in made.items() for t, r, x in turns]
    random.Random(3).shuffle(rows)
    return made, spark.createDataFrame(rows, ROWS).repartition(5)


@pytest.mark.parametrize("size", [512, 7])
def test_repair_against_the_textbook(spark, talks, monkeypatch, size):
    made, df = talks
    monkeypatch.setattr(repair, "SEGMENT", size)
    got = {r[0]: tuple(r[1:]) for r in repair.repair_report(df).collect()}
    assert got == {c: report(turns) for c, turns in made.items()}


def test_repaired_turns_have_the_pattern_and_the_digest(spark, talks):
    _, df = talks
    report = {r["conv_id"]: r for r in repair.repair_report(df).collect()}
    turns = {}
    for r in repair.repair(df).collect():
        turns.setdefault(r["conv_id"], []).append(r)
    for conv, r in report.items():
        mine = sorted(turns.get(conv, []), key=lambda t: t["place"])
        assert [t["place"] for t in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in mine))
        assert "".join(t["edit"] for t in mine) == r["audit"].replace("D", "")
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in mine).encode()).hexdigest() == r["repaired_sha256"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suat"), st.sampled_from(["fine", "fine", "blank", "duplicate", "truncated"])), max_size=24), st.integers(1, 9))
def test_segments_joined_give_the_whole_search(rows, size):
    initials, faults = [a for a, _ in rows], [b for _, b in rows]
    codes = [{"fine": 0, "blank": 1, "duplicate": 2, "truncated": 3}[f] for f in faults]
    want = cheapest([({"s": "system", "u": "user", "a": "assistant", "t": "tool"}[i], "") for i in initials], faults)
    made = [repair._segment(1, 0, k, [(1, 0, i, "", c) for i, c in zip(initials[k : k + size], codes[k : k + size], strict=True)], repair.STATES) for k in range(0, len(rows), size)]
    way = repair.choose([m["costs"] for m in made], [m["ranks"] for m in made])
    audit = "".join(m["audits"][4 * a + b] for m, (a, b) in zip(made, way, strict=True)) + repair.CLOSING[way[-1][1] if way else 0]
    cost = sum(m["costs"][4 * a + b] for m, (a, b) in zip(made, way, strict=True)) + 5 * len(repair.CLOSING[way[-1][1] if way else 0])
    assert (cost, audit) == want[:2]


@given(st.lists(st.sampled_from([0, 1, 2, 3]), max_size=30))
def test_the_heuristic_never_says_too_much(faults):
    rest = repair.heuristic(faults)
    for i in range(len(faults) + 1):
        least = min(c for s in repair.STATES for c, _ in repair.search(["t"] * (len(faults) - i), faults[i:], s).values())
        assert rest[i] <= least


def test_empty_tables_and_conversations_that_vanish(spark, talks, tmp_path):
    _, df = talks
    assert repair.repair_report(df.limit(0)).count() == 0 == repair.repair(df.limit(0)).count()
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    odd = [(gone, 0, "user", "Hello."), (None, None, None, None), (7, None, "user", "Hi."), (7, 4, "assistant", "Yes.")]
    spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_conversation_repair(spark, str(tmp_path))
    rows = {r["conv_id"]: tuple(r)[1:] for r in got.collect()}
    assert set(rows) == {gone, None, 7}
    assert rows[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    db = connect()
    db.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = db.execute(sql.CONVERSATION_REPAIR)
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table([d[0] for d in found.description], found.fetchall())
