import datetime as dt
import itertools
import json
import os

import pytest
from pyspark.sql import functions as F

from quillstone.functions.canonical import claim_address, document_address
from quillstone.operators import listing, mutations, views
from quillstone.operators.branches import Branches, BranchError, pool, template
from quillstone.sources import blocks, log
from quillstone.streaming.source import catch_up, read_tables

CLAIMS = "id string, cid string, kind string, branch string, text string, why string, refs array<string>, entities array<string>, supersedes string, status string, confidence string, src string, t_valid timestamp, t_tx timestamp"
NOW = dt.datetime(2026, 1, 1)


def claim(id, text="x", kind="fact", branch="p/a", status="active", supersedes=None, refs=(), entities=(), why=None, cid=None):
    return (id, cid or claim_address(kind, text, why, refs, entities), kind, branch, text, why, list(refs), list(entities), supersedes, status, "medium", "t", NOW, NOW)


def test_status_does_not_depend_on_order(spark):
    claims = spark.createDataFrame([claim("1"), claim("2", supersedes="1"), claim("3", status="proposed")], CLAIMS)
    moves = [("s1", "1", "active"), ("s2", "1", "archived"), ("s3", "3", "active"), ("s4", "9", "archived")]
    for order in list(itertools.permutations(moves))[::7]:
        statuses = spark.createDataFrame(order, "id string, claim string, to string").repartition(3)
        got = {r["id"]: r["status"] for r in views.effective_status(claims, statuses).collect()}
        assert got == {"1": "archived", "2": "active", "3": "active"}
    empty = spark.createDataFrame([], "id string, claim string, to string")
    assert {r["id"]: r["status"] for r in views.effective_status(claims, empty).collect()} == {"1": "superseded", "2": "active", "3": "proposed"}


def test_counters_are_maxima_then_sums(spark):
    rows = [("c1", "1", "a", 3, 0), ("c2", "1", "a", 1, 2), ("c3", "1", "b", 2, 0)]
    df = spark.createDataFrame(rows, "id string, claim string, machine string, helpful long, harmful long")
    assert views.counter_totals(df).collect()[0].asDict() == {"claim": "1", "helpful": 5, "harmful": 2}


def test_current_document_and_archived_versions(spark):
    docs = spark.createDataFrame([("1", "b", "n", "one"), ("2", "b", "n", "two"), ("3", "b", "m", "x")], "id string, branch string, name string, body string")
    gone = spark.createDataFrame([("s", "2", "archived"), ("t", None, "archived")], "id string, claim string, to string")
    assert {(r["name"], r["body"]) for r in views.current_docs(docs, gone).collect()} == {("n", "one"), ("m", "x")}


def test_graph_rules():
    g = Branches({"p": {"r": {}, "c": {"parent": "r", "inherits": {"r": ["decision"], "q/x": ["fact"]}}, "d": {"parent": "c", "holds": ["decision", "fact"], "inherits": {"c": ["decision", "fact"]}}}, "q": {"x": {}}}).validate()
    assert g.pool_sources("p/c") == {"p/c": None, "p/r": ["decision"], "q/x": ["fact"]}
    assert g.pool_sources("p/d") == {"p/d": None, "p/c": ["fact", "decision"], "p/r": ["decision"]}
    assert g.pool_sources("default") == {"default": None}
    for bad in ({"p": {"a": {"parent": "b"}, "b": {"parent": "a"}}}, {"p": {"a": {"parent": "a"}}}, {"p": {"a": {"parent": "zz"}}}, {"P": {"a": {}}}, {"p": {"a": {"colour": 1}}}):
        with pytest.raises(BranchError):
            Branches(bad).validate()
    with pytest.raises(BranchError, match="p/r"):
        Branches({"p": {"a": {"holds": ["fact"]}, "r": {"holds": ["question"]}}}).check_holds("p/a", "question")
    assert template("code", "research")["inherits"]["research"] == ["decision", "constraint", "rejected"]


def test_pool_narrows_kinds(spark):
    g = Branches({"p": {"r": {}, "c": {"parent": "r", "inherits": {"r": ["decision"]}}}})
    claims = spark.createDataFrame([claim("1", branch="p/r"), claim("2", branch="p/r", kind="decision"), claim("3", branch="p/c"), claim("4", branch="p/c", status="rejected")], CLAIMS)
    got = {(r["for_branch"], r["id"]) for r in pool(claims, g.pool_table(spark)).collect()}
    assert got == {("p/r", "1"), ("p/r", "2"), ("p/c", "2"), ("p/c", "3")}


def record(id, text="x", **more):
    return {"rec": "claim", "id": id, "kind": "fact", "branch": "p/a", "text": text, "cid": claim_address("fact", text), "t_tx": "2026-01-01T00:00:00Z", **more}


def test_log_round_trip_with_damage(spark, tmp_path):
    home = str(tmp_path)
    at = dt.datetime(2026, 1, 31, 23, 30, tzinfo=dt.timezone.utc)
    log.append(home, "m", record("1", helpful={"m": 1}), at)
    path = log.append(home, "m", {"rec": "doc", "id": "2", "branch": "p/a", "name": "n", "title": "t", "body": "b", "cid": document_address("b"), "src": "s", "t_tx": "2026-01-01T00:00:00Z"}, at)
    assert path.endswith("log/m/2026-01.jsonl")
    with open(path, "a") as f:
        f.write('\n{"rec": "other", "id": "3"}\nnot json\n' + json.dumps(record("4", cid="b3:00")) + '\n{"rec": "cla')
    log.append(home, "m", record("5", "y"), at)  # starts on a line of its own
    got = log.read(spark, home)
    assert sorted(r["id"] for r in got.claims.collect()) == ["1", "5"]
    assert [r["id"] for r in got.docs.collect()] == ["2"]
    assert sorted(r["warning"] for r in got.warnings.collect()) == ["address does not match", "not a record", "not a record", "unknown record type"]
    sizes = {(r["machine"], r["month"]): r["bytes"] for r in log.shards(spark, home).collect()}
    assert sizes == {("m", "2026-01"): os.path.getsize(path)}
    cursors = spark.createDataFrame([("m", "2026-01", sizes["m", "2026-01"] + 1), ("z", "2026-01", 5)], "machine string, month string, bytes long")
    assert {r["machine"] for r in log.shrunk(log.shards(spark, home), cursors).collect()} == {"m", "z"}


def test_stream_equals_batch_and_keeps_a_torn_line_for_later(spark, tmp_path):
    home, tables, checkpoint = str(tmp_path / "h"), str(tmp_path / "t"), str(tmp_path / "c")
    lines = [json.dumps(record(f"{i:03d}", f"text {i}")) for i in range(40)]
    path = os.path.join(home, "log/m/2026-01.jsonl")
    os.makedirs(os.path.dirname(path))
    with open(path, "w") as f:
        f.write("\n".join(lines[:20]) + "\n" + lines[20][:15])
    catch_up(spark, home, tables, checkpoint)
    assert read_tables(spark, tables).claims.count() == 20
    with open(path, "a") as f:
        f.write(lines[20][15:] + "\n" + "\n".join(lines[21:]) + "\n")
    catch_up(spark, home, tables, checkpoint)
    catch_up(spark, home, tables, checkpoint)
    got = sorted(r["id"] for r in read_tables(spark, tables).claims.collect())
    assert got == sorted(r["id"] for r in log.read(spark, home).claims.collect()) == [f"{i:03d}" for i in range(40)]


def test_claims_in_replies(spark):
    good = '```claims\n[{"kind": "Fact", "text": "old"}]\n```\ntalk\n```claims\n[{"kind": "decision", "text": "new", "why": "w"}]\n```'
    rows = [(1, good), (2, '[{"kind": "fact", "text": "bare"}]'), (3, '```claims\n[{"kind": "fact", "text": "a"}, {"kind": "what", "text": "b"}]\n```'), (4, "nothing"), (5, None)]
    df = spark.createDataFrame(rows, "i int, reply string")
    got = {r["i"]: r["c"] for r in df.select("i", blocks.claims_in("reply").alias("c")).collect()}
    assert [x["text"] for x in got[1]] == ["new"] and [x["text"] for x in got[2]] == ["bare"]
    assert got[3] is None and got[4] is None and got[5] is None
    assert blocks.document_in("a\n````spec\n# T\n```x\n```\n````\nb") == "# T\n```x\n```"
    assert blocks.document_in("no fence") == "no fence"


def test_merging_twice_adds_nothing(spark):
    claims = spark.createDataFrame([claim("1", branch="p/a"), claim("2", "y", branch="p/a", status="archived")], CLAIMS)
    none = spark.createDataFrame([], "branch string, kind string, suggestion string")
    merged = mutations.merge_branch(claims, "p/a", "p/b", none)
    assert [r["refs"] for r in merged.collect()] == [["merged:1"]]
    again = claims.unionByName(merged.withColumn("id", F.concat("id", F.lit("m"))).select(*claims.columns))
    assert mutations.merge_branch(again, "p/a", "p/b", none).count() == 0


def test_save_outcomes(spark):
    claims = spark.createDataFrame([claim("1", "a", branch="p/a"), claim("2", "b", branch="p/a", status="archived")], CLAIMS)
    raw = [("fact", "a", 1), ("fact", "b", 2), ("fact", "c \n", 3), ("fact", "c", 4), ("nope", "d", 5), ("fact", " ", 6), ("question", "q", 7)]
    inputs = spark.createDataFrame([(k, t, None, [], [], "p/a", i) for k, t, i in raw], "kind string, text string, why string, refs array<string>, entities array<string>, branch string, place int")
    refused = spark.createDataFrame([("p/a", "question", "p/b")], "branch string, kind string, suggestion string")
    drafts = mutations.drafts(inputs, F.lit("2026-01-01").cast("timestamp"))
    got = {r["place"]: r["outcome"] for r in mutations.save(drafts, claims, refused).collect()}
    assert got == {1: "duplicate", 2: "saved", 3: "saved", 4: "duplicate", 5: "error", 6: "error", 7: "error"}
    proposed = {r["place"]: r["outcome"] for r in mutations.save(drafts, claims, refused, proposed=True).collect()}
    assert proposed[2] == "duplicate"


def test_similar_pairs_are_all_pairs(spark):
    import random

    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    rows = [claim(f"{i:02d}", " ".join(rng.sample(words, rng.randint(1, 5)))) for i in range(60)]
    claims = spark.createDataFrame(rows, CLAIMS)
    sets = {r[0]: set(r[4].split()) for r in rows}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    node = {a: min(b for b in sets if sets[a] == sets[b]) for a in sets}
    want = {(a, b) for a in node.values() for b in node.values() if a < b and like(a, b) >= 0.6} | {(n, a) for a, n in node.items() if a != n}
    found = listing.similar_pairs(claims, 0.6).collect()
    assert {(r["a"], r["b"]) for r in found} == want and len(found) == len(want)
    for most in (3, 30, 200):
        best = sorted((-like(a, b), a, b) for a in sets for b in sets if a < b and like(a, b) >= 0.6)[:most]
        assert [(r["a"], r["b"]) for r in listing.refine(claims, 0.6, most).collect()] == [(a, b) for _, a, b in best]


def test_equal_texts_make_a_row_each(spark):
    rows = [claim(f"{i:05d}", "the very same words again") for i in range(3000)]
    assert listing.similar_pairs(spark.createDataFrame(rows, CLAIMS), 0.8).count() == 2999
    assert listing.similar_pairs(spark.createDataFrame(rows[:0], CLAIMS), 0.8).count() == 0


def test_different_texts_of_the_same_words_are_pairs(spark):
    """No link between different texts is lost: only copies are told by their class."""
    texts = ["alpha beta gamma delta omega", "Omega delta gamma beta alpha!", "alpha beta gamma delta omega", "alpha, beta gamma; delta omega", "alpha beta gamma delta omega sigma", "the and", "sigma beta gamma delta omega alpha"]
    claims = spark.createDataFrame([claim(f"{i:02d}", t) for i, t in enumerate(texts)], CLAIMS)
    found = sorted((r["a"], r["b"], round(r["similarity"], 6)) for r in listing.similar_pairs(claims, 0.8, by_text=True).collect())
    of = [0, 1, 0, 3, 4, None, 6]
    want = [(f"{a:02d}", f"{b:02d}", 1.0 if (a < 4) == (b < 4) else round(5 / 6, 6)) for a in (0, 1, 3, 4, 6) for b in (0, 1, 3, 4, 6) if a < b]
    assert found == sorted(want + [(f"{n:02d}", f"{i:02d}", 1.0) for i, n in enumerate(of) if n is not None and n != i])


def test_candidates_of_shared_rare_words_lose_no_pair(spark):
    """Rarest words lead whatever slots they share, and candidates that cannot be alike are not compared."""
    rows = [claim(f"{i:04d}", " ".join(f"common{k}" for k in range(20)) + "".join(f" rare{i // 2}x{k}" for k in range(20 if i % 4 < 2 else 2))) for i in range(400)]
    claims = spark.createDataFrame(rows, CLAIMS)
    _, pairs = listing.similar_sets(claims, 0.8)
    sets = {f"{i:04d}": frozenset(r[4].split()) for i, r in enumerate(rows)}
    node = {}
    for i, w in sets.items():
        node.setdefault(w, i)
    want = {(a, b) for w, a in node.items() for x, b in node.items() if a < b and len(w & x) / len(w | x) >= 0.8}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and len(want) > 100
