"""The kept view equals a view of the whole log, takes only what is new, and is made again where it has to be."""

import glob
import os

import pytest

from oracle import SF, TABLES, both, table
from quillstone.engine import Engine
from quillstone.operators import views
from quillstone.plans import catalogue
from quillstone.plans.adapter import Adapted
from quillstone.sources import config, log
from quillstone.streaming import demo
from quillstone.streaming import kept as module
from quillstone.streaming.kept import KeptView

CLAIM = ["id", "cid", "kind", "branch", "text", "status", "base_status", "supersedes", "helpful", "harmful"]


def rows(df, *names):
    df = df.select(*names) if names else df
    return table(df.columns, [tuple(r) for r in df.collect()])


@pytest.fixture()
def home(tmp_path):
    (tmp_path / "home").mkdir()
    config.save_branches(str(tmp_path / "home/branches.yaml"), {"notes": {"research": {}, "code": {"parent": "research"}}})
    return str(tmp_path / "home")


def test_saves_read_only_their_own_lines(spark, home, tmp_path):
    kept = Engine(spark, home, "m1", "notes/research", view=str(tmp_path / "view"))
    ids = [kept.save("fact", f"Fact number {k}", entities=["x"])["id"] for k in range(4)]
    new = kept.save("decision", "The last word", supersedes=ids[0])["id"]
    kept.rate(ids[1], True)
    kept.rate(ids[1], True)
    kept.rate(ids[1], False)
    kept.transition(ids[2], "archived")
    kept.save_doc("plan", "# One\n\ntext")
    kept.save_doc("plan", "# Two\n\ntext")
    whole = Engine(spark, home, "m1", "notes/research")
    assert rows(kept.claims, *CLAIM) == rows(whole.claims, *CLAIM)
    assert rows(kept.docs, "id", "branch", "name", "title", "body", "cid") == rows(whole.docs, "id", "branch", "name", "title", "body", "cid")
    assert kept.generation() == whole.generation()
    assert {r["id"]: (r["status"], r["helpful"], r["harmful"]) for r in kept.claims.collect() if r["id"] in (*ids[:3], new)} == {ids[0]: ("superseded", 0, 0), ids[1]: ("active", 2, 1), ids[2]: ("archived", 0, 0), new: ("active", 0, 0)}
    taken = {r["batch"]: r["records"] for r in kept.kept.taken().collect()}
    assert sum(taken.values()) == 11 and len(taken) >= 10  # a read takes the line or two since the last, and none twice
    last = max(taken)
    assert {r["id"] for r in kept.kept.changed(last).collect()} == {r["id"] for r in kept.docs.collect()}
    # a status touches the bucket of its claim alone
    before = {p: os.path.getmtime(p) for p in glob.glob(f"{tmp_path}/view/*/view/claims/*/*.parquet")}
    kept.transition(ids[3], "rejected")
    assert kept.get(ids[3]).first()["status"] == "rejected"
    after = {p: os.path.getmtime(p) for p in glob.glob(f"{tmp_path}/view/*/view/claims/*/*.parquet")}
    assert len({os.path.dirname(p) for p, _ in before.items() ^ after.items()}) == 1
    kept.remove("notes/research")
    assert rows(kept.refresh().claims, *CLAIM) == rows(whole.refresh().claims, *CLAIM) and kept.docs.count() == 0 == whole.docs.count()


def test_a_log_that_lost_lines_is_read_anew(spark, home, tmp_path):
    writer = Engine(spark, home, "m1", "notes/research")
    ids = [writer.save("fact", f"Fact number {k}")["id"] for k in range(4)]
    kept = KeptView(spark, home, str(tmp_path / "view"), buckets=8).catch_up()
    old = kept.claims()
    assert {r["id"] for r in old.collect()} == set(ids)
    (shard,) = glob.glob(f"{home}/log/m1/*.jsonl")
    with open(shard) as f:
        lines = f.readlines()
    with open(shard, "w") as f:
        f.writelines(lines[:2])
    first = kept.current()
    kept.catch_up()
    assert kept.current()["number"] == first["number"] + 1
    assert {r["id"] for r in kept.claims().collect()} == set(ids[:2])
    assert {r["id"] for r in old.collect()} == set(ids)  # who began to read before reads on
    with open(shard, "a") as f:
        f.writelines(lines[2:3])
    assert {r["id"] for r in kept.catch_up().claims().collect()} == set(ids[:3])
    Engine(spark, home, "m2", "notes/research").save("fact", "Of another machine")
    os.remove(shard)
    assert [r["text"] for r in kept.catch_up().claims().collect()] == ["Of another machine"]


def test_another_version_is_made_again(spark, home, tmp_path, monkeypatch):
    Engine(spark, home, "m1", "notes/research").save("fact", "Something")
    kept = KeptView(spark, home, str(tmp_path / "view"), buckets=8).catch_up()
    first = kept.current()
    assert kept.catch_up().current() == first
    monkeypatch.setattr(module, "RULES", module.RULES + 1)
    kept.catch_up()
    assert kept.current()["number"] == 1 and kept.current()["version"] != first["version"] and kept.claims().count() == 1


def test_a_rebuild_that_dies_shows_nothing(spark, home, tmp_path, monkeypatch):
    """A reader sees the old generation until the new one is whole."""
    writer = Engine(spark, home, "m1", "notes/research")
    writer.save("fact", "Something")
    kept = KeptView(spark, home, str(tmp_path / "view"), buckets=8).catch_up()
    real = module.take_new

    def half(*args):
        real(*args)
        raise RuntimeError("died")

    writer.save("fact", "Something else")
    monkeypatch.setattr(module, "take_new", half)
    with pytest.raises(RuntimeError, match="died"):
        kept.rebuild()
    assert kept.claims().count() == 1 and kept.current()["number"] == 0
    monkeypatch.setattr(module, "take_new", real)
    assert kept.catch_up().claims().count() == 2


def test_bad_lines_and_an_empty_log(spark, home, tmp_path):
    kept = KeptView(spark, home, str(tmp_path / "view"))
    with pytest.raises(ValueError, match="catch up"):
        kept.claims()
    assert kept.catch_up().claims().count() == 0 == kept.docs().count() == kept.taken().count()
    assert all(getattr(kept.records(), n).count() == 0 for n in ("claims", "statuses", "counters", "docs", "warnings"))
    os.makedirs(f"{home}/log/m1")
    with open(f"{home}/log/m1/2024-01.jsonl", "w") as f:
        f.write('not json\n\n{"rec":"moon","id":"x"}\n{"rec":"status","id":"S1","claim":"C1","to":"archived"}\n{"rec":"claim","id":"C1","cid":"b3:0","kind":"fact","text":"t"}\n')
    kept.catch_up()
    whole = log.read(spark, home)
    assert rows(kept.records().warnings) == rows(whole.warnings) and len(rows(whole.warnings)[1]) == 3
    assert kept.claims().count() == 0 and rows(views.status_history(kept.records().statuses), "id", "claim", "to") == rows(whole.statuses, "id", "claim", "to")


def test_a_status_of_a_document_leaves_the_claim_of_the_same_number(spark, tmp_path):
    """Both tables begin at 0: an archived first turn isn't the claim that has its number."""
    sf = tmp_path / "sf"
    sf.mkdir()
    for name in TABLES:
        if name != "conversations":
            os.symlink(f"{SF}/{name}.parquet", sf / f"{name}.parquet")
    turns = [(0, k, "system" if k % 2 else "user", f"Turn {k}") for k in range(60)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(sf / "conversations.parquet"))
    view = demo.keep_twice(Adapted(spark, str(sf)), f"file://{tmp_path}/home")
    mine, theirs = both(spark, lambda *_: view.claims().select("id", "kind", "branch", "base_status", "status", "helpful", "harmful"), catalogue.SQL["q_kept_view"], str(sf))
    assert mine == theirs and len(mine[1]) == 200
    assert [r["body"] for r in view.docs().collect()] == ["Turn 58"]
