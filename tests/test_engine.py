import pytest

from quillstone.engine import Engine
from quillstone.functions import files
from quillstone.sources import config


@pytest.fixture()
def engine(spark, tmp_path):
    home = str(tmp_path / "home")
    (tmp_path / "home").mkdir()
    config.save_branches(f"{home}/branches.yaml", {"notes": {"research": {}, "code": {"parent": "research", "holds": ["decision", "constraint"], "inherits": {"research": ["decision"]}}}})
    (tmp_path / "home" / "weights.yaml").write_text("gamma: 0.3\n")
    return Engine(spark, home, "m1", "notes/research")


def test_idea_to_pack(engine, tmp_path):
    e = engine
    assert e.weights.gamma == 0.3 and e.weights.alpha == 1.0
    first = e.save("decision", "Students are the audience", why="they take notes", entities=["Audience"])
    assert e.save("decision", "Students are the audience ", why="they take notes", entities=["audience"])["outcome"] == "duplicate"
    e.save("rejected", "Real-time collaboration", refs=["docs/plan.md"])
    second = e.save("decision", "Students and teachers are the audience", supersedes=first["id"], entities=["audience"])
    with pytest.raises(ValueError, match="notes/research"):
        e.save("fact", "x", branch="notes/code")
    assert {r["status"] for r in e.get(first["id"]).collect()} == {"superseded"}
    assert [r["id"] for r in e.search("teachers audience", 5).collect()][0] == second["id"]
    assert {r["id"] for r in e.neighbors([first["id"]]).collect()} == {second["id"]}
    code = e.pack("notes/code", "markdown", 600).first()
    assert "Students and teachers" in code["markdown"] and "Real-time" not in code["markdown"] and code["tokens"] <= 600
    dossier = e.pack("notes/research", "dossier", task="collaboration").first()
    assert "Real-time collaboration" in dossier["markdown"]
    assert "Previously: Students are the audience" in (prose := e.pack("notes/research", "prose").first()["markdown"]) and "why: they take notes" in prose
    e.rate(second["id"], True)
    e.rate(second["id"], True)
    assert e.get(second["id"]).first()["helpful"] == 2
    assert e.save_doc("spec", "# The plan\n\nBuild it.  ")["outcome"] == "saved"
    assert e.save_doc("spec", "# The plan\n\nBuild it.")["outcome"] == "unchanged"
    assert e.find_doc("spec", "notes/code").first()["title"] == "The plan"
    root = e.state_root().first()["root"]
    assert e.verify(root[:11]).first()["behind"] == 0
    assert "notes/research" in e.index() and e.generation() is not None
    assert len(e.write_packs(str(tmp_path / "packs"))) == 2 and e.write_packs(str(tmp_path / "packs")) == []
    offered = e.propose("decision", "Use SQLite", "notes/code")
    e.review(offered["id"], True)
    assert e.get(offered["id"]).first()["status"] == "active"
    e.register_views()
    assert e.spark.sql("SELECT count(*) AS n FROM claims WHERE branch = 'notes/research'").first()["n"] == 3
    claims, docs = e.remove("notes/research")
    assert (claims, docs) == (3, 1)
    assert e.search("audience").count() == 0 and e.search("audience", include_archived=True).count() == 2


def test_files():
    text = files.splice("# Mine\n", "one")
    assert files.current_block(text) == "one" and text.startswith("# Mine\n")
    assert files.current_block(files.splice(text, "two")) == "two" and files.splice(text, "one") == text
    assert files.document_state(files.document_file("p/a", "body")) == ("p/a", False)
    assert files.document_state(files.document_file("p/a", "body") + "more")[1]
    assert files.parse_inherits("research: fact, decision") == ("research", ["fact", "decision"])
    assert files.resolve_branch("code", ["p/code", "q/code"], "p/research") == "p/code"
    with pytest.raises(ValueError):
        files.resolve_branch("code", ["q/code", "r/code"], "p/research")
    assert files.idea_branch("Notes App!") == "notes-app/research"
    a = files.new_id(1.5)
    b = files.new_id(1.0, a)
    assert a < b and len(b) == 26 and files.decode_id(b) == files.decode_id(a) + 1


def test_whole_branches_move(engine):
    """Merging, renaming and archiving write what they say, and again nothing."""
    e = engine
    first = e.save("decision", "Notes are plain text", branch="notes/research")
    second = e.save("decision", "Notes are Markdown", branch="notes/research", supersedes=first["id"])
    e.save("fact", "Students take notes", branch="notes/research")
    e.save_doc("spec", "# Plan\n\nBuild it.", branch="notes/research")
    pack = e.pack("notes/research", "markdown", 600).first()["markdown"]
    assert all((r["cid"][3:7] in pack) == (r["id"] not in {u["id"] for u in e.unseen(pack).collect()}) for r in e.scan(branch="notes/research").collect()) and {r["id"] for r in e.unseen("", "notes/research").collect()} >= {second["id"]}
    root = e.state_root().first()["root"]
    assert e.standing(f" {root.upper()}\n") == "in sync" and e.standing("b3:0123") == "ahead or diverged"
    with pytest.raises(ValueError):
        e.standing("  ")
    # the code branch holds decisions and constraints alone, and the superseded one isn't active
    assert e.merge("notes/research", "notes/code") == 1 and e.merge("notes/research", "notes/code") == 0
    copy = e.scan(branch="notes/code").first()
    assert copy["text"] == "Notes are Markdown" and copy["refs"] == ["merged:" + second["id"]]
    with pytest.raises(ValueError):
        e.rename_project("notes", "notes")
    assert e.rename_project("notes", "memo") == 4
    assert {r["text"]: r["status"] for r in e.scan(branch="memo/research").collect()} == {"Notes are plain text": "superseded", "Notes are Markdown": "active", "Students take notes": "active"}
    assert {r["status"] for r in e.scan(branch="notes/research").collect()} == {"archived"}
    assert [(r["branch"], r["name"], r["title"]) for r in e.docs.collect()] == [("memo/research", "spec", "Plan")]
    chained = e.scan(branch="memo/research").where("supersedes IS NOT NULL").collect()
    assert len(chained) == 1 and e.get(chained[0]["supersedes"]).first()["text"] == "Notes are plain text"
    assert e.archive_branch("memo/code") == 1 and e.archive_branch("memo/code") == 0


def test_a_rename_that_dies_is_finished_by_the_next(engine, monkeypatch):
    e = engine
    e.save("decision", "Notes are plain text")
    e.save_doc("spec", "# Plan")
    real = Engine._carry_definitions

    def die(self, old, new):
        raise RuntimeError("died")

    monkeypatch.setattr(Engine, "_carry_definitions", die)
    with pytest.raises(RuntimeError, match="died"):
        e.rename_project("notes", "memo")
    monkeypatch.setattr(Engine, "_carry_definitions", real)
    e = Engine(e.spark, e.home, "m1", "memo/research")
    assert [(r["branch"], r["status"]) for r in e.claims.orderBy("branch").collect()] == [("memo/research", "active"), ("notes/research", "archived")]
    assert e.rename_project("notes", "memo") == 0 and e.claims.count() == 2
    assert e.branches.get("memo/code") == {"parent": "research", "holds": ["decision", "constraint"], "inherits": {"research": ["decision"]}}
    assert all(e.branches.get(b)["archived"] for b in e.branches.all() if b.startswith("notes/")) and not e.branches.get("memo/research").get("archived")
    with pytest.raises(ValueError, match="in use"):
        e.rename_project("notes", "memo")
    e.set_active("memo/code")
    again = Engine(e.spark, e.home, "m1")
    assert again.active() == again.branch == "memo/code"
    assert again.ensure_project("other") and not again.ensure_project("other") and again.branches.get("other/research")["compile"] == "dossier"
    again.new_branch("memo/talk", "writing", "research")
    assert again.remove_project("memo") == (1, 1) and config.load_branches(f"{e.home}/branches.yaml")["memo"]["research"]["archived"]


def test_ids_of_one_write_are_unique(spark):
    from pyspark.sql import functions as F

    from quillstone.operators import mutations

    at = F.lit("2025-01-01 00:00:00").cast("timestamp")
    rows = spark.range(5000).repartition(7).select(F.lit("same").alias("id"))
    made = mutations.transitions(rows, "archived", None, "x", at).collect()
    assert len({r["id"] for r in made}) == 5000 and {len(r["id"]) for r in made} == {26}
    later = mutations.transitions(rows, "archived", None, "x", at + F.expr("INTERVAL 1 SECOND")).agg(F.min("id")).first()[0]
    assert max(r["id"] for r in made) < later
