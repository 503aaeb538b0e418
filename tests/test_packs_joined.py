"""Packs whose texts join after the choice are those of all claims gathered in one place."""

import pandas as pd
import pytest

from quillstone.functions.canonical import with_address
from quillstone.functions.render import Meta
from quillstone.model import Weights, projection
from quillstone.operators import packer
from quillstone.operators.branches import Branches
from quillstone.operators.packer import SLIM, choices, choose, compile_pack, in_rounds, packs, slim_rows
from quillstone.operators.weights import weighted
from test_packs import corpus

CLAIM = "id string, cid string, kind string, branch string, text string, why string, refs array<string>, entities array<string>, status string, confidence string, helpful long, harmful long, supersedes string, src string, t_tx timestamp, t_valid timestamp"
BRANCHES = Branches({"p": {"a": {}, "b": {"inherits": {"a": ["decision", "fact"]}}, "none": {}}})


@pytest.fixture(scope="module")
def claims(spark):
    import datetime as dt

    rows = []
    for k, c in enumerate([*corpus(150, 3), *({**c, "id": "1" + c["id"][1:], "branch": "p/b"} for c in corpus(40, 4))]):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)
        rows.append((c["id"], c["cid"], c["kind"], c["branch"], c["text"], c["why"], c["refs"], c["entities"], c["status"], ("high", "medium", "low")[k % 3], k % 4, k % 2, None, "x", at, at))
    rows += rows[:3]  # repeated
    rows.append(("99999", "b3:" + "f" * 64, "fact", "p/a", "huge " * 4000, None, None, None, "active", "high", 0, 0, None, "x", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1)))
    return spark.createDataFrame(rows, CLAIM).repartition(4)


@pytest.mark.parametrize("name, budget", [("agents-md", 700), ("markdown", 1500), ("dossier", None), ("prose", 900)])
def test_joined_packs_equal_gathered_ones(spark, claims, name, budget):
    sources = BRANCHES.pool_table(spark)
    relevance = claims.where("id < '00060'").selectExpr("id", "CASE WHEN id < '00010' THEN 0.7D ELSE 0.1D END AS relevance").distinct()
    pins = spark.createDataFrame([("p/a", "00070"), ("p/a", "00071"), ("p/b", "10003")], "for_branch string, id string")
    for rank, pin in ((None, None), (relevance, pins)):
        got = {r["for_branch"]: r for r in packs(claims, sources, name, budget, relevance=rank, pins=pin).collect()}
        from quillstone.operators.branches import pool

        seen = weighted(pool(claims, sources), ["for_branch"]).collect()
        ranks = None if rank is None else {r["id"]: r["relevance"] for r in rank.collect()}
        pinned = set() if pin is None else {tuple(r) for r in pin.collect()}
        most = projection(name).budget if budget is None else budget
        for branch in ("p/a", "p/b"):
            own = [{**r.asDict(), "relevance": 1.0 if ranks is None else ranks.get(r["id"]), "pinned": (branch, r["id"]) in pinned} for r in seen if r["for_branch"] == branch]
            want = compile_pack(own, Meta(branch, most), name)
            assert {k: got[branch][k] for k in want} == want
        assert set(got) == {"p/a", "p/b"}


def test_a_branch_of_which_nothing_fits(spark, claims):
    some = choices(claims.where("id = '99999'"), BRANCHES.pool_table(spark), "markdown", 100).collect()
    assert {(r["for_branch"], r["id"]) for r in some} == {("p/a", None), ("p/b", None)}
    got = packs(claims.where("id = '99999'"), BRANCHES.pool_table(spark), "markdown", 100).collect()
    assert {r["for_branch"]: r["n"] for r in got} == {"p/a": 0, "p/b": 0}
    assert packs(claims.limit(0), BRANCHES.pool_table(spark), "markdown").count() == 0


@pytest.mark.parametrize("name, budget", [("agents-md", 400), ("markdown", 1500), ("dossier", 900)])
def test_rounds_choose_what_one_choice_over_all_would(spark, claims, name, budget):
    sources = BRANCHES.pool_table(spark)
    relevance = claims.where("id < '00090'").selectExpr("id", "CASE WHEN id < '00010' THEN 0.7D ELSE 0.3D END AS relevance").distinct()
    pins = spark.createDataFrame([("p/a", "00070"), ("p/a", "00012"), ("p/b", "10003")], "for_branch string, id string")
    for rank, pin in ((None, None), (relevance, pins)):
        found = [sorted((r["for_branch"], r["place"] or 0, r["id"], r["reason"], r["weight"], r["pinned"]) for r in choices(claims, sources, name, budget, relevance=rank, pins=pin, seen=seen).collect()) for seen in (4, 23, 1000)]
        assert found[0] == found[1] == found[2] and len(found[0]) > 8
        rows = slim_rows(claims, sources, budget, Weights(), rank, pin).toPandas()
        for branch in ("p/a", "p/b"):
            own = rows[(rows["for_branch"] == branch)]
            most = own["relevance"].max()
            able = own[own["able"]].assign(relevance=(own["relevance"] / most).fillna(1.0)).drop_duplicates("id").sort_values("id").to_dict("records")
            want = [(able[i]["id"], reason) for i, reason in choose(able, Meta(branch, budget), name, Weights())]
            assert [(r[2], r[3]) for r in found[0] if r[0] == branch] == want


def test_equal_claims_are_chosen_by_id_over_many_rounds(spark):
    """Two hundred claims of one worth in many partitions, two seen at a time."""
    rows = [("p/a", f"{k:03d}", True, 0.5, 1.0, False, 30, 0, ["t"], [k]) for k in range(200)]
    slim = spark.createDataFrame(rows, SLIM).repartition(6)
    got = sorted((r["place"], r["id"]) for r in in_rounds(slim, "markdown", 700, Weights(), 2).collect())
    assert [i for _, i in got] == [f"{k:03d}" for k in range(len(got))] and len(got) > 5
    assert in_rounds(slim.limit(0), "markdown", 700, Weights(), 2).count() == 0


def test_only_chosen_texts_are_hashed(spark, claims):
    """The join that keeps what was chosen is below the hashing in the plan, and packs are those of addressed claims."""
    sources = BRANCHES.pool_table(spark)
    for budgets in ([700], [400, 900]):
        of = lambda c, **more: packer.packs_of_budgets(c, sources, "agents-md", budgets, **more) if len(budgets) > 1 else packs(c, sources, "agents-md", budgets[0], **more)  # noqa: B023, E731
        made = of(claims, addressed=False)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert -1 < plan.index("ArrowEvalPython") < plan.index("LeftSemi")
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, of(with_address(claims)).collect()))


def test_a_scan_makes_objects_of_few_rows_at_once(monkeypatch):
    """Whatever the size of a batch; words of a candidate are let go of once it is reckoned."""
    rows = pd.DataFrame([{"for_branch": "p/" + "ab"[k // 300], "id": f"{k:03d}", "able": k % 9 > 0, "weight": 0.1 + (k * 7 % 50) / 50, "relevance": 1.0, "pinned": False, "cost": 10 + k % 7, "why_cost": 0, "tags": [f"t{k % 5}"], "words": [k, k % 3, k % 11]} for k in range(600)])
    of = lambda k: {**rows.iloc[k].to_dict(), "place": 0}
    going = {"p/a": packer.Standing(1.0, [of(1), of(2)], 500), "p/b": packer.Standing(1.0, [of(301)], 500)}
    rated, held = packer._rated, []
    monkeypatch.setattr(packer, "_rated", lambda part, *more: held.append(len(part)) or rated(part, *more))
    forget, words = packer.Choice.forget, []
    monkeypatch.setattr(packer.Choice, "forget", lambda self, i: forget(self, i) or words.append(len(self._words)))
    found = []
    for objects in (13, 1000):
        monkeypatch.setattr(packer, "OBJECTS", objects)
        held.clear()
        found.append(pd.concat(packer._scan(going, "none", Weights(), 40)([rows])).reset_index(drop=True))
        assert max(held) <= min(objects, 300) and max(words) <= 2  # those of the picked
    pd.testing.assert_frame_equal(found[0], found[1])
    assert len(found[0]) == 80
