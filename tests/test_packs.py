import random
import sqlite3

import pytest

from quillstone.functions.canonical import claim_address
from quillstone.functions.render import Meta
from quillstone.functions.text import camel_parts, estimate_tokens, query_terms, stem
from quillstone.model import Weights, projection
from quillstone.operators import index
from quillstone.operators.packer import compile_pack, marginal_gain

WORDS = "sync conflict rebase shard cursor index claim branch merge pack weight token budget search lane".split()


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = " ".join(rng.choices(WORDS, k=rng.randint(4, 23))) + f" {i}"
        why = "because " + " ".join(rng.choices(WORDS, k=5)) if rng.random() < 0.5 else None
        out.append({"id": f"{i:05d}", "cid": claim_address("fact", text), "kind": rng.choice(["fact", "decision", "constraint", "question"]), "branch": "p/a", "text": text, "why": why, "refs": ["a.md"] if rng.random() < 0.3 else [], "entities": [rng.choice("abcdefgh")], "status": "superseded" if i % 10 == 0 else "active", "weight": rng.random(), "relevance": 1.0, "pinned": False})
    return out


@pytest.mark.parametrize("name", ["agents-md", "dossier", "prose"])
def test_packs_keep_their_budget_and_say_so(name):
    for seed in range(8):
        for budget in (100, 350, 1000, 4000):
            got = compile_pack(corpus(60, seed), Meta("p/a", budget), name)
            assert got["tokens"] == estimate_tokens(got["markdown"]) <= budget
            assert f"t={got['tokens']}/{budget}" in got["markdown"]
            assert got == compile_pack(corpus(60, seed)[::-1], Meta("p/a", budget), name)


def test_gains_shrink_and_archived_claims_stay_out():
    claims = [{**c, "tags": c["entities"]} for c in corpus(30, 1)]
    for i in range(20, 30):
        gains = [marginal_gain(claims, list(range(k)), i) for k in range(0, 20, 4)]
        assert all(a >= b - 1e-12 for a, b in zip(gains, gains[1:], strict=False))
    none = [{**c, "weight": 0.0} for c in corpus(5, 2)]
    assert compile_pack(none, Meta("p/a", 700), "markdown")["n"] == 0
    pinned = [{**c, "pinned": k == 3} for k, c in enumerate(none)]
    assert compile_pack(pinned, Meta("p/a", 700), "markdown")["claims"] == ["00003"]


def test_relevance_focuses_a_pack():
    claims = corpus(200, 5)
    for k, c in enumerate(claims):
        c["weight"], c["relevance"] = 0.8, 1.0 if k < 10 else 0.02
    focused = compile_pack(claims, Meta("p/a", 400), "markdown")["claims"]
    broad = compile_pack([{**c, "relevance": 1.0} for c in claims], Meta("p/a", 400), "markdown")["claims"]
    hits = [sum(x < "00010" for x in found) / len(found) for found in (focused, broad)]
    assert hits[0] > 0.5 > hits[1]


def test_settings():
    assert Weights.of({"alpha": 2.0}).alpha == 2.0
    with pytest.raises(ValueError):
        Weights.of({"alfa": 1})
    assert projection("handoff").name == "prose"
    assert camel_parts("syncNow") == ["sync", "now"] and camel_parts("sync") == []
    assert query_terms("How do we use syncNow?") == ["sync", "now", "syncnow"]
    assert query_terms("how do we") == ["how", "do", "we"]
    assert [stem(w) for w in ("running", "relational", "ponies", "hopping")] == ["run", "relat", "poni", "hop"]


def test_search_agrees_with_a_full_text_engine(spark):
    rows = [(f"{i}", c["text"], c["why"], c["entities"], c["refs"]) for i, c in enumerate(corpus(80, 9))]
    claims = spark.createDataFrame(rows, "id string, text string, why string, entities array<string>, refs array<string>")
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text, why, entities, refs, tokenize='porter unicode61 remove_diacritics 2')")
    for i, t, w, e, r in rows:
        db.execute("INSERT INTO f(rowid, text, why, entities, refs) VALUES (?, ?, ?, ?, ?)", (int(i) + 1, t, w or "", " ".join(e), " ".join(r)))
    want = {str(i - 1): -s for i, s in db.execute("SELECT rowid, bm25(f, 1.0, 0.5, 2.0, 1.5) FROM f WHERE f MATCH ?", ('"rebas"* OR "lan"* OR "budget"*',))}
    got = {r["id"]: r["score"] for r in index.bm25(index.token_table(claims), ["rebase", "lane", "budget"]).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
