"""The registered queries leave out no part of their job."""

import random

import numpy as np
from pyspark.sql import functions as F

from oracle import SF
from quillstone.functions import canonical
from quillstone.functions.canonical import merkle_root
from quillstone.operators import listing, views
from quillstone.plans import catalogue
from quillstone.plans.adapter import Adapted


def test_stream_reads_all_records(spark, tmp_path):
    from quillstone.sources import log
    from quillstone.streaming import demo
    from quillstone.streaming.source import read_tables

    a, home = Adapted(spark, SF), f"file://{tmp_path}/home"
    got = sorted(map(tuple, demo.catch_up_twice(a, home).collect()), key=str)
    whole = (("claim", a.raw, "branch"), ("status", a.statuses.select("id").union(a.doc_statuses.select("id")), None), ("counter", a.counters, None), ("doc", a.docs_all, "branch"))
    want = [(rec, *r) for rec, df, by in whole for r in df.groupBy(F.col(by) if by else F.lit(None)).agg(F.count("*"), F.max("id")).collect()]
    assert got == sorted(want, key=str) and len(want) > 4
    assert got == sorted(map(tuple, demo.summary(log.read(spark, home)).collect()), key=str)
    streamed = read_tables(spark, f"{home}/tables")
    for mine, theirs in ((views.counter_totals(streamed.counters), views.counter_totals(a.counters)), (views.effective_status(streamed.claims, streamed.statuses).select("id", "status"), views.effective_status(a.raw, a.statuses).select("id", "status"))):
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, theirs.select(*mine.columns).collect()))
    assert len({(r["machine"], r["month"]) for r in spark.read.text(f"{home}/bulk").select("machine", "month").distinct().collect()}) > 4


def test_verification_takes_the_whole_active_pool(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    a = Adapted(spark, sf)
    rows = catalogue.canonical.with_address(a.claims.where("branch = 'es/research' AND status = 'active'")).select("id", "cid").collect()
    cids = [r["cid"] for r in sorted(rows)]
    k = min(50, len(cids) // 2)
    (got,) = catalogue.QUERIES["q_verify_prefix"](spark, sf).collect()
    assert k > 3 and got["root"] == catalogue.canonical.merkle_root(cids[: len(cids) - k]) and got["behind"] == k


def test_trees_over_much_the_same_leaves_share_their_nodes(monkeypatch):
    rng = random.Random(8)
    leaves = [bytes(rng.randrange(256) for _ in range(32)) for _ in range(300)]
    rows = [sorted(rng.sample(range(300), n)) for n in (1, 2, 3, 128, 255, 300)] + [list(range(k, k + 256)) for k in range(40)]
    picks = np.full((len(rows), 300), -1)
    for row, places in zip(picks, rows, strict=True):
        row[: len(places)] = places
    hashed = []
    plain = canonical.blake3
    want = [canonical.climb([leaves[i] for i in places]) for places in rows]
    monkeypatch.setattr(canonical, "blake3", lambda messages: hashed.extend(messages) or plain(messages))
    assert canonical.climb_all(leaves, picks) == want
    assert len(hashed) == len(set(hashed)) < sum(map(len, rows)) / 2


def test_growing_steps_cover_all_numbers_once():
    for most in (0, 1, 7, 8, 9, 64, 500):
        assert [k for a, b in listing.steps(most) for k in range(a, b + 1)] == list(range(most + 1))
    assert listing.steps(500) == [(0, 0), (1, 8), (9, 64), (65, 500)]


def test_verification_equals_the_plain_walk_back(spark, monkeypatch):
    monkeypatch.setattr(listing, "RUN", 16)
    rng = random.Random(4)
    for n, back in ((1, 5), (40, 60), (150, 40)):
        rows = [(f"{i:04d}", f"b3:{rng.randrange(n * 3):x}".ljust(20, "e")) for i in range(n)]  # some addresses twice
        pool = spark.createDataFrame(rows, "id string, cid string")
        states = [merkle_root(c for _, c in rows[: n - k]) for k in range(min(back, n) + 1)]
        for k in {0, 1, len(states) // 2, len(states) - 1}:
            assert [tuple(r) for r in listing.verify(pool, states[k][:30], back).collect()] == [(states.index(states[k]), states[k])]
        assert listing.verify(pool, "b3:none", back).count() == 0


def test_recall_asks_for_every_good_label(spark):
    a = Adapted(spark, SF)
    good = {r["doc_id"] for r in a.table("labels").where("quality = 1").collect()}
    texts = [(r["branch"], r["text"].lower().split("\n")) for r in a.raw.collect() if r["doc_id"] in good]
    asked = [(b, line) for b, lines in texts for line in lines if line.strip(" ")]
    got = {r["budget"]: r for r in catalogue.QUERIES["q_eval_recall"](spark, SF).collect()}
    assert len(asked) > 20
    for budget in (1000, 4000):
        packs = {r["for_branch"]: r for r in catalogue._packs(a, "markdown", budget=budget).collect()}
        seen = [(b, e) for b, e in asked if b in packs]
        hits = sum(e in packs[b]["markdown"].lower() for b, e in seen)
        of_texts = [packs[b]["tokens"] for b, _ in texts if b in packs]
        tokens = sum(of_texts) // len(of_texts)
        assert (got[budget]["hits"], got[budget]["total"], got[budget]["mean_tokens"]) == (hits, len(seen), tokens) and hits
