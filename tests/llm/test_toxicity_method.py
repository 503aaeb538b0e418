"""The factorization machine against plain formulas, and on toxicity that only a pair of words has."""

import gc
import random
import tracemalloc
import weakref

import numpy as np

from pyspark.sql import functions as F

from quillstone.llm import toxicity

from .conftest import rows, words


def slow_passages(text):
    import re

    found = re.findall(r"[a-zà-ÿ]+", text.lower())
    cells = [found[k : k + toxicity.CELL] for k in range(0, len(found), toxicity.CELL)] or [[]]
    pairs = [a + b for a, b in zip(cells, cells[1:], strict=False)] or cells
    return [{(k, w[: k or None]) for w in p for k in (0, *toxicity.PREFIXES) if not k or len(w) > k} for p in pairs]


def test_passages_hold_the_terms_of_two_cells():
    rng = random.Random(3)
    values = ["", "one", words(rng, 64), words(rng, 65), words(rng, 500), "!!"]
    owner, begin, term = toxicity.passages(values)
    slow = [p for t in values for p in slow_passages(t)]
    assert owner.tolist() == [i for i, t in enumerate(values) for _ in slow_passages(t)]
    # two strings may have one hash of 20 bits
    for k, p in enumerate(slow):
        assert len(p) - 3 <= begin[k + 1] - begin[k] <= len(p) and (np.diff(term[begin[k] : begin[k + 1]]) > 0).all()
    active = np.zeros(1 << toxicity.BITS, bool)
    active[term[::3]] = True
    assert np.array_equal(toxicity.passages(values, active)[2], term[active[term]])


def test_margin_and_gradient_by_force():
    rng = np.random.default_rng(0)
    params = rng.normal(0, 0.5, (12, 4))
    rows_ = [np.sort(rng.choice(12, k, replace=False)) for k in (0, 1, 5, 7)]
    at, begin = np.concatenate(rows_).astype(int), np.cumsum([0, *map(len, rows_)])

    def force(p):
        return np.array([sum(p[i, 0] for i in r) + sum(p[i, 1:] @ p[j, 1:] for a, i in enumerate(r) for j in r[:a]) for r in rows_])

    got, vx = toxicity.margins(params, at, begin)
    assert np.allclose(got, force(params))
    y = np.array([1, 0, 1, 0.0])
    loss = lambda p: np.log1p(np.exp(force(p))).sum() - (y * force(p)).sum()
    hit, grad = toxicity.gradient(params, at, begin, vx, toxicity.sigmoid(got) - y)
    assert hit.tolist() == sorted(set(at.tolist()))
    for row, g in zip(hit, grad, strict=True):
        for k in range(4):
            moved = [params.copy(), params.copy()]
            moved[0][row, k] += 1e-5
            moved[1][row, k] -= 1e-5
            assert abs((loss(moved[0]) - loss(moved[1])) / 2e-5 - g[k]) < 1e-5


def test_worst_passage_is_the_texts_score():
    assert toxicity.worst(np.array([1.0, 3.0, 3.0, -2.0, 0.0]), np.array([0, 3, 4])).tolist() == [1, 3, 4]


def test_a_score_is_the_plain_formula():
    rng = random.Random(5)
    texts = [words(rng, n) for n in (0, 3, 70, 300)]
    _, _, term = toxicity.passages(texts)
    used = np.unique(term)[::2]
    slots = np.zeros(1 << toxicity.BITS, np.int32)
    slots[used] = np.arange(1, len(used) + 1)
    params = np.random.default_rng(1).normal(0, 0.1, (len(used), 9))
    machine = toxicity.Machine(slots, params, 1.7, -0.4)
    for text, got in zip(texts, machine.score(texts), strict=True):
        best = -np.inf
        _, begin, own = toxicity.passages([text])
        for a, b in zip(begin, begin[1:], strict=False):
            x = [params[slots[t] - 1] for t in own[a:b] if slots[t]]
            best = max(best, sum(p[0] for p in x) + sum(p[1:] @ q[1:] for k, p in enumerate(x) for q in x[:k]))
        assert abs(got - 1 / (1 + np.exp(-(1.7 * best - 0.4)))) < 1e-9


def pairs(n, seed):
    """Toxic: an insult, or two words together that are each as common, one by one, in clean texts."""
    rng = random.Random(seed)
    vocabulary = [words(rng, 1) for _ in range(800)]
    out = []
    for i in range(n):
        w, kind = rng.choices(vocabulary, k=rng.randint(30, 90)), rng.choice(["pair", "insult", "first", "second"])
        for extra in {"pair": ["zorblin", "quaxen"], "insult": ["vilexa"], "first": ["zorblin"], "second": ["quaxen"]}[kind]:
            w.insert(rng.randrange(len(w)), extra)
        out.append((i, " ".join(w), int(kind in ("pair", "insult")), kind))
    return out


def test_a_pair_is_learned_though_neither_word_tells_anything(spark):
    data = pairs(2400, 1)
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in data], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels, toxicity.held_out_third())
    held = {r["doc_id"] for r in docs.where(toxicity.held_out_third()).select("doc_id").collect()}
    got = {r["doc_id"]: r["toxicity_score"] >= 0.7 for r in toxicity.score(docs, machine).collect()}
    share = lambda kind: np.mean([got[i] for i, _, _, k in data if k == kind and i in held])
    assert share("pair") >= 0.9 and share("insult") >= 0.95 and max(share("first"), share("second")) <= 0.03


def test_columns_may_be_called_as_the_results_are(spark, weird, nothing):
    machine = toxicity.train(nothing, nothing.selectExpr("doc_id", "1 AS toxic"), toxicity.held_out_third())
    got = toxicity.score(weird, machine)
    assert sorted(got.columns) == sorted(weird.columns) and dict(got.dtypes)["toxicity_score"] == "double" and got.count() == len(rows())
    assert {r["toxicity_score"] for r in got.collect()} == {0.5}
    assert toxicity.score(nothing, machine).count() == 0
    renamed = weird.withColumnRenamed("line", "a b.c").withColumnRenamed("doc", "_source_text")
    assert toxicity.score(renamed, machine).count() == len(rows()) == toxicity.reject(renamed, machine, 0.7).count()


def test_terms_of_the_fit_are_bounded(spark):
    """Ids whose terms would go beyond the bound are left out, whatever rows repeat them; what fits is fitted as before."""
    rng = random.Random(3)
    docs = [(i, words(rng, 30) + (" bad thing" if i % 2 else " good thing")) for i in range(60)] + [(60, words(rng, 5000))] * 3
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(61)], "doc_id long, toxic int")
    nobody = F.lit(False)
    whole, bounded, without = (toxicity.train(d, labels, nobody, fit_terms=n) for d, n in ((table, 50_000_000), (table, 20_000), (table.where("doc_id < 60"), 20_000)))
    texts = ["bad thing", "good thing", "long"]
    assert len(whole.params) > 0 and np.array_equal(bounded.score(texts), without.score(texts))
    assert np.array_equal(toxicity.train(table, labels, nobody, fit_terms=0).score(texts), [0.5] * 3)


def test_margins_gather_few_parameters_at_once(monkeypatch):
    rng = np.random.default_rng(2)
    params = rng.normal(0, 0.1, (500, 9)).astype(np.float32)
    begin = np.cumsum(np.r_[0, rng.integers(0, 500, 4000)])
    at = rng.integers(0, 500, begin[-1])
    tracemalloc.start()
    try:
        got = toxicity.margins(params, at, begin)
        assert tracemalloc.get_traced_memory()[1] < at.nbytes  # the parameters of all are 36 bytes a term
    finally:
        tracemalloc.stop()
    for together in (1, 700, 1 << 30):
        monkeypatch.setattr(toxicity, "TOGETHER", together)
        assert all(np.array_equal(a, b) for a, b in zip(toxicity.margins(params, at, begin), got, strict=True))
    assert [len(x) for x in toxicity.margins(params, at[:0], np.zeros(1, int))] == [0, 0]


def test_a_fit_is_the_same_in_pieces_and_empties_its_rows(monkeypatch):
    rng = np.random.default_rng(4)
    rows_ = [np.sort(rng.choice(900, 20, replace=False)) for _ in range(120)]
    y = (rng.random(120) < 0.5).astype(float)
    results = []
    for together in (1 << 16, 7):
        monkeypatch.setattr(toxicity, "TOGETHER", together)
        given = list(rows_)
        results.append(toxicity.fit(given, y, 900, steps=20))
        assert given == []
    assert all(np.array_equal(a, b) for a, b in zip(*results, strict=True))


def test_training_holds_its_terms_once_until_the_batches_are_made(spark, monkeypatch):
    """The rows handed to the fit are all there is of its terms: nothing keeps them when the fit lets go. Repeated ids count each."""
    rng = random.Random(8)
    docs = [(i, words(rng, 30 + i)) for i in range(80)] + [(7, "another text"), (7, "another text"), (9, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    held, real = [], toxicity.fit

    def fit(x_rows, y, terms, first):
        held.append([len(y), weakref.ref(x_rows[0] if x_rows[0].base is None else x_rows[0].base)])
        real(list(x_rows), y, terms, first=first, steps=1)
        x_rows.clear()
        gc.collect()
        held[-1].append(held[-1][1]())
        return 0.0, np.zeros(terms), np.zeros((terms, 8))

    monkeypatch.setattr(toxicity, "fit", fit)
    toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels, F.lit(False))
    assert held[0][0] == 83 - int(0.15 * 83) and held[0][2] is None
