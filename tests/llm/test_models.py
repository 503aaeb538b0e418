import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import decontamination, langid, resampling, toxicity

from .conftest import rows, words


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    langs = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    out = []
    for i in range(n):
        lang = rng.choice(sorted(langs))
        text = [" ".join("".join(rng.choices(langs[lang], k=rng.randint(2, 6))) for _ in range(rng.randint(10, 60)))][0].split()
        toxic, pair = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["vilexa", "vilexo"]))
        out.append((i, " ".join(text), lang, int(toxic), int(pair)))
    return out


def held(i, m, r):
    return zlib.crc32(str(i).encode()) % m == r


def test_language_is_learned_and_texts_alone_decide(spark, weird, nothing):
    docs = spark.createDataFrame([r[:3] for r in corpus()], "doc_id long, text string, lang string")
    model = langid.train(docs, ~langid.held_out_fifth())
    got = {r["doc_id"]: r for r in langid.predict(docs.withColumn("lang", F.lit("zz")), model).collect()}
    right = [got[i]["lang_pred"] == lang for i, _, lang, _, _ in corpus() if held(i, 5, 0)]
    assert len(right) > 40 and np.mean(right) > 0.97
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    odd = {r["doc_id"]: r for r in langid.predict(weird, model).collect()}
    assert odd[3]["lang_pred"] == odd[4]["lang_pred"] == odd[5]["lang_pred"] == "und" and odd[3]["lang_score"] == 0
    assert odd[9]["lang_pred"] in model.languages and odd[6]["lang_pred"] in model.languages
    assert langid.predict(nothing, model).count() == 0
    none = langid.train(nothing, F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(weird, none).collect()} == {"und"}


def test_ngrams_against_slow_counting():
    texts = ["ab-c", "", "123", "Zz"]
    got = dict(langid.ngrams(texts))
    assert set(got) == {0, 3}
    assert len(got[0]) == 4 + 3 + 2 and len(got[3]) == 2 + 1
    alone = dict(langid.ngrams(["Zz"]))
    assert np.array_equal(np.sort(alone[0]), np.sort(got[3]))


def test_temperature_reduces_the_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400)
    z = 8 * (np.eye(3)[np.where(rng.random(400) < 0.3, rng.integers(0, 3, 400), y)])
    t = langid.temperature(z, y)
    loss = lambda t: -np.log(langid.softmax(z / t)[np.arange(400), y]).mean()
    assert t > 1 and loss(t) < loss(1.0)


def test_toxicity_learns_terms_and_leaves_clean_texts(spark, weird, nothing):
    data = corpus(900)
    docs = spark.createDataFrame([(r[0], r[1]) for r in data], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in data] + [(None, 1), (5, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels, toxicity.held_out_third())
    got = {r["doc_id"]: r["toxicity_score"] for r in toxicity.score(docs, machine, keep=["doc_id"]).collect()}
    kept = {r["doc_id"] for r in toxicity.reject(docs, machine, 0.7).collect()}
    test = [r for r in data if held(r[0], 3, 1)]
    assert len(test) > 200
    assert np.mean([(got[r[0]] >= 0.7) == bool(r[3]) for r in test]) > 0.97
    assert kept == {i for i, s in got.items() if s < 0.7}
    odd = toxicity.reject(weird, machine, 0.7)
    assert odd.schema == weird.schema and {r["doc_id"] for r in odd.collect()} >= {r[0] for r in rows()} - {6}
    assert toxicity.reject(nothing, machine, 0.7).count() == 0
    blank = toxicity.train(docs, labels.limit(0), toxicity.held_out_third())
    assert {r["toxicity_score"] for r in toxicity.score(weird, blank, keep=["doc_id"]).collect()} == {0.5}


def test_factors_learn_a_pair_that_linear_weights_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3)) < 0.5
    y = (x[:, 0] == x[:, 1]).astype(float)  # no linear weight helps
    bias, w, v = toxicity.fit([np.flatnonzero(r) for r in x], y, 3, factors=4, epochs=120, rate=0.1)
    z = bias + x @ w + 0.5 * (((x @ v) ** 2).sum(axis=1) - x @ (v**2).sum(axis=1))
    assert np.mean((z > 0) == y) > 0.95


def test_resampling_prefers_the_target_and_keeps_exactly_k(spark, weird, nothing):
    rng = random.Random(6)
    good = [(i, " ".join(rng.choices("red green blue sky sea".split(), k=40))) for i in range(100)]
    bad = [(100 + i, " ".join(rng.choices("foo bar baz qux red".split(), k=40))) for i in range(100)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    target = docs.where("doc_id < 50")
    for k in (0, 1, 77, 100, 200, 500):
        got = resampling.resample(docs, target, k).collect()
        chosen = {r["doc_id"] for r in got if r["selected"]}
        assert len(got) == 200 and len(chosen) == min(k, 200)
        assert len(chosen & set(range(100))) == min(k, 100)
    again = {r["doc_id"] for r in resampling.resample(docs.repartition(7), target, 77).collect() if r["selected"]}
    assert again == {r["doc_id"] for r in resampling.resample(docs, target, 77).collect() if r["selected"]}
    odd = resampling.resample(weird, target, 5).collect()
    assert len(odd) == len(rows()) and sum(r["selected"] for r in odd) == 5
    assert resampling.resample(nothing, target, 3).count() == 0
    ties = spark.createDataFrame([(1, "x")] * 9 + [(None, None)] * 4, "doc_id long, text string")
    assert sum(r["selected"] for r in resampling.resample(ties, ties, 6).collect()) == 6


def test_gumbel_keys_sample_in_proportion_to_weights():
    """Largest key wins with probability w / sum(w): the noise is Gumbel."""
    rng = np.random.default_rng(0)
    w = np.array([1.0, 2.0, 5.0])
    keys = np.log(w) - np.log(-np.log(rng.random((40_000, 3))))
    assert np.allclose(np.bincount(keys.argmax(axis=1)) / 40_000, w / w.sum(), atol=0.01)


def bm25_by_force(items, passage):
    """Scores of all items against a passage, over their own."""
    import math

    texts = [t.lower().split() for t in items]
    n, mean = len(texts), sum(map(len, texts)) / len(texts)
    df = {w: sum(w in t for t in texts) for t in texts for w in t}
    part = lambda w, t: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
    return [sum(part(w, t) for w in set(t) & set(passage)) / sum(part(w, t) for w in set(t)) for t in texts]


def test_search_returns_all_items_above_the_threshold():
    rng = random.Random(4)
    vocabulary = [words(rng, 1) for _ in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 30)))) for i in range(50)]
    index = decontamination.Index(items, 5)
    for _ in range(60):
        passage = rng.choices(vocabulary, k=40) + rng.choice(items)[1].split()
        found, _ = decontamination.word_hashes([" ".join(passage)])
        terms = np.unique(index.lookup(found))
        got = dict(index.search(terms[terms >= 0], 0.7))
        want = {i: s for i, s in enumerate(bm25_by_force([t for _, t in items], passage)) if s >= 0.7}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
        assert index.bounds(np.zeros(len(terms), int), terms, 1).max() >= max(bm25_by_force([t for _, t in items], passage)) - 1e-5


def test_leaks_are_found_wherever_they_stand(spark, weird, nothing):
    rng = random.Random(9)
    items = [(i, ". ".join(words(rng, rng.randint(4, 25)) for _ in range(rng.randint(1, 3))) + ".") for i in range(30)] + [(50, words(rng, 300)), (51, None), (52, "!!"), (1, None)]
    docs, want = [], set()
    for i in range(150):
        text = words(rng, rng.randint(0, 300)).split()
        if rng.random() < 0.4:
            item, passage = rng.choice(items[:31])
            text.insert(rng.randint(0, len(text)), passage.upper() if rng.random() < 0.3 else passage)
            want.add((i, item))
        docs.append((i, " ".join(text)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(df, bench).collect()} == want
    assert {r["doc_id"] for r in decontamination.drop_leaks(df, bench).collect()} == set(range(150)) - {i for i, _ in want}
    question_only = spark.createDataFrame([(0, decontamination.split_item(items[0][1])[0])], "doc_id long, text string")
    if len(items[0][1].split(". ")) > 1:
        assert decontamination.leaks(question_only, bench).count() == 0
    assert decontamination.leaks(weird, bench).count() == 0 and decontamination.drop_leaks(weird, bench).schema == weird.schema
    assert decontamination.leaks(nothing, bench).count() == 0 == decontamination.leaks(df, bench.limit(0)).count()
    assert decontamination.drop_leaks(df, bench.limit(0)).count() == 150


def test_several_passes_over_a_large_benchmark(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, words(rng, 20)) for i in range(40)]
    docs = spark.createDataFrame([(i, words(rng, 9) + " " + t) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "INDEX_WORDS", 250)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()} == {(i, i) for i, _ in items}


def test_languages_of_tables_with_clashing_columns(spark, weird):
    model = langid.train(spark.createDataFrame([r[:3] for r in corpus(60)], "doc_id long, text string, lang string"), F.lit(True))
    odd = weird.withColumnRenamed("line", "lang_pred").withColumnRenamed("hub", "lang_score").withColumnRenamed("doc", "_source_text")
    got = langid.predict(odd, model)
    assert sorted(got.columns) == sorted(odd.columns) and dict(got.dtypes)["lang_score"] == "double" and got.count() == len(rows())
