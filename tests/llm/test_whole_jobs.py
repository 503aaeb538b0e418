"""The registered queries leave out no part of their job."""

import random

from quillstone.llm import decontamination, queries, runtime

from .conftest import words


def save(spark, home, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{home}/{name}.parquet")


def test_short_lines_are_dropped_too(spark, tmp_path):
    docs = [(i, f"Les.\nread {i} own{i}x\nAnd ornd.\nalone{chr(97 + i)}") for i in range(10)] + [(10, "rare\nLes."), (11, "rare")]
    save(spark, tmp_path, "documents", docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in queries.op4_line_templates(spark, str(tmp_path)).collect()}
    assert got == {**{i: (4, 2) for i in range(10)}, 10: (2, 1), 11: (1, 0)}


def test_long_items_leak_by_their_whole_question_and_answer(spark):
    rng = random.Random(12)
    items = [(n, words(rng, n)) for n in (129, 131, 300)] + [(5, words(rng, 20))]
    docs, want = [], set()
    for n, text in items[:3]:
        w = text.split()
        whole = " ".join([words(rng, 170), text, words(rng, 90)])
        for kind, t in enumerate((whole, w[-1], " ".join(w[-4:]), words(rng, 50) + " " + w[-1] + " " + words(rng, 50), " ".join(w[:128]) if n == 300 else " ".join(w[: n * 3 // 4]), " ".join(w[-(n // 4) :]))):
            docs.append((n * 10 + kind, t))
        want.add((n * 10, n))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(abs(r["score"] - 1) < 1e-9 for r in got)


def test_target_model_counts_every_good_document(spark, tmp_path, monkeypatch):
    save(spark, tmp_path, "documents", [(i, f"text w{i}") for i in range(20_050)], "doc_id long, text string")
    save(spark, tmp_path, "labels", [(i, 1) for i in range(20_020)] + [(3, 1), (20_030, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(queries.resampling, "resample", lambda docs, target, k: seen.append(target))
    for most in (30_000, 9000):  # ids are broadcast, and shuffled
        monkeypatch.setattr(runtime, "BROADCAST_ROWS", most)
        queries.op1_importance_resampling(spark, str(tmp_path))
        assert sorted(r["doc_id"] for r in seen.pop().collect()) == list(range(20_020))


def test_a_question_alone_is_no_leak_at_any_length(spark):
    rng = random.Random(21)
    for n in (20, 80, 240, 1000):
        question, answer = words(rng, n * 3 // 4) + "?", words(rng, n // 4) + "."
        bench = spark.createDataFrame([(1, f"{question} {answer}")] + [(k, words(rng, 30)) for k in range(2, 9)], "item_id long, text string")
        docs = spark.createDataFrame([(0, f"{words(rng, 50)} {question} {words(rng, 400)}"), (1, f"{words(rng, 77)} {question} {answer} {words(rng, 300)}"), (2, answer)], "doc_id long, text string")
        assert [(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()] == [(1, 1)]


def test_passes_over_the_benchmark_change_nothing(spark, monkeypatch):
    """Passages that share most words with items, but not all: scores and hits are those of one index."""
    rng = random.Random(22)
    vocabulary = [words(rng, 1) for _ in range(50)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 120)))) for i in range(50)]
    docs = []
    for i in range(60):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)) + w)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted((r["doc_id"], r["item_id"], round(r["score"], 9), r["question_overlap"], r["answer_overlap"]) for r in decontamination.leaks(df, bench, overlap=0.3).collect())
    one = found()
    monkeypatch.setattr(decontamination, "INDEX_WORDS", 250)
    assert len(one) > 20 and any(r[2] < 0.99 for r in one) and found() == one


def test_bounds_are_kept_in_parts(monkeypatch):
    rng = random.Random(23)
    vocabulary = [words(rng, 1) for _ in range(40)]
    index = decontamination.Index([(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 60)))) for i in range(80)], 5)
    hashes, at = decontamination.word_hashes([" ".join(rng.choices(vocabulary, k=30)) for _ in range(40)])
    owner = [i for i in range(40) for _ in range(at[i + 1] - at[i])]
    whole = index.bounds(decontamination.np.array(owner), index.lookup(hashes), 40)
    monkeypatch.setattr(decontamination, "SUMMED", 7)
    assert decontamination.np.allclose(whole, index.bounds(decontamination.np.array(owner), index.lookup(hashes), 40))
