import corpus_pipeline
from quillstone.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    """Each stage's result is what a plain version of its decision leaves of its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        if k == len(corpus_pipeline.STAGES) - 1:
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(before)
            break
        assert out.columns == columns
        out = out.cache()
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert all(before[i] == t for i, t in after.items())
        if name == "exact":
            newest = {}
            for i, t in before.items():
                newest[t] = max(i, newest.get(t, -1))
            assert set(after) == set(newest.values())
        if name == "decontamination":
            assert set(after) == {i for i, t in before.items() if not any(x in t for x in items)}
        if name in ("toxicity", "near"):
            assert len(after) > 0.8 * len(before)
        docs = out


def test_all_queries_are_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 13)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact", "near", "decontamination", "packing"]


def test_stages_take_odd_tables(spark, weird, nothing, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns and empty tables, at every stage."""
    spark.createDataFrame([(0, 0), (6, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a question of five words? its answer of five words."), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    everything = [0, 1, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, None, None]
    kept = {"toxicity": everything, "exact": [1, 2, 4, 5, 6, 7, 8, 9], "near": [0, 3, 5, 6, 6, 7, 8, 9, None, None], "decontamination": everything}
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, weird, str(tmp_path)), stage(spark, nothing, str(tmp_path))
        assert none.count() == 0
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in weird.select("doc_id").distinct().collect()}
            continue
        assert out.columns == weird.columns and none.columns == weird.columns
        rows = out.collect()
        assert all(r["kept"] is True and r["hub"] == "h" for r in rows)
        assert sorted((r["doc_id"] for r in rows), key=str) == kept[name]
