import zlib

import pytest
from pyspark.sql import functions as F

from oracle import SF, both
from quillstone.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_equals_its_statement(spark, name):
    got, want = both(spark, queries.QUERIES[name], sql.SQL[name])
    assert got == want


def held(column, m, r):
    return F.crc32(F.col(column).cast("string").cast("binary")) % m == r


def test_contracts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    named = queries.op7_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r["doc_id"] for r in named} == ids and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in named)
    assert sum(r["lang_pred"] == r["lang"] for r in named if r["held_out"]) >= 0.9 * sum(r["held_out"] for r in named)
    scored = queries.op10_toxicity(spark, SF).collect()
    assert {r["doc_id"] for r in scored} == ids and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in scored)
    chosen = queries.op1_importance_resampling(spark, SF)
    share = spark.read.parquet(f"{SF}/labels.parquet").agg(F.avg("quality")).first()[0]
    assert chosen.count() == len(ids) and chosen.where("selected").count() == round(share * len(ids))
    near = queries.op2_order_minhash(spark, SF).collect()
    assert {r["doc_id"] for r in near} == ids and sum(r["kept"] for r in near) == len({r["class_id"] for r in near})
    packed = queries.op9_packing(spark, SF)
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == len(ids)
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert fill.where("n <> end OR n > 1024").count() == 0
    assert fill.where("n <> 1024 AND n NOT IN (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)").count() == 0


def test_labels_of_held_out_rows_change_nothing(spark, monkeypatch):
    """Scores are the same whatever the held-out labels and all languages of held-out rows say."""
    real = queries.table

    def turned(spark_, sf, name):
        df = real(spark_, sf, name)
        if name == "labels":
            return df.withColumn("toxic", F.when(held("doc_id", 3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic")))
        if name == "documents":
            return df.withColumn("lang", F.when(held("doc_id", 5, 0), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
        return df

    before = [sorted(map(tuple, q(spark, SF).collect())) for q in (queries.op7_language_id, queries.op10_toxicity)]
    monkeypatch.setattr(queries, "table", turned)
    after = [sorted(map(tuple, q(spark, SF).collect())) for q in (queries.op7_language_id, queries.op10_toxicity)]
    assert before == after
