"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of documents; a stage's result is written as Parquet and read again as the next one's
docs.

Every stage takes any ``documents`` table: null and empty texts, texts of any length, repeated rows and further
columns of any name, which it hands on as they are; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontamination, exact, near, packing, toxicity
from quillstone.llm.queries import tokenizer_path
from quillstone.llm.runtime import materialize, table

#: Documents that score as much are rejected.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below TOXIC, judged by their text alone; a null or empty text is one without a term.

    Rows that repeat a text share its fate. Without labels nothing is learned and all rows stay.
    """
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.held_out_third())
    return toxicity.reject(docs, machine, TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the largest doc_id; null counts as empty, a null doc_id stays only for want of another."""
    return exact.drop_exact_duplicates(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.

    Rows that share a doc_id stay or go together and a null doc_id stays; null and empty texts are equal to each other.
    """
    return near.drop_near_duplicates(docs, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item stands; null and empty texts and items have nothing in common, all rows stay without items."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 1024 tokens; a null or empty text is its end token alone, repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path(), size=1024, open_windows=64, end_id=0)


STAGES = [("toxicity", drop_toxic), ("exact", drop_copies), ("near", drop_near_copies), ("decontamination", drop_benchmark), ("packing", pack)]
#: A trained model and a tokenizer are no SQL: tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``: the rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
