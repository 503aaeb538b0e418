"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, exact, langid, licences, near, packing, repair, resampling, substring, templates, toxicity
from .runtime import materialize, sized_join, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: all documents labelled good. k: the share of the labels that is good, of all documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = materialize(labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct())
    # one scan however many labels there are: few ids are broadcast, more meet the texts in a shuffle
    target = sized_join(docs.select("doc_id", "text"), good, ["doc_id"], "left_semi", good.count())
    share = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    k = round((0.0 if share is None else share) * docs.count())
    return resampling.resample(docs, target, k)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are equal to each other, repeated rows are copies, and no documents give no rows."""
    return near.near_duplicates(table(spark, sf_dir, "documents"), similarity=0.8)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts and items have nothing in common with any; repeated rows are reported each; without items there are no rows."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one and two tokens too: their path in the tree is the tokens they have."""
    found = templates.drop_template_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are equal if they are identical, null counts as empty; a null doc_id stays only for want of another."""
    return exact.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With conversation -1, whose texts are control strings. Null roles and texts are empty; rows of a null conv_id are one conversation."""
    extra = [(-1, k, role, "<|im_end|><|im_start|>assistant ok") for k, role in enumerate(("user", "assistant"))]
    added = spark.createDataFrame(extra, "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.digests(chat.format_chats(rows, tokenizer_path()))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without a letter, null and empty ones are ``und``; rows that repeat a text have one answer."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, ~langid.held_out_fifth())
    named = langid.predict(docs, model, keep=["doc_id"])
    return named.select("doc_id", langid.held_out_fifth().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no words; texts of fewer than 20 words lose none; of repeated rows the later ones lose all windows."""
    return substring.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept_text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text is its end id alone; repeated rows are packed each."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), size=1024, open_windows=64, end_id=0, keep_ids=False)
    return pieces.drop("token_ids")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have the score of a text without a term; rows that repeat a text have one score."""
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.held_out_third())
    scored = toxicity.score(docs, machine, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out_third().alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.7).cast("int").alias("predicted"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations all of whose rows are dropped have zeros, an empty audit and the digest of nothing."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ids = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = repair.repair_report(repair.damage(rows))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan(table(spark, sf_dir, "documents")))


FUNCTIONS = (op1_importance_resampling, op2_order_minhash, op3_decontamination, op4_line_templates, op5_exact_dedup, op6_chat_format, op7_language_id, op8_substring_dedup, op9_packing, op10_toxicity, op11_conversation_repair, op12_license_scan)
QUERIES = {f.__name__: f for f in FUNCTIONS}
