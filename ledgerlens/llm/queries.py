"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    conversations, decontamination, knn, line_quality, mixing, packing, page_text, personal_data, resampling, simhash, token_counts, toxicity,
    url_filter,
)
from ledgerlens.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]

BASE_KINDS = ("email", "ip", "card", "phone")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return page_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best matches of every twentieth vector."""
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Tokens of every document under a vocabulary file of pieces and ranks."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.count_documents(table(spark, sf_dir, "documents"), token_counts.rank_costs(vocabulary))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    model = line_quality.train(docs, table(spark, sf_dir, "labels"))
    scored = line_quality.score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= line_quality.KEEP_FROM).cast("int").alias("predicted")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.classify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    found = decontamination.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("matched").cast("long").alias("n_items"),
        _sha256(F.array_join("matched", ",")).alias("items_sha256"), "contaminated",
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; counts are of the base kinds."""
    found = personal_data.find_spans(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [(F.size("found") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(
        "doc_id", *counts, _sha256(personal_data.digest(base)).alias("base_sha256"), personal_data.digest(F.col("found")).alias("spans")
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def word_count(text: Column) -> Column:
    """Words between white space, the unit of packing; null and empty texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("long")


def packed(docs: DataFrame) -> DataFrame:
    """Parts of ``docs`` in bins; equal texts are a cluster."""
    return packing.pack(docs, word_count(F.col("text")), F.col("source"), F.xxhash64("text"))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's parts in bins of fixed capacity."""
    return packed(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page's URL."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def mixed(docs: DataFrame, **settings) -> mixing.Mix:
    """``docs`` mixed by source; the text tells rows of one key apart."""
    return mixing.mix(docs, word_count(F.col("text")), F.col("source"), F.xxhash64("text"), **settings)


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in a mix of all sources."""
    return mixed(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document towards the benchmark, and the documents drawn."""
    found = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after planted damage."""
    return conversations.summarize(conversations.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Query]:
    """By name, in the order of the operators."""
    return {
        f.__name__: f
        for f in (
            op1_page_text, op2_voronoi_top_k, op3_token_counts, op4_line_quality, op5_simhash,
            op6_decontamination, op7_personal_data, op8_toxicity, op9_best_fit, op10_url_filter,
            op11_source_mix, op12_importance_resampling, op13_conversation_repair,
        )
    }
