"""One query per training-data operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromalyne.llm import decontaminate, fingerprint_index, language, media, near_dedup, oracles, packing, quality, sharding, toxicity, urls
from chromalyne.llm.common import crc_rest, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op3_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs))
    return found.select("doc_id", (crc_rest("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "known", "rejected")


def op4_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.tag_toxicity(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0)
    return found.select("doc_id", (crc_rest("doc_id", 3) == 1).alias("held_out"), "score", predicted.alias("predicted"), "n_toxic_words", F.size("spans").alias("n_spans"))


def op5_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_index.dedup_substrings(table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=1)


NEAR = near_dedup.NearParams(words=3, numerator=85, denominator=100)


def op7_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), NEAR)


def op8_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.audio_features(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        media.feature_digest().alias("feature"),
    )


#: The rules of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = urls.filter_urls(table(spark, sf_dir, "pages"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op10_empirical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    evidence = quality.learn(docs, table(spark, sf_dir, "labels"))
    found = quality.score_quality(docs, evidence, host=F.col("source"), path=F.col("lang"))
    return found.withColumn("held_out", crc_rest("doc_id", 3) == 1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spaced_seeds": op1_spaced_seeds,
    "op2_jump_sharding": op2_jump_sharding,
    "op3_subword_language": op3_subword_language,
    "op4_crf_toxicity": op4_crf_toxicity,
    "op5_fingerprint_index": op5_fingerprint_index,
    "op6_histogram_packing": op6_histogram_packing,
    "op7_bayes_minhash": op7_bayes_minhash,
    "op8_audio_features": op8_audio_features,
    "op9_redirect_equivalence": op9_redirect_equivalence,
    "op10_empirical_bayes": op10_empirical_bayes,
}
ORACLES: dict[str, str] = {
    "op5_fingerprint_index": oracles.OP5,
    "op7_bayes_minhash": oracles.OP7,
    "op9_redirect_equivalence": oracles.op9(RULES),
}
