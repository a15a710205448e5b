"""A training corpus from `documents` in five stages, each the production operator of chromalyne.llm on all that the stage before kept.

All stages but the last return the columns they got, in their order, whatever other columns there are and however they
are named: operators see the key and the text alone, other columns are carried unseen or joined back by the key. Keys
are whole numbers. Null and empty texts are clean documents without words: they pass every filter and are packed as one
end id. Rows with a null key pass the second to fourth stages untouched. Long texts are read whole. Empty tables stay
empty. What rows that repeat a key become is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromalyne.llm import decontaminate, fingerprint_index, near_dedup, packing, toxicity
from chromalyne.llm.common import table, written
from chromalyne.llm.queries import tokenizer_path

TOXIC_SCORE = 0.7
NEAR = near_dedup.NearParams(words=5, numerator=80, denominator=100)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is not among ids; rows with a null doc_id stay. The ids grow with the input, so they are not broadcast."""
    return docs.join(ids.select(F.col("doc_id").alias("__gone")).distinct().hint("shuffle_hash"), docs["doc_id"] == F.col("__gone"), "left_anti")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of TOXIC_SCORE or more go. The tagger learns from labels of this stage's documents.

    Every row is judged by its own text, rows with a null key too; a score of exactly TOXIC_SCORE goes."""
    tagger = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.tag_toxicity(docs, tagger, carry=True).where(F.col("score") < TOXIC_SCORE).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component over shingles of five words and a similarity of 0.8 the document with the smallest doc_id stays.

    Rows that repeat a key are one document: all stay or all go."""
    return _without(docs, near_dedup.near_duplicates(docs, NEAR).where(~F.col("kept")))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 13 words or more that a document with a smaller doc_id has too go; n_chars follows the text.

    Every row stays, if only with an empty text. Rows that repeat a key are trimmed each by its own words."""
    found = fingerprint_index.dedup_substrings(docs, carry=True)
    own = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go. Rows that repeat a key all go if one of them overlaps."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece. Every row is packed, repeated ones and those with a null key too."""
    return packing.pack_documents(docs, tokenizer_path(), capacity=2048, end_id=1)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substrings),
    ("decontamination", benchmark_leaks),
    ("packing", pack),
]

#: run()'s rows come from a trained tagger and a tokenizer, which SQL can't express; tests hold the stages to plain
#: computations on their own inputs (the second and third are the operators of op7 and op5, which have SQL).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
