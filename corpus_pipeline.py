"""A training corpus from ``documents``: quality, repeated lines, near-duplicates, benchmark passages, token ids.

Each stage takes all rows that its predecessor kept and returns the columns of ``documents``; the last one adds the ids.
Rows with the same doc_id are treated as one document by the near-duplicate stage. Other columns than doc_id, text and
n_chars are passed through; n_chars follows the text where lines are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.llm import bpe, decontaminate, jaccard, lines, quality
from cellscore.llm.store import read_table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    own = docs.columns
    scored = quality.score_quality(docs, quality.train(docs, read_table(spark, sf_dir, "labels")), "_score")
    return scored.where(F.col("_score") >= quality.THRESHOLD).select(own)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, and documents of which nothing is left by that."""
    out = lines.drop_recurring_lines(docs)
    emptied = (F.col("_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    chars = F.when(F.col("_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.where(~emptied | F.col("text").isNull()).withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingles of five words at 0.8 or more the document with the smallest doc_id stays; rows
    without doc_id stay."""
    found = jaccard.jaccard_components(docs, n=5, percent=80)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    return docs.hint("merge").join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")  # the other side grows with the corpus


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty or more stands in benchmark passages go."""
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark")).withColumn("n_hit", decontaminate.hit_words())
    gone = written(found.where(decontaminate.contaminated()).select(F.col("doc_id").alias("_d"), F.col("key").alias("_key")).distinct(), "contaminated")
    return docs.hint("merge").join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_key")), "left_anti")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids (little-endian unsigned 32-bit integers) and n_tokens."""
    out = bpe.encode(docs, public_tokenizers.path(bpe.RANKS))
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("bigint"))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_recurring_lines),
    ("n-gram Jaccard join", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", token_ids),
]

#: No stage but the fourth can be written in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
