"""The corpus pipeline: language ID, near-duplicate removal, repeated passages, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import jaccard_join, language_id, packing, substring_dedup
from evalloom.runtime import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter, or no language that the classifier supports) go."""
    return language_id.keep_known(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more, that of the smallest id stays."""
    return jaccard_join.keep_one(docs, size=5, percent=80)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a window of 20 words that occurs earlier go; texts that lose all their words go, too."""
    out = substring_dedup.drop_repeats(docs, size=20)
    out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.where(F.col("text").rlike(r"[^ \t-\r]")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 ids, sources in proportion."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("packing", packed),
]

#: SQL has neither the classifier nor the tokenizer; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
