"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import chat_format, hmm_lm, jaccard_join, language_id, media_chunks, packing, sentencepiece_sampling, substring_dedup, vector_dedup, warc
from evalloom.llm.sql import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(_table(spark, sf_dir, "documents"))


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sampled segmentations of every document."""
    rows = sentencepiece_sampling.sampled(_table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("doc_id", "sample", "n_pieces", F.round("log_prob", 9).alias("log_prob"), F.round("inclusion", 9).alias("inclusion"), "ids_sha256", "decoded")


def op3_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.read_back(media_chunks.store(_table(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows as records of four layouts, dealt by a hash, which the fingerprints tell apart again; conversation -7 holds control strings."""
    same = r"\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", same), (-7, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    rows = rows.unionByName(probe)
    role, text, deal = F.col("role"), F.col("text"), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    as_json = lambda *fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    listed = lambda name, who, what: as_json(F.array(F.struct(role.alias(who), text.alias(what))).alias(name))
    record = (
        F.when(deal == 1, listed("messages", "role", "content"))
        .when((deal == 2) & ~F.coalesce(role, F.lit("")).isin(list(chat_format.ROLES)), listed("conversations", "from", "value"))  # those names would be translated
        .when((deal == 3) & (role == "user"), as_json(text.alias("prompt")))
        .otherwise(as_json("conv_id", "turn", "role", "text"))
    )
    records = rows.select("conv_id", "turn", record.alias("record"))
    return chat_format.read_back(chat_format.format_turns(chat_format.canonical_turns(records)))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(_table(spark, sf_dir, "documents"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_predictions(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_report(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archive(warc.write_archive(_table(spark, sf_dir, "pages")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hmm_lm": op1_hmm_lm,
    "op2_sentencepiece_sampling": op2_sentencepiece_sampling,
    "op3_media_chunks": op3_media_chunks,
    "op4_packing": op4_packing,
    "op5_chat_format": op5_chat_format,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_warc": op10_warc,
}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
