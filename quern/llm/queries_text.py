"""Queries of the operators that read whole texts of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe_trie import encoding_digests
from quern.llm.language_bigru import identify_languages, train_language_model
from quern.llm.simhash_bktree import simhash_components


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary files are; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = train_language_model(docs.where(~held_out))
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op1_simhash": op1_simhash, "op9_bpe": op9_bpe, "op10_language": op10_language}
ORACLES: dict[str, str] = {}
