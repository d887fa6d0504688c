"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import chat, decontaminate, near_dedup, phrase_dedup
from wordloom.llm.chat import conversation_digests
from wordloom.llm.decontaminate import contamination
from wordloom.llm.fingerprint import fingerprints
from wordloom.llm.language import fit, held_out, predictions
from wordloom.llm.licenses import oracle as license_sql
from wordloom.llm.licenses import scan
from wordloom.llm.mixing import mix, taken
from wordloom.llm.near_dedup import near_duplicates
from wordloom.llm.phrase_dedup import substring_dedup
from wordloom.llm.store import prepared
from wordloom.llm.toxicity import toxicity, train
from wordloom.llm.url_filter import filtered

#: The categories that ``labels`` has, in chain order.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(mix(_table(spark, sf_dir, "documents"))).drop("source")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return toxicity(documents, train(documents, _table(spark, sf_dir, "labels"), CATEGORIES), "toxic")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("blocked"))
    return filtered(_table(spark, sf_dir, "pages"), labels)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


#: What both rows of the added conversation -7 say.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return conversation_digests(rows.union(added))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = fit(documents.where(~held_out(F.col("doc_id"))))
    return predictions(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_toxicity": op2_toxicity,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_url_filter": op4_url_filter,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_fingerprints": op7_fingerprints,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_language_id": op10_language_id,
}

ORACLES: dict[str, str] = {
    "op3_benchmark_decontamination": decontaminate.oracle(),
    "op5_minhash_near_dedup": near_dedup.oracle(),
    "op6_license_scan": license_sql(),
    "op8_substring_dedup": phrase_dedup.oracle(),
    "op9_chat_formatting": chat.oracle(CONTROL_TEXT),
}
