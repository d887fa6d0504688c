"""The training-data pipeline: documents in, their mix by source out.

Stages, each on what the one before kept:

1. ``language``: documents whose language cannot be told go.
2. ``near_dedup``: one document of each near-duplicate group stays.
3. ``substring_dedup``: words repeated from an earlier document go; a document
   that loses all of them goes.
4. ``decontaminate``: documents that hold a benchmark window go.
5. ``mix``: per document that the mix draws, how many of its words it takes.

All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.decontaminate import decontaminated
from wordloom.llm.language import fit, identified
from wordloom.llm.mixing import mix, taken
from wordloom.llm.near_dedup import one_of_each
from wordloom.llm.phrase_dedup import deduplicated
from wordloom.llm.store import prepared, written

#: Least Jaccard similarity of near copies in the stage; 85 is op5's alone.
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return identified(docs, fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return one_of_each(docs, percent=NEAR_PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return deduplicated(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return taken(mix(docs)).where("taken > 0").select("doc_id", "source", "size", "source_size", F.col("target"), "taken")


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
]

#: Viterbi, shingle components and the mix's draws have no SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
