"""Inverted indexes as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions.core import words
from wordloom.functions.normalize import alef_invariant, normalize_arabic, normalize_english, strip_chain, strip_formulas
from wordloom.functions.tokens import bigrams, index_tokens


def indexed_verses(verses: DataFrame, language: str) -> DataFrame:
    """chapter, verse, text, norm, alef and the words of norm; the alef form is norm itself in English."""
    norm = normalize_arabic(F.col("text")) if language == "ar" else normalize_english(F.col("text"))
    out = verses.withColumn("norm", norm)
    return out.withColumn("alef", alef_invariant(F.col("norm")) if language == "ar" else F.col("norm")).withColumn("words", words(F.col("norm")))


def word_stream(verses: DataFrame) -> DataFrame:
    """chapter, verse, place (in the verse), g (in the chapter), word: words run on across verse ends.

    ``verses`` has chapter, verse and words and, if any, raw: the words' spellings,
    which the stream then has too.  Places come from the verses' word counts, so
    that only one row per verse is ranked, not every word.
    """
    before = Window.partitionBy("chapter").orderBy("verse").rowsBetween(Window.unboundedPreceding, -1)
    based = verses.withColumn("base", F.coalesce(F.sum(F.size("words")).over(before), F.lit(0)))
    raw = ["raw"] if "raw" in verses.columns else []
    rows = based.select("chapter", "verse", "base", *raw, F.posexplode("words").alias("place", "word"))
    return rows.select("chapter", "verse", "place", (F.col("base") + F.col("place")).alias("g"), "word", *[F.get("raw", "place").alias("raw") for _ in raw])


def stream_bigrams(verses: DataFrame) -> DataFrame:
    """chapter, verse, place, first, second: neighbours within a verse."""
    at = F.sequence(F.lit(0), F.size("words") - 2)
    return verses.where(F.size("words") > 1).select("chapter", "verse", "words", F.explode(at).alias("place")).select(
        "chapter", "verse", "place", F.get("words", "place").alias("first"), F.get("words", F.col("place") + 1).alias("second")
    )


def record_index(records: DataFrame, key: list[str]) -> DataFrame:
    """Records with text: full words, body words, the chain's share and length in words."""
    norm = strip_formulas(normalize_arabic(F.col("text")))
    split = records.where("text <> ''").withColumn("norm", norm).withColumn("body", strip_chain(F.col("norm")))
    return split.select(*key, words(F.col("norm")).alias("full"), words(F.col("body.matn")).alias("matn"), F.col("body.ratio").alias("ratio"), F.col("body.offset").alias("offset"))


def record_bigrams(records: DataFrame, key: list[str], tokens: Column) -> DataFrame:
    """Postings of pairs of neighbours: one row per record and distinct pair."""
    return records.select(*key, F.explode(bigrams(tokens)).alias("bigram"))


def search_documents(verses: DataFrame, records: DataFrame) -> DataFrame:
    """Verses and records as one table: doc_id, doc_type, arabic, english, commentary."""
    v = verses.select(F.concat_ws("_", F.lit("ayah"), "chapter", "verse").alias("doc_id"), F.lit("ayah").alias("doc_type"), "arabic", "english", "commentary")
    r = records.select(F.concat_ws("_", "collection", "number").alias("doc_id"), F.lit("hadith").alias("doc_type"), "arabic", "english", F.lit(None).cast("string").alias("commentary"))
    return v.unionByName(r)


def zip_by_place(left: DataFrame, right: DataFrame, by: str, order: str) -> DataFrame:
    """Pairs rows of two tables by their place within ``by``; right columns get the suffix _other."""
    ranked = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    other = ranked(right)
    other = other.select(by, "_n", *[F.col(c).alias(f"{c}_other") for c in right.columns if c != by])
    return ranked(left).join(other, [by, "_n"], "left").drop("_n")


def postings(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document and distinct token."""
    tokens = index_tokens(F.col("arabic"), F.col("english"), F.col("commentary"))
    return documents.select(key, F.explode(tokens).alias("token"))


def latin_postings(documents: DataFrame, key: str, text: str) -> DataFrame:
    tokens = F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= 3))
    return documents.select(key, F.explode(tokens).alias("token"))


def document_frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("token").agg(F.count("*").alias("df"))


def collection_counts(records: DataFrame, by: str) -> DataFrame:
    """Rows per collection, and of all (null)."""
    return records.rollup(by).agg(F.count("*").alias("n"))
