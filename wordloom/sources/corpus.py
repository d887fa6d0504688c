"""Reading corpora from JSON, and index tables from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wordloom.functions.grades import external_family
from wordloom.functions.similarity import phrase_confidence

VERSE = T.StructType([T.StructField("chapter", T.IntegerType()), T.StructField("verse", T.IntegerType()), T.StructField("text", T.StringType())])
GRADE = T.StructType([T.StructField("name", T.StringType()), T.StructField("grade", T.StringType())])
RECORD = T.StructType([
    T.StructField("hadithnumber", T.IntegerType()),
    T.StructField("arabicnumber", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("grades", T.ArrayType(GRADE)),
    T.StructField("reference", T.StructType([T.StructField("book", T.IntegerType()), T.StructField("hadith", T.IntegerType())])),
])
COMMENTARY = T.StructType([T.StructField("chapter", T.IntegerType()), T.StructField("verse", T.IntegerType()), T.StructField("tafsir", T.StringType())])
CHAPTER = T.StructType([
    T.StructField("chapter", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("englishname", T.StringType()),
    T.StructField("arabicname", T.StringType()), T.StructField("revelation", T.StringType()),
])


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document (plain or gzip) as rows; no rows where there is no such file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_verses(spark: SparkSession, path: str, root: str = "quran") -> DataFrame:
    """chapter, verse, text; texts that are missing are empty."""
    rows = read_json(spark, path, T.StructType([T.StructField(root, T.ArrayType(VERSE))]))
    return rows.select(F.inline(root)).withColumn("text", F.coalesce("text", F.lit("")))


def read_records(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """One collection's records: collection, number, arabic_number, text, grades, book, number_in_book.

    A number that comes again replaces the earlier record.
    """
    rows = read_json(spark, path, T.StructType([T.StructField("hadiths", T.ArrayType(RECORD))]))
    flat = rows.select(F.posexplode("hadiths").alias("seq", "r")).select("seq", "r.*")
    last = Window.partitionBy("hadithnumber").orderBy(F.desc("seq"))
    kept = flat.withColumn("rank", F.row_number().over(last)).where("rank = 1")
    return kept.select(
        F.lit(collection).alias("collection"), F.col("hadithnumber").alias("number"), F.coalesce("arabicnumber", F.col("hadithnumber").cast("string")).alias("arabic_number"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("grades", F.array().cast(T.ArrayType(GRADE))).alias("grades"),
        F.coalesce("reference.book", F.lit(0)).alias("book"), F.coalesce("reference.hadith", F.lit(0)).alias("number_in_book"),
    )


def read_commentary(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, COMMENTARY)


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """Chapter metadata, with the number where a name is missing."""
    rows = read_json(spark, path, T.StructType([T.StructField("chapters", T.ArrayType(CHAPTER))]))
    number = F.col("chapter").cast("string")
    return rows.select(F.inline("chapters")).select(
        "chapter", F.coalesce("arabicname", number).alias("arabic_name"), F.coalesce("englishname", "name", number).alias("english_name"), F.coalesce("revelation", F.lit("")).alias("revelation")
    )


def with_lookup(rows: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """Left lookup of a dimension by its keys; the optimiser broadcasts it where it is small."""
    return rows.join(dimension, keys, "left")


def check_counts(rows: DataFrame, expected: dict[str, int], key: str = "collection") -> DataFrame:
    """Expected and actual row counts that differ; raises when read if there are any."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(k, v) for k, v in expected.items()], f"{key} string, expected long")
    counts = rows.groupBy(key).agg(F.count("*").alias("actual"))
    return wanted.join(counts, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0))).withColumn(
        "ok", F.when(F.col("actual") == F.col("expected"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("wrong number of rows: "), F.col(key))))
    )


def write_index(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Writes an index table, clustered by its lookup columns so that scans skip most row groups."""
    out = df.repartition(*by).sortWithinPartitions(*by) if by else df
    out.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def external_items(items: DataFrame, details: DataFrame, most: int = 3) -> DataFrame:
    """The source's first ``most`` items per query with their details; items without details go."""
    first = Window.partitionBy("query_id").orderBy("seq")
    return items.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most).drop("rank").join(details, "id")


def external_records(items: DataFrame) -> DataFrame:
    """External items (query_id, id, query, title, text, attribution, grade) as matches of records."""
    score = phrase_confidence(F.col("query"), F.col("text"))
    return items.select(
        "query_id", F.concat(F.lit("external_"), F.col("id").cast("string")).alias("record_id"), "text", score.alias("confidence"),
        F.when(score >= 90, F.lit("matched")).otherwise(F.lit("close_match")).alias("state"), "attribution", F.col("grade"), external_family(F.col("grade")).alias("family"),
    )


def external_cards(items: DataFrame, score: float = 25.0) -> DataFrame:
    """External items as evidence cards with a fixed score."""
    return items.select("query_id", F.concat(F.lit("external_"), F.col("id").cast("string")).alias("doc_id"), F.col("text"), F.col("seq"), F.lit(score).alias("score"))
