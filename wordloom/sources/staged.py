"""Tables written to the shared checkpoint folder, so that what several branches read is computed once and survives lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where one machine runs everything and the session names no folder.
LOCAL_FOLDER = "/tmp/checkpoints/wordloom"
#: Rows of ids that may be broadcast (about 40 MB in memory); more are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session whose master is local may go without; a cluster must name it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{LOCAL_FOLDER}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    The copy survives the loss of executors; the folder's owner clears it, as
    with any checkpoint.
    """
    path = f"{folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def limited(written_ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a written table of ids for broadcast if its counted size allows it."""
    return F.broadcast(written_ids) if written_ids.count() <= rows else written_ids
