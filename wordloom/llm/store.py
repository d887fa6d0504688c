"""Tables written to the shared checkpoint folder, to cut lineage durably."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.sources.staged import BROADCAST_ROWS, folder, limited, written

__all__ = ["BROADCAST_ROWS", "folder", "limited", "prepared", "unused", "written"]

#: Bytes of one Arrow batch between the JVM and Python, so that long texts need no more memory than short ones.
ARROW_BYTES = 4 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Bounds the session's Arrow batches by bytes; their default bound is for short rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
