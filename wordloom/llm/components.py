"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.store import written

#: Edges whose least neighbours may be broadcast (about 100 MB in memory).
BROADCAST_EDGES = 500_000


def connected(edges: DataFrame) -> DataFrame:
    """The least id reachable from each id that has an edge: id, component.

    Alternates large-star and small-star steps (Kiveris et al. 2014), which
    keep the number of edges and end after about log(n) rounds; each round is
    written out, so a lost executor repeats one round at most.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    while not _stars(now):
        # Counted as few, the least neighbours go to the edges, whose hubs then need no task of their own.
        near = F.broadcast if now.count() <= BROADCAST_EDGES else lambda df: df
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(near(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        now = written(large.join(near(least), "u").select(F.explode(pairs).alias("e")).select("e.*").where("u <> v").distinct(), "cc")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every id has one edge, to an id that has none to a lesser one."""
    both = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()
