"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every vertex of ``edges`` ``(a, b)``; the component is its smallest id.

    Every step writes its edges, so no lineage grows and a lost executor costs one step.  Minima are
    pre-aggregated; joins to a vertex with very many edges can be split, as both sides are scans.
    No table leaves the executors; the loop ends when count and checksum of the edges stand still.
    """
    current = stage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    last = None
    while True:
        seen = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if last == seen or not seen["n"]:
            break
        last = seen
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "minima")
        large = stage(
            both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(),
            "large-stars",
        )
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        tied = large.join(least, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        current = stage(small.where("u <> v").distinct(), "small-stars")
    leaves = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return leaves.unionByName(roots)
