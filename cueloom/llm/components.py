"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.storage import materialize, new_path, remove


def _stars(edges: DataFrame) -> bool:
    """Whether each larger end u has one link, to a node that is no larger end: then that is its component's smallest."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("larger")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("larger").alias("larger"), F.count("*").alias("n")).filter("larger > 0 and n > 1").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``links``; the component is its smallest node.

    Large-star and small-star steps in turn: every node hands the smallest node it sees to its
    larger, then to its smaller neighbours, until the links are a star for each component, in about
    log(n) rounds. Smallest neighbours are pre-aggregated before the shuffle and dealt anew for the
    join, whose two sides then are plain shuffles: so a hub's links can be split over tasks. The filter
    for null drops nothing; it makes both reads of the smallest equal plans, so Spark shuffles them once.
    Each round is written in the shared folder and the one before removed; nothing but whether a
    node is left to move comes to the driver. Null ends and loops are ignored.
    """
    spark = links.sparkSession
    named = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    valid = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))
    path = new_path(spark, "links")
    edges = materialize(named.filter(valid).distinct(), path=path)
    while not _stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition("u", "m")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).filter("u is not null and m is not null").repartition("u", "m")
        kept = lowest.select("u", F.col("m").alias("v"))
        moved = large.join(lowest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, path = path, new_path(spark, "links")
        edges = materialize(kept.union(moved).distinct(), path=path)
        remove(spark, old)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
