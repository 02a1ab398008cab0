"""Connected components of a table of links, by rounds of joins; each round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import written


def components(spark: SparkSession, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: a, b (long) -> node, component (the smallest node reachable), for nodes with a link.

    Alternates two moves until nothing changes: every node hands its larger neighbours to its smallest one, then its smaller
    neighbours to its smallest one. Each keeps the components and brings every node nearer to a star around the smallest; the
    rounds grow with the logarithm of the longest path. A node's neighbours are aggregated to their minimum before they
    are shuffled, and joins of a node with many neighbours can be split, so no task holds a component.
    """
    edges = written(spark, links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    check = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    before = check(edges)
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b")
        large = written(spark, large.where("a <> b").distinct(), "links-large")
        low = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("n"), "m")
        small = large.join(low, F.col("b") == F.col("n")).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        new = written(spark, small.where("a <> b").distinct(), "links-small")
        edges, now = new, check(new)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
