"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, durable, spread_join


def is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node but the centres has one edge, to a centre, as rows ``u, v`` with ``v`` below ``u``."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    return not twice and not spread_join(edges, edges.select(F.col("u").alias("v")), ["v"], "left_semi").limit(1).count()


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, root`` for every node with an edge: ``root`` is the component's smallest node.

    ``edges`` has rows ``u, v`` of distinct longs, in any order and number.  Every round cuts its lineage by a written
    table.  Nodes with very many edges are summed up in part before they are shuffled, and spread over tasks where they are joined.
    """
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    now = durable(down, name)
    while not is_forest_of_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        # Large star: larger neighbours hang on the smallest node of the neighbourhood.
        large = durable(spread_join(both.filter("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), name)
        # Small star: smaller neighbours and the node itself do.
        low = durable(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        for old in (now, least, large, low):
            discard(old)
        now = after
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
