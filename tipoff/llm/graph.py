"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import settle
from tipoff.session import drop_staged, staged_tables


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node that has none: stars, each around its root."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.down").alias("down"), F.min("e.down").alias("least"))
    return nodes.where("down > 1 OR (down = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links between numbers to (node, root): the smallest number reachable from each.

    Only nodes with a link to another node come back, the roots not among them. Each round sends
    the larger neighbours of a node to its smallest one, then the smaller neighbours too; rounds
    grow with the logarithm of the longest path. Edges never become more, and every round is
    written to the shared folder, in place of the one before. Nulls and links of a node to itself are left out.
    """
    spark, before = edges.sparkSession, set(staged_tables(edges.sparkSession))
    current = settle(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while not _settled(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = [path for path in staged_tables(spark) if path not in before]
        current = settle(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        drop_staged(spark, last)
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
