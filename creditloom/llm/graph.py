"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of every node's component, from links ``a``, ``b``.

    In each round a node hooks to its least neighbour and follows hooks twice, and the links
    move to what the nodes hooked to. Nodes that hook leave the round, so at least half of
    those with links go each time. All steps are joins and aggregates on the cluster, written
    to the checkpoint folder.
    """
    links = checkpoint(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = checkpoint(links.select(F.col("a").alias("node")).union(links.select(F.col("b"))).distinct().withColumn("root", F.col("node")))
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        hooked = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
        for _ in range(2):
            next_hop = hooked.select(F.col("node").alias("root"), F.col("root").alias("further"))
            hooked = hooked.join(next_hop, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        hooked = checkpoint(hooked)
        moved = hooked.select(F.col("node").alias("root"), F.col("root").alias("further"))
        found = checkpoint(found.join(moved, "root", "left").select("node", F.coalesce("further", "root").alias("root")))
        a, b = hooked.select(F.col("node").alias("a"), F.col("root").alias("to_a")), hooked.select(F.col("node").alias("b"), F.col("root").alias("to_b"))
        # Where two hops did not reach the end, the rest of the way stays a link.
        rest = hooked.join(moved, "root").where("further <> root").select(F.least("root", "further").alias("a"), F.greatest("root", "further").alias("b"))
        moved_links = links.join(a, "a").join(b, "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        links = checkpoint(moved_links.union(rest).distinct())
    return found
