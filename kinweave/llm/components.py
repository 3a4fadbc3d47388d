"""Connected components of an undirected graph, as joins; nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b); root is the component's smallest node.

    Each round gives every node the smallest root among its neighbours' and its own, then
    follows roots of roots twice, so long chains halve again and again. Rounds are written to
    the shared folder; the loop ends when no root changes.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settle(both, "links")
    roots = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    while True:
        near = roots.select(F.col("node").alias("b"), F.col("root").alias("r"))
        best = both.join(near, "b").groupBy("a").agg(F.min("r").alias("r")).withColumnRenamed("a", "node")
        step = roots.join(best, "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        for _ in range(2):
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
            step = step.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root"))
        step = settle(step, "roots")
        changed = step.where("old <> root").limit(1).count()
        roots = step.select("node", "root")
        if not changed:
            return roots
