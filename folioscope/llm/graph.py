"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut, cut_small


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the smallest node that is reachable.

    Each round hooks every tree onto the smallest grandparent next to it and shortens the paths, so the rounds grow with the
    logarithm of the longest chain. A hub is one key of a join whose other side is unique by key, so its rows can be split
    over tasks; minima are combined before the shuffle. Every round's parents are cut from their lineage in the shared
    checkpoint folder. Nulls, loops and repeated edges change nothing. An empty edge table gives an empty result.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    both = cut_small(both.select(F.col("a").alias("u"), F.col("b").alias("v")).union(both.select(F.col("b"), F.col("a"))))
    tasks = both.rdd.getNumPartitions()
    few = lambda df: cut(df.coalesce(tasks))  # noqa: E731  nodes are no more than ends
    parents = few(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("parent")))
    for _ in range(max_rounds):
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        grand = parents.join(up, "parent").select("node", "parent", "grand")
        near = both.join(grand.select(F.col("node").alias("v"), "grand"), "v").groupBy(F.col("u").alias("node")).agg(F.min("grand").alias("near"))
        seen = grand.join(near, "node")
        moves = (
            seen.select("node", F.least("parent", "grand", "near").alias("parent"))
            .union(seen.select(F.col("parent").alias("node"), F.least("grand", "near").alias("parent")))
            .groupBy("node")
            .agg(F.min("parent").alias("parent"))
        )
        after = few(moves)
        changed = after.join(parents.withColumnRenamed("parent", "was"), "node").where("parent <> was").limit(1).count()
        parents = after
        if not changed:
            return parents.select("node", F.col("parent").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
