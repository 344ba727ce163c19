"""Connected components as joins: contract every vertex into its smallest neighbour, jump pointers, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long): the smallest node reachable.

    The edge list at least halves in vertices each round, hubs are pre-aggregated, and each round's
    tables are written to the shared folder, so a lost executor costs one round at most."""
    left = common.cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found: DataFrame | None = None
    while left.limit(1).count():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = common.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "up")
        while True:
            above = up.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("_next"))
            if not above.limit(1).count():
                break
            jumped = common.cut(up.join(above, "root", "left").select("node", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "jump")
            up = jumped.select("node", "root")
            if not jumped.where("moved").limit(1).count():
                break
        if found is None:
            found = up
        else:
            to = up.select(F.col("node").alias("root"), F.col("root").alias("_to"))
            found = common.cut(found.join(to, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "found")
        a = up.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        b = up.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        half = common.cut(left.join(a, "a").select("_a", "b"), "half")
        moved = half.join(b, "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        left = common.cut(moved.distinct(), "edges")
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.select("node", F.col("root").alias("component"))
