"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged


def components(edges: DataFrame, a: str, b: str, rounds: int = 64) -> DataFrame:
    """(node, root): every node of the edges with the smallest node that it is connected to.

    Large star and small star take turns until nothing changes: each joins neighbours to the smallest node around them, so a
    chain shortens by half or more a round and no node's neighbours are gathered. Edges may repeat or lead to themselves; null
    ends are left out. Raises if `rounds` are not enough, which takes a chain of about 2 to that power.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = now.select("u").union(now.select("v")).distinct()
    now = now.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = staged(now, "edges"), None
    for _ in range(rounds):
        around = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        hung = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = staged(hung.distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return nodes.join(now, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("root"))
        before = state
    raise RuntimeError(f"components not settled after {rounds} rounds")
