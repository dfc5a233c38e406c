"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.plans.lineage import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point every neighbour of a node (large: those above it; small: those below and itself) to the least of them."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), True)  # cut: the join may then split a hot node
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")), True)
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the least node that each node of ``edges`` reaches. Null ends and loops are ignored.

    Joins are on a node whose one side holds it once, so a node with a third of all links is split by
    adaptive execution; every round is cut into the checkpoint folder.
    """
    now = cut(edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), True)
    state = None
    while True:  # until a round changes nothing
        now = cut(_star(_star(now, True), False), True)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            break
        state = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
