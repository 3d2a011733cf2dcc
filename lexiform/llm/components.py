"""Connected components over a distributed edge table, by alternating large-star and small-star steps.

Links never reach the driver: each round is two aggregations and joins over the edge table, written to the shared
folder; the driver only sees a count and a checksum. A node with many neighbours is reduced to its smallest one with
map-side combining, and joins against that one row per node, which adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiform.llm.common import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (large) or smaller-or-equal (small) neighbours of every node on its smallest neighbour."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the smallest node reachable.

    Nodes are of any ordered type. Self-links, repeated and reversed links are allowed; links with a null are ignored;
    no edges give an empty result.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen, before = mark, now
        now = written(_star(_star(now, large=True), large=False), name)
        dropped(before)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
