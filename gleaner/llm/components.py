"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, join_with_hot_keys, written


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", hub: int = 100_000) -> DataFrame:
    """(node, component) for every node of ``edges``; component is its smallest node.

    Union by alternating large-star and small-star rounds: every node keeps
    only links to smaller nodes, so a hub's links are spread over its
    neighbours, and each round writes its edges to the shared folder. Ends
    when a round changes nothing. A node with over ``hub`` links, and over a
    thousandth of all, is joined apart, so that no task gets all of them.
    Loops and repeated edges are allowed, null ends are dropped; no edges
    give no rows.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(e, "edges")
    sign = _sign(now)
    while True:
        # Fewer edges than make a hub can't hold one.
        many = sign[0] > hub
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True, 2 * sign[0] if many else 0, hub)
        if many:
            large = written(large, "edges")
        after = written(_star(large, False, sign[0] if many else 0, hub), "edges")
        drop_written(now)
        drop_written(large)
        now, before = after, sign
        sign = _sign(now)
        if sign == before:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    members = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return members.unionByName(roots.join(members, "node", "left_anti"))


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(edges: DataFrame, keep_larger: bool, total: int, hub: int) -> DataFrame:
    """Link the neighbours of each node u to the least of them and u itself.

    With ``keep_larger`` only neighbours above u are moved (large star); else
    ``edges`` point downwards and u moves along with them (small star).
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    both = join_with_hot_keys(edges, written(least, "least"), "u", "n", total, least=hub) if total else edges.join(least, "u")
    moved = both.where("v > u") if keep_larger else both
    moved = moved.select(F.col("v").alias("x"), F.col("m").alias("y"))
    if not keep_larger:
        moved = moved.union(least.select(F.col("u").alias("x"), F.col("m").alias("y")))
    return moved.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
