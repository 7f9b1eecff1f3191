"""Connected components of an edge table by contraction, in DataFrame operations only.

Each round every vertex takes its smallest neighbour (or itself) as its parent and edges are rewritten to parents, so
all but local minima disappear; rounds grow with the logarithm of the longest chain. Nothing comes to the driver but
row counts, each round is cut by a table in the shared folder, and vertices with many edges are joined by broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from . import kernel as K


def components(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, v, root) for every vertex of ``edges`` (keys, a, b): root is the same for connected vertices of equal keys."""
    keys = keys or []
    both = lambda e: e.select(*keys, "a", "b").union(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    edges = edges.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    steps: list[DataFrame] = []
    while True:
        edges = K.cut(edges)
        if edges.isEmpty():
            break
        parent = K.cut(both(edges).groupBy(*keys, F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("p")))
        steps.append(parent)
        a, b = (parent.select(*keys, F.col("v").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        moved = K.spread_join(edges, b, [*keys, "b"]).join(a, [*keys, "a"]).where("pa <> pb")  # a vertex is the smaller end of many edges
        edges = moved.select(*keys, F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct()
    if not steps:
        return edges.select(*keys, F.col("a").alias("v"), F.col("b").alias("root"))

    def follow(found: DataFrame, step: DataFrame) -> DataFrame:
        up = step.select(*keys, F.col("v").alias("root"), F.col("p").alias("up"))
        return K.spread_join(K.cut(found), up, [*keys, "root"], "left").select(*keys, "v", F.coalesce("up", "root").alias("root"))

    return reduce(follow, steps[1:], steps[0].withColumnRenamed("p", "root"))
