"""Connected components of a table of edges, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import discard, written


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges(a, b), longs -> (node, root): for each node of an edge the smallest node that it reaches.

    Each round hangs the larger neighbours of a node on its smallest one, then the smaller ones likewise (large and small stars), until
    the edges stay as they are. Minima are aggregated before they move, and are joined with the edges as two plain
    exchanges, so that a hub's edges can be split. The edges are written to the shared folder after each round.
    """
    edges = written(edges.selectExpr("greatest(a, b) a", "least(a, b) b").where("a <> b").distinct(), "edges")
    for _ in range(most):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("b")).selectExpr("a", "least(a, b) m")
        large = both.join(low, "a").where("b > a").selectExpr("b a", "m b").where("a <> b").distinct()
        large = written(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.selectExpr("a", "m b").union(joined.where("b <> m").selectExpr("b a", "m b")).distinct()
        after = written(small, "small")
        same = edges.exceptAll(after).isEmpty() and after.count() == edges.count()
        discard(edges, large)
        edges = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.selectExpr("a node", "b root").union(edges.selectExpr("b node", "b root")).groupBy("node").agg(F.min("root").alias("root"))
