"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.operators.spread import HARMLESS, spread_join
from weftline.scratch import cut, passing


def _least(edges: DataFrame) -> DataFrame:
    """(u, m, n): the least of u's neighbours, and how many it has."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _joined(rows: DataFrame, least: DataFrame, top: int) -> DataFrame:
    """Edges with the least of their node; the nodes of most edges are looked up by broadcast where that matters."""
    if top <= HARMLESS:
        return rows.join(least.drop("n"), "u")
    return spread_join(rows, cut(least, "least"), ["u"], "n", ["v"])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node that an edge joins to another; root is the least node of the component.

    Edges have no direction; loops, repeated edges and edges with a null end are ignored. Neighbourhoods are never
    gathered: each step takes the least neighbour by an aggregation that combines before the shuffle, and joins it back
    by node, the most joined nodes by broadcast. Every round is written to the shared folder. It ends when a round leaves the stars as they were, which
    takes a number of rounds that grows with the logarithm of a component's size.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    # Rounds pass; only the stars that are left at the end last.
    with passing(edges.sparkSession):
        e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        before = None
        for _ in range(max_rounds):
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            # The most edges of a node, and what tells the edges of two rounds apart.
            nodes = both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
            top, *now = nodes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("h"), F.lit(0))).first()
            if now == before:
                break
            before = now
            # Large star: larger neighbours of u go to the least of u and its neighbours.
            lead = _least(both).withColumn("m", F.least("u", "m"))
            large = _joined(both.where("v > u"), lead, top).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            if top > HARMLESS:
                large = cut(large, "large")
            # Small star: u and its smaller neighbours go to the least of those. No node has more edges than before.
            low = _least(large)
            small = _joined(large, low, top)
            small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
            e = cut(small.where("u <> v").distinct(), "edges")
        else:
            raise RuntimeError("components did not settle")
        e = cut(e, "stars", lasting=True)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
