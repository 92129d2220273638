"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvault.session import is_small, lookup_join, materialise


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("_m"))


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    # A node with very many links is spread by a salt where its neighbours' minimum can't be broadcast.
    least = materialise(least, "least")
    return lookup_join(edges, least, ["u"], salt=F.xxhash64("v"), fits=is_small(least))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) of every node in links ``_a``, ``_b``; no other node occurs.

    Every round points each node at the least of its neighbours, first outwards, then inwards; rounds grow with the
    logarithm of the longest path. Tables are written between rounds, so a lost executor repeats one round only.
    """
    edges = materialise(links.filter("_a <> _b").select(F.greatest("_a", "_b").alias("u"), F.least("_a", "_b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        # Larger neighbours of a node are joined to the least of all its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        outward = _with_least(both, _least_neighbour(both)).filter("v > u").select(F.col("v").alias("u"), F.least("_m", "u").alias("v"))
        edges = materialise(outward.distinct(), "edges")
        # A node and its smaller neighbours are joined to the least of them.
        inward = _with_least(edges, _least_neighbour(edges))
        inward = inward.select(F.explode(F.array(F.struct("u", F.col("_m").alias("v")), F.struct(F.col("v").alias("u"), F.col("_m").alias("v")))).alias("e"))
        edges = materialise(inward.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return materialise(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
