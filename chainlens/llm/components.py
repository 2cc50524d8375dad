"""Connected components of a distributed edge list (union-find by stars).

Rounds of large-star and small-star steps (Kiveris et al., 2014) turn every
component into a star around its smallest node, in a logarithmic number of
rounds.  Each round is a table in the shared folder.  A node with very many
neighbours is handled in salted parts: its minimum is taken over the parts'
minima, and no task holds all its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.llm.common import staged

SALTS = 64


def _with_minimum(edges: DataFrame) -> DataFrame:
    """``u, v, m``: every edge with the smallest neighbour of ``u``."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("part_min"))
    least = parts.select("u", "salt", F.min("part_min").over(Window.partitionBy("u")).alias("m"))
    return salted.join(least, ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_minimum(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # edges lead from the larger to the smaller node
    linked = _with_minimum(edges)
    return (
        linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(linked.select("u", F.col("m").alias("v")))
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; a component is named by its smallest node.

    Edges with a null end and edges from a node to itself link nothing; a node
    that has no other edges is not in the result.  An empty list gives no rows.
    """
    a, b = edges.columns
    stars = staged(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    mark = None
    while True:
        count, digest = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not count or (count, digest) == mark:
            break
        mark = (count, digest)
        stars = staged(_small_star(staged(_large_star(stars), "large-star")), "small-star")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
