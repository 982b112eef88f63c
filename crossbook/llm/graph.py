"""Connected components of a link table, by alternating large and small stars. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lake


def _rehung(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Hangs the neighbours of every node under its smallest neighbour. edges: (x, y) with x > y."""
    both = edges.select(F.col("x").alias("u"), F.col("y").alias("v"))
    if larger_only:
        both = both.union(edges.select(F.col("y").alias("u"), F.col("x").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    hung = both.join(least.hint("merge"), "u")
    if larger_only:
        out = hung.where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y"))
    else:
        out = hung.select(F.col("v").alias("x"), F.col("m").alias("y")).union(least.select(F.col("u").alias("x"), F.col("m").alias("y")))
    return out.where("x <> y").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node with a link; root is the smallest node that can be reached."""
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct()
    edges, before = lake.written(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = lake.written(_rehung(_rehung(edges, True), False), "edges")
    return edges.select(F.col("x").alias("node"), F.col("y").alias("root")).union(edges.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
