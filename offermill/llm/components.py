"""Connected components of an edge table by alternating stars; no node's edges are collected into a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: neighbours (larger ones, or smaller ones with the node itself) hook onto the smallest neighbour."""
    if larger:
        both = edges.select("u", "v").union(edges.select("v", "u"))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    joined = both.join(least, "u")
    if larger:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", "m"))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge (columns u, v); the component is its smallest node."""
    current = cut_lineage(edges.select("u", "v").filter("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        current = cut_lineage(_stars(_stars(current, True), False))
        row = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        mark = tuple(row)
    raise RuntimeError("components did not settle")
