"""Connected components by alternating large and small stars, each round cut to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if small:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m"))
    met = both.join(least, "u")
    if small:
        out = met.where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(least.select("u", F.col("_m").alias("v")))
    else:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of any direction -> (node, root) for every node with an edge, root the smallest node.

    Nodes are long; null ends and loops are dropped. Rounds go on until nothing changes; their number
    grows with the logarithm of the nodes. A hub's edges are combined before the shuffle that finds
    its minimum, and adaptive skew joins split them where they meet it.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    told = None
    while True:
        edges = cut(_stars(_stars(edges, small=False), small=True))
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == told or not seen[0]:
            break
        told = seen
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
