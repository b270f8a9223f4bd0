"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import work


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """Large star: larger neighbours go to the least one. Small star: the node and its lesser neighbours do."""
    if small:
        sides = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        own = links.select(F.greatest("a", "b").alias("u")).select("u", F.col("u").alias("v"))
    else:
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        own = None
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = (sides if own is None else sides.union(own)).join(least, "u")
    moved = moved.where("v <> m") if small else moved.where("v > u")
    return moved.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): every node with a link, with the least node it is linked to over any path.

    Each round is written, the number of rounds grows with the logarithm of the
    longest chain, and only a count and a sum come to the driver. Minima are combined
    before the shuffle and rows of a hub are joined, never gathered.
    """
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    edges, before = work.written(edges.distinct(), "links"), None
    while True:
        edges = work.written(_stars(_stars(edges, small=False), small=True), "stars")
        digest = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if digest == before:
            break
        before = digest
    centres = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return centres.union(edges.select("b", "a"))
