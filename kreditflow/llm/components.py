"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kreditflow.llm.common import materialize


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _star(near: DataFrame, keep) -> DataFrame:
    """Hang the neighbours of every u on the smallest of them and u."""
    least = materialize(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "links-least")
    return near.join(least, "u").filter(keep).select(F.col("v").alias("x"), "m").filter("x <> m").distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, label) of every node in ``links`` (columns a, b): label is the smallest node that links reach.

    Each round rewrites the links table, which shrinks to one link per node;
    only a count and a checksum of it reach the driver.  The least neighbours
    are tables of their own, so both sides of their joins are plain exchanges
    and a hub with a large part of all links is split over tasks.
    """
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    known = None
    while True:
        # large star: neighbours above u go to the least neighbour
        large = _star(_both_ways(links), F.col("v") > F.col("u")).select(F.col("x").alias("a"), F.col("m").alias("b"))
        # small star: neighbours not above u, and u itself
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "links-least")
        hung = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        links = materialize(hung.distinct(), name)
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x")).collect()[0]
        if state == known:
            break
        known = state
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.union(links.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
