"""Connected components of links too many for any one machine: alternating large and small stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.llm.common import materialise


def _starred(links: DataFrame) -> bool:
    """Whether every component is a star: no node has two links to smaller ones, or one to a smaller and one to a larger."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).filter("ups > 1 or (ups > 0 and least = 0)").isEmpty()


def star_components(links: DataFrame, label: str = "links") -> DataFrame:
    """(a, b) links of longs, in any order and repeated at will, become (node, root): each node that has a link and isn't
    its component's smallest, with that smallest. No link gives no row. Every round is written, so a lost executor costs
    one round. Groups are only summed up (min), never gathered; a hub's links are split by the skew join, as both sides
    of each join come from files."""
    first = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    links = materialise(first, label)
    while not _starred(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy(F.col("a").alias("hub")).agg(F.least(F.min("b"), F.first("a")).alias("to")), label)
        large = links.join(least, F.col("b") == F.col("hub")).select("a", F.col("to").alias("b")).distinct()
        large = materialise(large, label)
        least = materialise(large.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("to")), label)
        small = large.join(least, F.col("a") == F.col("hub")).select(F.col("b").alias("a"), F.col("to").alias("b")).filter("a > b")
        links = materialise(small.unionByName(least.select(F.col("hub").alias("a"), F.col("to").alias("b"))).distinct(), label)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
