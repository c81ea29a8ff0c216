"""Connected components of links that stay in the cluster.

Alternates two steps: every node's larger neighbours are linked to the smallest one it
knows (large star), then its smaller neighbours are (small star). Links end as stars
around the smallest node of each component; that is seen on the links themselves, so no
round runs only to change nothing, and links that are stars already need none. Both steps
take minima per node, which are combined before the shuffle; a node with very many
neighbours is an aggregation key, and its links are rows, never one list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmloom.llm.common import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (a > b)."""
    if large:
        around = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        moved = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("low"))
        joined = links.join(least, "a")
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select("a", F.col("low").alias("b")))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _stars(links: DataFrame) -> bool:
    """Whether links (a > b) are stars: no node has two smaller neighbours, or one on either side."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("below")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("below")))
    inner = ends.groupBy("node").agg((F.sum("below") > F.min("below")).alias("inner"))
    return not inner.agg(F.max("inner")).first()[0]


def star_links(parts: DataFrame) -> DataFrame:
    """Links (a, b) that have the components `parts` (node, part) and are stars."""
    return parts.filter("node <> part").select(F.col("node").alias("a"), F.col("part").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """node, part for every node of `links` (a, b): the smallest node it reaches."""
    now = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        now = stage(_star(_star(now, True), False), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("part")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("part")).distinct())
