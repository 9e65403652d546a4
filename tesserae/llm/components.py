"""Connected components of a table of links, by alternating stars.

Each round links every node's larger neighbours to its smallest one, then every node's smaller neighbours to it, until
nothing changes; the number of rounds grows with the logarithm of the longest path.  Stars are made by aggregates and
joins; no component is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) in one direction; returns (a, b) with b <= a."""
    if large:
        sided = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sided = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sided.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    joined = sided.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    return joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of numbers; returns (node, component), the component's smallest node, for all nodes but those."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        edges = cut(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
