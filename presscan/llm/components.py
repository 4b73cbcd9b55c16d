"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presscan.llm.columns import FEW
from presscan.session import stored, stored_alone


def component_ids(links: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest id of its component) of every id in ``links`` (a, b).

    Alternating stars: every node hands its smallest neighbour to its larger ones,
    then to its smaller ones, until every component is a star. Both keep components, and each
    halves the distance to the smallest id or better. A node with very many neighbours
    is an aggregation key and one side of a join, never a group held in one place.
    """
    return stored_alone(links.sparkSession, lambda: _component_ids(links))


def _component_ids(links: DataFrame) -> DataFrame:
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while True:
        # A round never adds edges, and they have at most twice as many nodes. Smallest neighbours of
        # few nodes are handed to every task; then rows need neither be dealt out for the joins nor be distinct.
        few = 2 * edges.count() <= FEW
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")))
        # In a star, who has a smaller neighbour has no other one.
        if not least.filter("m < u AND m < most").limit(1).count():
            return least.select(F.col("u").alias("doc_id"), F.least("u", "m").alias("component_id"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(F.broadcast(least) if few else least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large if few else stored(large.distinct())
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(F.broadcast(least) if few else least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small if few else small.distinct())
