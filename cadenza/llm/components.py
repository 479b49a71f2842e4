"""Connected components of a table of links, by alternating large and small stars.

Each round keeps at most one link per old link and node, and hangs nodes on smaller ones
until every component is one star around its smallest node. A node's smallest neighbour is
a minimum, pre-aggregated before the shuffle; the joins back run between written tables, so
Spark can split a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.tables import settle


def _towards_least(directed: DataFrame, label: str) -> DataFrame:
    """(node, near, least): each directed link with the least of the node and all its ``near``."""
    least = settle(
        directed.groupBy("node").agg(F.min("near").alias("near_least")).select(
            "node", F.least("node", "near_least").alias("least")
        ),
        f"{label}-least",
    )
    return directed.join(least, "node")


def _links(df: DataFrame) -> DataFrame:
    """(high, low) with high > low, each once."""
    return df.where(F.col("high") > F.col("low")).select("high", "low").distinct()


def _summary(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for every node with a link to another, the least node it can reach.

    ``links`` has two long columns; nulls and self-links mean nothing, repeats and directions
    do not matter. An empty table gives no rows.
    """
    both = links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull()
    )
    now = settle(_links(both), "links")
    seen = _summary(now)
    while seen[0]:
        # Large star: neighbours above a node move to the least of its neighbourhood.
        there = now.select(F.col("high").alias("node"), F.col("low").alias("near"))
        back = now.select(F.col("low").alias("node"), F.col("high").alias("near"))
        large = _towards_least(settle(there.unionByName(back), "both"), "large")
        moved = large.where(F.col("near") > F.col("node")).select(
            F.col("near").alias("high"), F.col("least").alias("low")
        )
        now = settle(_links(moved), "large-star")
        # Small star: a node and its neighbours below it move to the least of them.
        down = now.select(F.col("high").alias("node"), F.col("low").alias("near"))
        small = _towards_least(down, "small")
        below = small.select(F.col("near").alias("high"), F.col("least").alias("low"))
        own = small.select(F.col("node").alias("high"), F.col("least").alias("low"))
        now = settle(_links(below.unionByName(own)), "small-star")
        after = _summary(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
        now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    )
