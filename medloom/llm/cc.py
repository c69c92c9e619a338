"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.llm.common import stored

#: Far more rounds than the squared logarithm of any table's length; reaching it means a bug, not a large graph.
MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches; nodes without links do not occur.

    Each round reduces every node's neighbours to their minimum (an aggregate with map-side combining) and joins it
    back, so a node with very many links is a skewed join, which Spark splits, never a collected group. Every round is
    written to the shared folder. Links with a null end and links of a node to itself are ignored; repeated links count
    once; no links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = stored(edges.where("u is not null and v is not null and u <> v").distinct(), "links")
    seen = None
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(down.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = _state(edges)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
