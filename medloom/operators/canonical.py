"""Entities that share an identifier of any kind become one: connected components, then one aggregate for each component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.functions import text
from medloom.sources.shared import stored


def identifier_links(identifiers: DataFrame) -> DataFrame:
    """(a, b): each entity with the smallest one of every identifier (entity, kind, value) that it has; blank values link nothing."""
    rows = identifiers.select("entity", "kind", text.clean(F.col("value"), no_value=True).alias("value")).where("entity is not null and value is not null")
    least = rows.groupBy("kind", "value").agg(F.min("entity").alias("b"))
    return rows.join(least, ["kind", "value"]).select(F.col("entity").alias("a"), "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each end of some undirected links (a, b) the smallest node that it is connected with.

    Large-star and small-star steps in turn: a node's neighbours are hung on the smallest of them, by a minimum for each node
    and a join, so a hub's neighbours are never gathered; the number of rounds grows with the logarithm of the longest path. Each
    round is written to the shared folder; it ends when a round changes nothing.
    """
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).where("node is not null").distinct()
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = None
    while (state := _state(edges)) != before:
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "components-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.union(least.select("u", "m")).distinct(), "components-small")
    return ends.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _state(edges: DataFrame) -> tuple[int, int | None]:
    """The number of edges and a sum of their hashes, which do not depend on order."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def members(entities: DataFrame, identifiers: DataFrame) -> DataFrame:
    """entities (id, ...) with `component`, the smallest id of those that are one with it."""
    found = components(identifier_links(identifiers))
    return entities.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def canonical(rows: DataFrame, order: list[Column], filled: list[str]) -> DataFrame:
    """One row for each component of `members`: primary (the first id by the order), its name, the number of members, and of each
    column of `filled` the first value that is not blank, in the same order."""
    rank = F.struct(*[c.alias(f"_{i}") for i, c in enumerate([*order, F.col("id")])])
    value = lambda c: text.clean(F.col(c))
    first = [F.min_by(value(c), F.when(value(c).isNotNull(), rank)).alias(c) for c in filled]
    return rows.groupBy("component").agg(F.min_by("id", rank).alias("primary"), F.min_by("name", rank).alias("name"), F.count("*").alias("members"), *first)


def names_of(rows: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(component, synonym): the distinct cleaned names and synonyms (id, synonym) of all members, as rows, since a component may
    have any number of them."""
    own = rows.select("component", "id", F.col("name").alias("synonym"))
    more = rows.select("component", "id").join(synonyms, "id").select("component", "id", "synonym")
    return own.unionByName(more).select("component", text.clean(F.col("synonym")).alias("synonym")).where("synonym is not null").distinct()
