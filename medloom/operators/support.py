"""What supports a pair, a finding or a claim: direct edges, shared targets, or nothing; and rates over what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.operators import graph
from medloom.sources.shared import stored


def _pathways(once: DataFrame, first: DataFrame, second: DataFrame, turned: bool) -> DataFrame:
    two = [e.select("src", "dst").distinct() for e in (first, second)]
    ways = [(0, 1, "true"), (1, 0, "a <> b")] if turned else [(0, 1, "true")]
    met = graph.pair_meetings(once, two, ways)
    a, b = (F.when(F.col("way") == 0, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in ("ab", "ba"))
    met = stored(met.select(a, b, "mark", "way"), "support-met")
    return graph.two_hop(once, *two, "a", "b", met=met).select("a", "b", "mid")


def pathways(pairs: DataFrame, first: DataFrame, second: DataFrame, turned: bool = False) -> DataFrame:
    """(a, b, mid): a -first-> mid <-second- b for the given directed pairs (a, b) only, with `turned` also for (b, a).

    Short marks of their edges tell which pairs may meet; only those are joined to the edges, so neither a hub's neighbourhood
    nor a pair with all edges of its ends is ever listed.
    """
    wanted = pairs.select("a", "b")
    if turned:
        wanted = wanted.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return _pathways(wanted.distinct(), first, second, turned)


def best_support(pairs: DataFrame, edges: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) with `support`: direct (an edge in either direction), else indirect (a pathway in either
    direction), else none; `paths` counts the pathways of both directions. A null end is supported by nothing."""
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    named = pairs.where(whole).withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    once = named.groupBy("lo", "hi").agg(F.bool_or(F.col("a") == F.col("lo")).alias("ahead"), F.bool_or((F.col("a") == F.col("hi")) & (F.col("a") != F.col("b"))).alias("back"))
    # pairs and pathways are written, so that their shuffle files never lie on the disks together
    once = stored(once, "support-pairs")
    direct = edges.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct().withColumn("direct", F.lit(True))
    found = _pathways(once.select(F.col("lo").alias("a"), F.col("hi").alias("b")), first, second, True)
    paths = stored(found.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("paths")), "support-paths")
    df = once.join(direct, ["lo", "hi"], "left").join(paths, ["lo", "hi"], "left").withColumn("paths", F.coalesce("paths", F.lit(0).cast("long")))
    support = F.when(F.col("direct"), "direct").when(F.col("paths") > 0, "indirect").otherwise("none")
    sides = [F.when(F.col(c), F.struct(F.col(x).alias("a"), F.col(y).alias("b"))) for c, x, y in (("ahead", "lo", "hi"), ("back", "hi", "lo"))]
    rows = df.withColumn("support", support).select(F.explode(F.array_compact(F.array(*sides))).alias("p"), "support", "paths").select("p.a", "p.b", "support", "paths")
    return rows.unionByName(pairs.where(~whole).select("a", "b").distinct().select("a", "b", F.lit("none").alias("support"), F.lit(0).cast("long").alias("paths")))


def alert_rates(findings: DataFrame, baskets: DataFrame, key: str, item: str, unsupported: Column) -> DataFrame:
    """(key, findings, hallucination_rate, alerts_per_10): the share of findings that nothing supports, and findings for
    every ten items of a basket; baskets without findings have none."""
    found = findings.groupBy(key).agg(F.count("*").alias("findings"), F.count_if(unsupported).alias("bad"))
    sizes = baskets.groupBy(key).agg(F.countDistinct(item).alias("items"))
    df = sizes.join(found, key, "left").fillna(0, ["findings", "bad"])
    rate = F.round(F.coalesce(F.try_divide("bad", "findings"), F.lit(0.0)), 4)
    return df.select(key, "findings", rate.alias("hallucination_rate"), F.round(10 * F.col("findings") / F.col("items"), 4).alias("alerts_per_10"))


def transporter_paths(baskets: DataFrame, inhibits: DataFrame, substrates: DataFrame, key: str, item: str, parts: int | None = None) -> DataFrame:
    """(key, a, b, mid): a inhibits a transporter that carries b, both in one basket."""
    two = [e.select("src", "dst") for e in (inhibits, substrates)]
    return graph.mids(baskets, two, [(0, 1, "a <> b")], key, item, parts).select(key, "a", "b", "mid")


def grounded(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings (kind, a, b, ...) with `grounded`: whether an evidence row (kind, a, b) bears one out; for the kind `pair` in
    either direction. Kinds and ends are compared as they are; a null end is borne out by nothing."""
    pair = lambda c, f: F.when(F.col("kind") == "pair", f("a", "b")).otherwise(F.col(c))
    known = evidence.select("kind", pair("a", F.least).alias("_a"), pair("b", F.greatest).alias("_b")).distinct().withColumn("grounded", F.lit(True))
    keyed = findings.withColumns({"_a": pair("a", F.least), "_b": pair("b", F.greatest)})
    return keyed.join(known, ["kind", "_a", "_b"], "left").drop("_a", "_b").withColumn("grounded", F.coalesce("grounded", F.lit(False)))
