"""Known interactions that a graph must hold: validate, repair what is absent or wrong, validate again.

Entries: entry, kind (`drug-drug`, either direction, or `herb-drug`), a, b (names), expected, mechanism. Names: key, node, kind
(`drug` or `herb`), degree; several nodes may bear a name. Edges: kind, src, dst, severity, source, mechanism. A repaired graph is
a new edge table (and new names), so every version stays readable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medloom.functions import text
from medloom.operators.paths import shortest_paths
from medloom.sources.shared import stored

# The rank of a severity, and the source of repairs, which goes before all others.
SEVERITY = {"major": 3, "moderate": 2, "minor": 1, "unknown": 0}
CURATED, CURATED_RANK = "sentinel_curated", 100


def _rank(table: dict[str, int], value: Column, other: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), F.coalesce(value, F.lit(""))), F.lit(other))


def resolved(entries: DataFrame, names: DataFrame) -> DataFrame:
    """entry, side, node, degree: every node that bears the name of an entry's side, by its lookup key."""
    sides = F.array(
        F.struct(F.lit("a").alias("side"), F.when(F.col("kind") == "herb-drug", "herb").otherwise("drug").alias("kind"), F.col("a").alias("name")),
        F.struct(F.lit("b").alias("side"), F.lit("drug").alias("kind"), F.col("b").alias("name")),
    )
    asked = entries.select("entry", F.inline(sides)).withColumn("key", text.lookup_key(F.col("name")))
    return asked.join(names.select("key", "kind", "node", "degree").distinct(), ["key", "kind"]).select("entry", "side", "node", "degree")


def preferred(entries: DataFrame, nodes: DataFrame, edges: DataFrame, priority: dict[str, int]) -> DataFrame:
    """entry, severity, source: of all edges between an entry's nodes the one of the best source, then the gravest."""
    a, b = (nodes.where(F.col("side") == s).select("entry", F.col("node").alias(s)) for s in "ab")
    pairs = entries.select("entry", "kind").join(a, "entry").join(b, "entry")
    turned = edges.where("kind = 'drug-drug'").select("kind", F.col("dst").alias("src"), F.col("src").alias("dst"), "severity", "source")
    ways = edges.select("kind", "src", "dst", "severity", "source").unionByName(turned)
    hits = pairs.join(ways, (pairs["kind"] == ways["kind"]) & (F.col("a") == F.col("src")) & (F.col("b") == F.col("dst")))
    order = F.struct(_rank({**priority, CURATED: CURATED_RANK}, F.col("source"), 0), _rank(SEVERITY, F.col("severity"), -1), F.coalesce("source", F.lit("")), F.coalesce("severity", F.lit("")))
    return hits.groupBy("entry").agg(F.max_by(F.struct("severity", "source"), order).alias("e")).select("entry", "e.*")


def evaluated(entries: DataFrame, nodes: DataFrame, edges: DataFrame, priority: dict[str, int]) -> DataFrame:
    """entries with found, matches, severity and source of the preferred edge."""
    best = preferred(entries, nodes, edges, priority).withColumn("found", F.lit(True))
    rows = entries.join(best, "entry", "left")
    return rows.withColumns({"found": F.coalesce("found", F.lit(False)), "matches": F.coalesce(F.col("severity") == F.coalesce("expected", F.lit("moderate")), F.lit(False))})


def repaired(wrong: DataFrame, nodes: DataFrame, names: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, edges) with a curated edge for each entry: between the nodes of the highest degree that bear its names, new
    ones where none does. An older curated edge between the two gives way."""
    order = W.partitionBy("entry", "side").orderBy(F.col("degree").desc(), "node")
    first = nodes.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    a, b = (first.where(F.col("side") == s).select("entry", F.col("node").alias(f"{s}_node")) for s in "ab")
    rows = wrong.join(a, "entry", "left").join(b, "entry", "left")
    new = lambda s: F.concat(F.lit("new:"), text.smart_title(text.clean(F.col(s))))
    rows = rows.select(
        "kind", "a", "b", F.coalesce("a_node", new("a")).alias("src"), F.coalesce("b_node", new("b")).alias("dst"),
        F.coalesce("expected", F.lit("moderate")).alias("severity"), F.coalesce(text.clean(F.col("mechanism")), F.lit("Curated sentinel interaction")).alias("mechanism"),
    )
    curated = rows.groupBy("kind", "src", "dst").agg(F.max(F.struct(_rank(SEVERITY, F.col("severity"), -1), "severity", "mechanism")).alias("e"))
    curated = stored(curated.select("kind", "src", "dst", "e.severity", F.lit(CURATED).alias("source"), "e.mechanism"), "sentinel-curated")
    # either direction of a drug pair is the same pair; the side of an edge that is kept does not matter to it
    over = curated.select("kind", "src", "dst").union(curated.where("kind = 'drug-drug'").select("kind", "dst", "src"))
    kept = edges.where(F.coalesce(F.col("source") != CURATED, F.lit(True))).unionByName(edges.where(F.col("source") == CURATED).join(over, ["kind", "src", "dst"], "left_anti").select(edges.columns))
    sides = rows.select(F.inline(F.array(
        F.struct(F.col("a").alias("name"), F.col("src").alias("node"), F.when(F.col("kind") == "herb-drug", "herb").otherwise("drug").alias("kind")),
        F.struct(F.col("b").alias("name"), F.col("dst").alias("node"), F.lit("drug").alias("kind")),
    )))
    added = sides.where(F.col("node").startswith("new:")).select(text.lookup_key(F.col("name")).alias("key"), "node", "kind", F.lit(0).cast("long").alias("degree")).distinct()
    return names.select("key", "node", "kind", "degree").unionByName(added), kept.unionByName(curated.select(edges.columns))


def validated(entries: DataFrame, names: DataFrame, edges: DataFrame, priority: dict[str, int], hops: int = 3) -> DataFrame:
    """A row for each entry: found and matches before, reason (`not_found`, `severity_mismatch` or null), hint (nodes of a shortest
    path where no edge was found), and found, matches, severity and source after the repair."""
    edges = stored(edges.select("kind", "src", "dst", "severity", "source", "mechanism"), "sentinel-edges")
    nodes = stored(resolved(entries, names), "sentinel-nodes")
    before = stored(evaluated(entries, nodes, edges, priority), "sentinel-before")
    wrong = before.where("not matches").select(entries.columns)

    lost = before.where("not found").select("entry")
    a, b = (nodes.where(F.col("side") == s).select("entry", F.col("node").alias(s)) for s in "ab")
    pairs = stored(lost.join(a, "entry").join(b, "entry"), "sentinel-pairs")
    kinds = F.when(F.col("kind") == "herb-drug", "INTERACTS_WITH_DRUG").otherwise("INTERACTS_WITH")
    ways = shortest_paths(edges.select("src", "dst", kinds.alias("rel")), pairs, hops).where("hops is not null")
    hints = pairs.join(ways, ["a", "b"]).groupBy("entry").agg(F.min(F.struct("hops", "nodes")).alias("w")).select("entry", F.array_join("w.nodes", ">").alias("hint"))

    names2, edges2 = repaired(wrong, nodes, names, edges)
    after = evaluated(entries, resolved(entries, names2), edges2, priority)
    first = before.select("entry", F.col("found").alias("found_before"), F.col("matches").alias("matched_before"))
    reason = F.when(~F.col("found_before"), "not_found").when(~F.col("matched_before"), "severity_mismatch")
    rows = first.join(after.select("entry", "kind", "found", "matches", "severity", "source"), "entry").join(hints, "entry", "left")
    return rows.select("entry", "kind", "found_before", "matched_before", reason.alias("reason"), "hint", "found", "matches", "severity", "source")
