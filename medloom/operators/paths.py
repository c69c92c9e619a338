"""Shortest paths with their nodes and relations, between stated pairs of nodes.

Frontiers of paths grow from both ends in turn and meet over one edge, by whichever way lists the fewest rows for a pair, so a hub
in the middle of a path is passed as a single node, and a hub that is itself an end is looked up and not listed for each pair. Pairs are taken
out as soon as a path is found, each step is written to the shared folder, and a frontier keeps one path for each end and
node, which is enough: the smallest path over a node is the smallest way to it and the smallest way on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.sources.shared import stored


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst, rel): every edge both ways, of parallel ones the smallest relation; no loops."""
    both = edges.select("src", "dst", "rel").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel"))
    return both.where("src <> dst").groupBy("src", "dst").agg(F.min("rel").alias("rel"))


def _smallest(paths: DataFrame, keys: list[str], nodes: Column, rels: Column) -> DataFrame:
    """One path for each key: the first by its nodes, then by its relations."""
    best = paths.groupBy(*keys).agg(F.min(F.struct(nodes.alias("nodes"), rels.alias("rels"))).alias("path"))
    return best.select(*keys, "path.nodes", "path.rels")


def _ends(pairs: DataFrame, end: str) -> DataFrame:
    start = F.col(end)
    return pairs.select(start).distinct().select(start, start.alias(f"{end}_at"), F.array(start).alias(f"{end}_nodes"), F.array().cast("array<string>").alias(f"{end}_rels"))


def _grown(ends: DataFrame, edges: DataFrame, open_pairs: DataFrame, end: str) -> DataFrame:
    """A frontier one edge further, for the ends that still have an open pair; paths read from a to b."""
    at, nodes, rels = (F.col(f"{end}_{c}") for c in ("at", "nodes", "rels"))
    steps = ends.join(open_pairs.select(end).distinct(), end, "left_semi").join(edges, at == F.col("src"))
    ahead = (F.concat(nodes, F.array("dst")), F.concat(rels, F.array("rel"))) if end == "a" else (F.concat(F.array("dst"), nodes), F.concat(F.array("rel"), rels))
    found = _smallest(steps.select(end, F.col("dst").alias(f"{end}_at"), ahead[0].alias("n"), ahead[1].alias("r")), [end, f"{end}_at"], F.col("n"), F.col("r"))
    return stored(found.withColumnsRenamed({"nodes": f"{end}_nodes", "rels": f"{end}_rels"}), f"paths-{end}")


def _meetings(todo: DataFrame, left: DataFrame, right: DataFrame, links: DataFrame) -> list[DataFrame]:
    """A table for each way: the paths of open pairs whose frontiers one edge joins. For each pair either both frontiers are paired and the edge is looked
    up, or one of them goes one edge on and is looked up in the other one: whichever lists the fewest rows."""
    degree = links.groupBy("src").agg(F.count("*").alias("n"))
    def size(ends: DataFrame, end: str) -> DataFrame:
        ahead = ends.join(degree, F.col(f"{end}_at") == F.col("src"), "left").groupBy(end)
        return ahead.agg(F.count("*").cast("double").alias(f"{end}_n"), F.sum("n").cast("double").alias(f"{end}_next"))

    both = F.col("a_n") * F.col("b_n")
    way = F.when(both <= F.least("a_next", "b_next"), "both").when(F.col("a_next") <= F.col("b_next"), "a").otherwise("b")
    # a frontier without any edge on joins nothing
    sized = todo.join(size(left, "a"), "a").join(size(right, "b"), "b").where("a_next is not null and b_next is not null")
    chosen = stored(sized.select("a", "b", way.alias("way")), "paths-ways")
    pick = lambda w: chosen.where(F.col("way") == w).select("a", "b")
    columns = ["a", "b", "a_nodes", "a_rels", "b_nodes", "b_rels", "rel"]
    crossed = pick("both").join(left, "a").join(right, "b").join(links, (F.col("a_at") == F.col("src")) & (F.col("b_at") == F.col("dst")))
    from_a = pick("a").join(left, "a").join(links, F.col("a_at") == F.col("src")).join(right.withColumnRenamed("b_at", "dst"), ["b", "dst"])
    from_b = pick("b").join(right, "b").join(links, F.col("b_at") == F.col("dst")).join(left.withColumnRenamed("a_at", "src"), ["a", "src"])
    return [df.select(columns) for df in (crossed, from_a, from_b)]


def _meeting(todo: DataFrame, left: DataFrame, right: DataFrame, links: DataFrame) -> DataFrame:
    """The paths of all ways as one table."""
    return reduce(DataFrame.union, _meetings(todo, left, right, links))


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int = 3) -> DataFrame:
    """(a, b, hops, nodes, rels) for every distinct pair (a, b) of text ids: a shortest path of at most `hops` undirected edges.

    Of several the smallest by nodes, then relations. Without a path hops, nodes and rels are null; an end that is null has
    none; from a node to itself it is the node alone. Edges: src, dst, rel; null ends and loops go.
    """
    links = stored(undirected(edges), "paths-edges")
    asked = stored(pairs.select("a", "b").distinct(), "paths-pairs")
    none = F.array().cast("array<string>")
    found = [asked.where("a = b").select("a", "b", F.lit(0).alias("hops"), F.array("a").alias("nodes"), none.alias("rels"))]
    todo = asked.where("a <> b")
    left, right = _ends(todo, "a"), _ends(todo, "b")
    for hop in range(1, hops + 1):
        if hop > 1 and hop % 2 == 0:
            left = _grown(left, links, todo, "a")
        elif hop > 1:
            right = _grown(right, links, todo, "b")
        nodes, rels = F.concat("a_nodes", "b_nodes"), F.concat("a_rels", F.array("rel"), "b_rels")
        # a pair goes one way only; one way after the other, so that the shuffle files of one are gone before the next one writes
        met = [stored(_smallest(meet, ["a", "b"], nodes, rels), "paths-found") for meet in _meetings(todo, left, right, links)]
        met = reduce(DataFrame.union, met)
        found.append(met.select("a", "b", F.lit(hop).alias("hops"), "nodes", "rels"))
        todo = stored(todo.join(met, ["a", "b"], "left_anti"), "paths-open")
    rest = todo.unionByName(asked.where("a is null or b is null"))
    rest = rest.select("a", "b", F.lit(None).cast("int").alias("hops"), F.lit(None).cast("array<string>").alias("nodes"), F.lit(None).cast("array<string>").alias("rels"))
    return reduce(DataFrame.unionByName, [*found, rest])
