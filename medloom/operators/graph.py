"""Graph patterns over edge tables: pairs, two hops, shared neighbours, reachability, degrees, membership.

Edges are rows (src, dst, ...). Undirected pairs are stored as (lo, hi). Patterns over baskets are restricted to the
basket first, so a hub's whole neighbourhood is never paired.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Fixed value: the most edges of an item that one row holds.
IN_A_ROW = 256
# The nodes of a group that one array holds, and the rows of `reachable` that one part makes.
IN_A_BUNDLE, REACHED = 1000, 2_000_000


def basket_pairs(baskets: DataFrame, key: str, item: str) -> DataFrame:
    """(key, lo, hi): all pairs lo < hi of a basket's distinct items; baskets are short lists such as a patient's."""
    items = baskets.select(key, item).distinct()
    left, right = items.withColumnRenamed(item, "lo"), items.withColumnRenamed(item, "hi")
    return left.join(right, key).where("lo < hi")


def pairwise_edges(baskets: DataFrame, edges: DataFrame, key: str, item: str) -> DataFrame:
    """The undirected edges (lo, hi, ...) between items of the same basket."""
    return basket_pairs(baskets, key, item).join(edges, ["lo", "hi"])


def _marks(edges: list[DataFrame], item: str, whole: bool = False) -> DataFrame:
    """(item, marks): for each node and each edge table the marks (15 bits of a hash; with `whole` the nodes themselves) of the nodes it
    points at. A node with more than `IN_A_ROW` edges comes in several rows, none of which shares a target with another."""
    ends = reduce(DataFrame.union, [e.select("src", "dst", F.lit(i).alias("table")) for i, e in enumerate(edges)]).where("dst is not null")
    parts = F.pmod(F.xxhash64("dst"), F.ceil(F.count("*").over(W.partitionBy("src")) / IN_A_ROW))
    rows = ends.select(F.col("src").alias(item), parts.alias("part"), "table", (F.col("dst") if whole else mark("dst")).alias("mark"))
    each = [F.collect_set(F.when(F.col("table") == i, F.col("mark"))) for i in range(len(edges))]
    return rows.groupBy(item, "part").agg(F.array(*each).alias("marks")).drop("part")


def mark(node: str) -> Column:
    return F.pmod(F.hash(node), F.lit(1 << 15)).cast("smallint")


def _dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    return df.repartition(parts, *keys) if parts else df


def _met(pairs: DataFrame, ways: list[tuple[int, int, str]], *kept: str) -> DataFrame:
    """(kept, a, b, way, mark) of pairs with a_marks and b_marks, each mark of a row once."""
    common = [F.when(F.expr(when), F.array_intersect(F.col("a_marks")[i], F.col("b_marks")[j])) for i, j, when in ways]
    none = F.array().cast(pairs.schema["a_marks"].dataType.elementType)
    every = F.array(*[F.coalesce(c, none) for c in common])
    some = pairs.where(" or ".join(f"({when})" for *_, when in ways)).select(*kept, "a", "b", F.posexplode(every).alias("way", "found"))
    return some.select(*kept, "a", "b", "way", F.explode("found").alias("mark"))


def pair_meetings(pairs: DataFrame, edges: list[DataFrame], ways: list[tuple[int, int, str]]) -> DataFrame:
    """(a, b, way, mark): `meetings` of given distinct pairs (a, b)."""
    marks = _marks(edges, "a")
    met = pairs.join(marks.withColumnRenamed("marks", "a_marks"), "a").join(marks.select(F.col("a").alias("b"), F.col("marks").alias("b_marks")), "b")
    return _met(met, ways).distinct()


def mids(baskets: DataFrame, edges: list[DataFrame], ways: list[tuple[int, int, str]], key: str, item: str, parts: int | None = None) -> DataFrame:
    """(key, a, b, way, mid): the nodes that both items of a basket point at, each once, for each way as in `meetings`.

    For edges of which nothing but the ends is asked: an item's row holds its nodes themselves, so what meets need not be looked up,
    and a path is never dealt out. Edges' targets are of one type and short, such as numbers.
    """
    marked = _dealt(baskets.select(key, item).distinct().join(_marks(edges, item, whole=True), item), parts, key)
    a, b = (marked.select(key, F.col(item).alias(n), F.col("marks").alias(f"{n}_marks")) for n in "ab")
    return _met(a.join(b, key), ways, key).withColumnRenamed("mark", "mid")


def meetings(
    baskets: DataFrame, edges: list[DataFrame], ways: list[tuple[int, int, str]], key: str, item: str, carried: tuple[str, ...] = (),
    parts: int | None = None,
) -> DataFrame:
    """(key, carried, a, b, mark, way): the items of a basket that may point at the same node, for each way (number of a's edge table,
    number of b's, condition on a and b); `carried` are columns of the basket, such as an age.

    What meets is one row an item with short marks of its nodes, so all ways share one shuffle; `two_hop` looks the nodes up.
    `parts`: how many parts the rows are dealt to, where a task's share should not grow with the tables.
    """
    marked = _dealt(baskets.select(key, item).distinct().join(_marks(edges, item), item), parts, key)
    a, b = (marked.select(key, F.col(item).alias(n), F.col("marks").alias(f"{n}_marks")) for n in "ab")
    met = _met(a.join(b, key), ways, key).distinct()
    return met.join(baskets.select(key, *carried).distinct(), key) if carried else met


def two_hop(
    baskets: DataFrame, first: DataFrame, second: DataFrame, key: str, item: str, self_pairs: bool = False,
    carried: tuple[str, ...] = (), met: DataFrame | None = None, parts: int | None = None,
) -> DataFrame:
    """Paths a -first-> mid <-second- b inside a basket; the edges' other columns come with the prefixes a_ and b_.

    Pairs of items are found by the marks of their nodes; only what may meet is joined to the edges, which decide. `met` gives
    such pairs (rows of `meetings`) where several patterns share them.
    """
    kind = first.select("dst").union(second.select("dst")).schema["dst"].dataType
    if met is None:
        edges = [e.select("src", F.col("dst").cast(kind).alias("dst")) for e in (first, second)]
        met = meetings(baskets, edges, [(0, 1, "true" if self_pairs else "a <> b")], key, item, carried, parts)

    def side(edges: DataFrame, name: str) -> DataFrame:
        other = [F.col(c).alias(f"{name}_{c}") for c in edges.columns if c not in ("src", "dst")]
        return edges.select(F.col("src").alias(name), F.col("dst").cast(kind).alias("mid"), *other)

    paths = _dealt(met.drop("way"), parts, "a", "mark").join(_dealt(side(first, "a").withColumn("mark", mark("mid")), parts, "a", "mark"), ["a", "mark"])
    return _dealt(paths.drop("mark"), parts, "b", "mid").join(_dealt(side(second, "b"), parts, "b", "mid"), ["b", "mid"])


def shared_neighbour(
    baskets: DataFrame, edges: DataFrame, key: str, item: str, carried: tuple[str, ...] = (), met: DataFrame | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Unordered pairs a < b of a basket that point at the same mid."""
    if met is None:
        met = meetings(baskets, [edges], [(0, 0, "a < b")], key, item, carried, parts)
    return two_hop(baskets, edges, edges, key, item, met=met, parts=parts)


def endpoints(*edges: DataFrame) -> DataFrame:
    """(node): both ends of all edges, one row each end."""
    ends = [e.select(F.explode(F.array("src", "dst")).alias("node")) for e in edges]
    return reduce(DataFrame.unionByName, ends)


def degrees(*edges: DataFrame) -> DataFrame:
    """(node, degree) over both directions."""
    return endpoints(*edges).groupBy("node").agg(F.count("*").alias("degree"))


def orphans(nodes: DataFrame, node: str, *edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    return nodes.join(endpoints(*edges).distinct(), nodes[node] == F.col("node"), "left_anti")


def in_all(nodes: DataFrame, node: str, *sets: DataFrame) -> DataFrame:
    """Nodes that occur in every one of some one-column tables."""
    return reduce(lambda df, s: df.join(s.toDF(node), node, "left_semi"), sets, nodes)


def derived_edges(edges: DataFrame, bridge: DataFrame, existing: DataFrame) -> DataFrame:
    """(src, dst): edges carried over a bridge (dst, target) to its targets, distinct, without those that exist."""
    moved = edges.join(bridge, "dst").select("src", F.col("target").alias("dst")).distinct()
    return moved.join(existing.select("src", "dst"), ["src", "dst"], "left_anti")


def _alike(both: DataFrame) -> DataFrame:
    """(node, group): the nodes that have edges; those with the same neighbours (by 128 bits of hashes) are a group, named by its least node."""
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "dst"))
    marks = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), mark(1).alias("x"), mark(2).alias("y"))
    groups = marks.groupBy("n", "x", "y").agg(F.min("node").alias("group"))
    return marks.join(groups, ["n", "x", "y"]).select("node", "group")


def _bundles(grouped: DataFrame, name: str) -> DataFrame:
    """(group, nodes, many): the nodes of a group in arrays of about `IN_A_BUNDLE`."""
    cut = grouped.groupBy("group").agg(F.ceil(F.count("*") / IN_A_BUNDLE).alias("cuts"))
    dealt = grouped.join(cut, "group").withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")))
    return dealt.groupBy("group", "cut").agg(F.collect_list("node").alias(name)).select("group", name)


def _steps(both: DataFrame, frontier: DataFrame, hops: int) -> DataFrame:
    """(start, node, hops) of a breadth-first frontier, one join a hop; nodes reached before are taken out, so it never comes back."""
    seen = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, hops + 1):
        step = frontier.join(both, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen, ["start", "node"], "left_anti")
        seen = seen.union(frontier.withColumn("hops", F.lit(hop)))
    return seen


def reachable(edges: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """(start, node, hops): the nodes within some hops of each start over undirected edges, by the fewest hops.

    Nodes with the same neighbours reach the same nodes, and are two hops (of a node with itself among them: one) from each other. So the
    frontier goes from group to group of such nodes; groups become nodes last, by arrays, in parts of about `REACHED` rows.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src is not null").distinct()
    alike = _alike(both)
    begin = starts.select(F.col("start").alias("node")).distinct().join(alike, "node")
    of = lambda c: alike.select(F.col("node").alias(c), F.col("group").alias(f"{c}_group"))
    links = both.join(of("src"), "src").join(of("dst"), "dst", "left").select(F.col("src_group").alias("src"), F.col("dst_group").alias("dst")).distinct()
    near = _steps(links, begin.select(F.col("group").alias("start"), F.col("group").alias("node")).distinct(), hops)
    inside = links.where("src = dst").select(F.col("src").alias("start"), F.col("src").alias("node"), F.lit(1).alias("one"))
    near = near.join(inside, ["start", "node"], "left").withColumn("hops", F.when(F.col("hops") > 0, F.col("hops")).when(F.col("one") == 1, 1).otherwise(2)).drop("one")
    near = near.where(F.col("hops") <= hops)

    sizes = lambda df, c: df.groupBy(F.col("group").alias(c)).agg(F.count("*").cast("double").alias(f"{c}_n"))
    rows = near.join(sizes(begin, "start"), "start").join(sizes(alike, "node"), "node", "left").agg(F.sum(F.col("start_n") * F.coalesce("node_n", F.lit(1.0)))).first()[0]
    ends = near.join(_bundles(begin, "starts").withColumnRenamed("group", "start"), "start")
    ends = ends.join(_bundles(alike, "nodes").withColumnRenamed("group", "node"), "node", "left")
    # a null end has no group of its own
    ends = ends.select("starts", F.coalesce("nodes", F.array(F.col("node"))).alias("nodes"), "hops")
    ends = ends.repartition(1 + int((rows or 0) // REACHED), F.xxhash64("starts"), F.xxhash64("nodes"))
    pairs = ends.select(F.explode("starts").alias("start"), "nodes", "hops").select("start", F.explode("nodes").alias("node"), "hops")
    itself = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"))
    return itself.union(pairs.where("not (start <=> node)"))


def facets(nodes: DataFrame, node: str, **sets: DataFrame) -> DataFrame:
    """Nodes with the distinct count of each two-column table (node, value); every facet is counted before it is joined."""
    df = nodes.select(node)
    for name, pairs in sets.items():
        counts = pairs.toDF(node, "value").groupBy(node).agg(F.countDistinct("value").alias(name))
        df = df.join(counts, node, "left")
    return df.fillna(0, list(sets))


def routed(rows: DataFrame, **routes: Column) -> DataFrame:
    """Rows with `route`: the name of the first condition that holds; rows without one go."""
    start, *rest = routes.items()
    route = F.when(start[1], start[0])
    for name, condition in rest:
        route = route.when(condition, name)
    return rows.withColumn("route", route).where("route is not null")
