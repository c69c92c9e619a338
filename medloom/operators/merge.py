"""Merging rows: best row by priority, first values, upserts, entity merge. Every choice has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def best_row(rows: DataFrame, keys: list[str], priority: list[Column], seq: Column, **extra: Column) -> DataFrame:
    """One row a key: the one with the highest priorities, then the lowest seq; `extra` aggregates over the key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(priority)], (-seq).alias("seq"))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("best"), *[v.alias(k) for k, v in extra.items()])
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in rest if c not in extra], *extra)


def first_values(rows: DataFrame, keys: list[str], columns: list[str], seq: Column) -> DataFrame:
    """Per key the first non-null value of each column by seq; empty text counts as null."""
    def first(c: str) -> Column:
        value = F.when(F.col(c).cast("string") != "", F.col(c))
        return F.min_by(value, F.when(value.isNotNull(), seq)).alias(c)

    return rows.groupBy(*keys).agg(*[first(c) for c in columns])


def ranked_list(rows: DataFrame, keys: list[str], value: str, score: str, most: int) -> DataFrame:
    """Per key the values with the highest scores, as an array, how many there are, and whether some were left out."""
    top = rows.groupBy(*keys, value).agg(F.max(score).alias(score))
    order = W.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(value))
    ranked = top.withColumn("r", F.row_number().over(order))
    kept = F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.struct("r", F.col(value).alias("v")))))
    return ranked.groupBy(*keys).agg(
        F.transform(kept, lambda s: s["v"]).alias("values"), F.max(score).alias("top_score"), F.count("*").alias("many"),
        (F.count("*") > most).alias("truncated"),
    )


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key by an order, with their `rank`; Spark limits each group before it shuffles."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


# --- upserts --------------------------------------------------------------------------------------------------------


def _both(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    rest = [c for c in old.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in rest])
    return old.join(renamed, keys, "full_outer"), rest


def upsert(old: DataFrame, new: DataFrame, keys: list[str], winner: str = "new") -> DataFrame:
    """All keys of both; winner `new`: new values unless null, `old`: old ones unless null, `filled`: new unless blank."""
    df, rest = _both(old, new, keys)

    def value(c: str) -> Column:
        before, after = F.col(c), F.col(f"new_{c}")
        if winner == "old":
            return F.coalesce(before, after)
        if winner == "filled":
            after = F.when(after.cast("string") != "", after)
        return F.coalesce(after, before)

    return df.select(*keys, *[value(c).alias(c) for c in rest])


def append_text(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Old rows with a new text appended after ` | `, unless it is there already or blank."""
    df = old.join(new.select(*keys, F.col(column).alias("more")), keys, "left")
    before, more = F.coalesce(column, F.lit("")), F.coalesce("more", F.lit(""))
    text = F.when((more == "") | before.contains(more), F.col(column)).when(before == "", more)
    return df.withColumn(column, text.otherwise(F.concat_ws(" | ", before, more))).drop("more")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and the new ones whose keys are not there."""
    return old.unionByName(new.join(old, keys, "left_anti"))


def authoritative(old: DataFrame, new: DataFrame, keys: list[str], derived: Column, seq: Column) -> DataFrame:
    """One row a key with its `outcome`: new rows create keys and replace derived old ones, other old rows stay.

    Of several old rows of a key the first that is not derived stays, else the first; the others go.
    """
    old = old.withColumns({"is_new": F.lit(False), "weight": F.when(derived, 0).otherwise(2)})
    new = new.withColumns({"is_new": F.lit(True), "weight": F.lit(1)})
    every = old.unionByName(new)
    had = F.bool_or(~F.col("is_new"))
    best = best_row(every, keys, [F.col("weight")], seq, had=had, came=F.bool_or("is_new"))
    outcome = F.when(~F.col("came"), "untouched").when(~F.col("had"), "created").when(F.col("is_new"), "upgraded")
    return best.withColumn("outcome", outcome.otherwise("skipped_existing")).drop("weight", "is_new", "had", "came")


def flag_or_insert(old: DataFrame, new: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Old rows, flagged where new rows have their keys, all of a key's rows alike; keys that are not there become one row
    each, flagged, its other columns null unless new ones give them (of several, the least row)."""
    wanted = new.select(*keys).distinct().withColumn("_hit", F.lit(True))
    marked = old.join(wanted, keys, "left").withColumn(flag, F.coalesce("_hit", F.col(flag), F.lit(False))).drop("_hit")
    rest = [c for c in new.columns if c not in keys and c in old.columns and c != flag]
    missing = new.join(old, keys, "left_anti").groupBy(*keys).agg(F.min(F.struct(F.lit(0).alias("_"), *rest)).alias("least"))
    missing = missing.select(*keys, *[F.col(f"least.{c}").alias(c) for c in rest], F.lit(True).alias(flag))
    return marked.unionByName(missing, allowMissingColumns=True)


def both_ways(edges: DataFrame, src: str, dst: str, value: str) -> DataFrame:
    """(lo, hi, values): the distinct values of both orientations of each pair, sorted; values are of a few kinds."""
    pair = edges.select(F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi"), value).distinct()
    return pair.groupBy("lo", "hi").agg(F.array_sort(F.collect_set(value)).alias("values"))


def shared_keys(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key others have too, with `size`: rows instead of a list a key, so a hot key is never collected."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(sizes, key)


def match_only(edges: DataFrame, sources: DataFrame, source: str, targets: DataFrame | None = None, target: str | None = None) -> DataFrame:
    """Edges (src, dst) both of whose ends are known; targets: the table of the second ends, if it is another one."""
    known = lambda nodes, node, end: nodes.select(F.col(node).alias(end)).distinct()
    df = edges.join(known(sources, source, "src"), "src", "left_semi")
    return df.join(known(sources if targets is None else targets, target or source, "dst"), "dst", "left_semi").select(edges.columns)


# --- entities -------------------------------------------------------------------------------------------------------


def primaries(nodes: DataFrame, node: str, same: str, degree: str) -> DataFrame:
    """(node, primary): for groups of equal `same`, the member of the highest degree, the smallest on ties; a node without
    a group stands for itself."""
    best = nodes.groupBy(same).agg(F.min_by(node, F.struct(-F.col(degree), F.col(node))).alias("primary"))
    return nodes.join(best, same, "left").select(F.col(node).alias("node"), F.coalesce("primary", node).alias("primary"))


def rewired(edges: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with both ends replaced by their primaries, without self edges, one row each (src, dst, *keys): of several
    the one whose other columns are least."""
    to = lambda c: mapping.select(F.col("node").alias(c), F.col("primary").alias(f"p_{c}"))
    df = edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left")
    df = df.withColumns({c: F.coalesce(f"p_{c}", c) for c in ("src", "dst")}).drop("p_src", "p_dst")
    df, own = df.where("src <> dst"), ["src", "dst", *keys]
    rest = [c for c in df.columns if c not in own]
    if not rest:
        return df.distinct()
    return df.groupBy(*own).agg(F.min(F.struct(*rest)).alias("least")).select(*own, "least.*")


def copied_from_peer(edges: DataFrame, receiver: str, donor: str, column: str, unknown: str = "unknown") -> DataFrame:
    """Edges (lo, hi, source, column): where the receiver's value is unknown it takes the donor's on the same pair.

    One set-based pass; unknown values of the donor are never handed on.
    """
    known = edges.where((F.col("source") == donor) & (F.col(column) != unknown))
    known = known.groupBy("lo", "hi").agg(F.min(column).alias("given"))
    df = edges.join(known, ["lo", "hi"], "left")
    takes = (F.col("source") == receiver) & (F.col(column) == unknown)
    return df.withColumn(column, F.when(takes, F.coalesce("given", F.col(column))).otherwise(F.col(column))).drop("given")
