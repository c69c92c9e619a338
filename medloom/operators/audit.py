"""Audits: declared checks and breakdowns of tables, compiled to one aggregate a table, with a verdict for each check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Check(NamedTuple):
    """An aggregate of a table and the bounds that it must keep (None: open)."""

    name: str
    table: str
    measure: Column
    low: float | None = None
    high: float | None = None


class Breakdown(NamedTuple):
    """Numbers of rows by a column, of the rows where a condition holds."""

    name: str
    table: str
    by: str
    where: Column | None = None


def _of_table(df: DataFrame, checks: Sequence[Check], breakdowns: Sequence[Breakdown]) -> DataFrame:
    """check, item, value: all of a table's checks and breakdowns in one scan.

    Breakdowns are grouping sets beside the total, so rows are expanded once, in front of the partial aggregation.
    """
    columns = {f"_b{i}": F.when(b.where if b.where is not None else F.lit(True), F.coalesce(F.col(b.by).cast("string"), F.lit("(none)"))) for i, b in enumerate(breakdowns)}
    measures = [c.measure.cast("double").alias(f"_m{i}") for i, c in enumerate(checks)]
    if not breakdowns:
        row = df.agg(*measures)
        return row.select(F.inline(F.array(*[F.struct(F.lit(c.name).alias("check"), F.lit(None).cast("string").alias("item"), F.col(f"_m{i}").alias("value")) for i, c in enumerate(checks)])))
    keyed = df.withColumns(columns)
    keys = [F.col(k) for k in columns]
    grouped = keyed.groupingSets([*[[k] for k in keys], []], *keys).agg(F.grouping_id(*keys).alias("_g"), F.count("*").alias("_n"), *measures)
    every = (1 << len(keys)) - 1
    of = lambda i: every - (1 << (len(keys) - 1 - i))
    total = [F.struct(F.lit(c.name).alias("check"), F.lit(None).cast("string").alias("item"), F.col(f"_m{i}").alias("value")) for i, c in enumerate(checks)]
    part = [F.when((F.col("_g") == of(i)) & F.col(k).isNotNull(), F.array(F.struct(F.lit(b.name).alias("check"), F.col(k).alias("item"), F.col("_n").cast("double").alias("value")))) for (i, b), k in zip(enumerate(breakdowns), columns, strict=True)]
    rows = F.coalesce(F.when(F.col("_g") == every, F.array(*total)) if total else F.lit(None), *part)
    return grouped.select(rows.alias("r")).where("r is not null").select(F.inline("r"))


def audited(tables: Mapping[str, DataFrame], checks: Sequence[Check], breakdowns: Sequence[Breakdown] = ()) -> DataFrame:
    """check, item, value, verdict: a row for each check (item null; verdict pass, fail, or info without bounds) and for each
    value of a breakdown (null values as `(none)`; verdict info). A check over no rows has the value of its aggregate; a null fails any bound."""
    parts = []
    for name, df in tables.items():
        own, split = [c for c in checks if c.table == name], [b for b in breakdowns if b.table == name]
        if own or split:
            parts.append(_of_table(df, own, split))
    if unknown := {c.table for c in (*checks, *breakdowns)} - set(tables):
        raise ValueError(f"no such tables: {sorted(unknown)}")
    rows = reduce(DataFrame.unionByName, parts)
    low, high = ({c.name: getattr(c, side) for c in checks if getattr(c, side) is not None} for side in ("low", "high"))
    bound = lambda table: F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("check")) if table else F.lit(None).cast("double")
    kept = F.coalesce(F.col("value") >= bound(low), bound(low).isNull()) & F.coalesce(F.col("value") <= bound(high), bound(high).isNull())
    free = F.col("item").isNotNull() | (bound(low).isNull() & bound(high).isNull())
    return rows.withColumn("verdict", F.when(free, "info").when(kept & F.col("value").isNotNull(), "pass").otherwise("fail"))


def held(expected: DataFrame, found: DataFrame, case: str, value: str) -> DataFrame:
    """Each distinct expectation (case, value) with what was found for the case (of several values the expected one, else the
    least) and a verdict: pass, fail (another value), or missing (the case was not found or has no value)."""
    wanted = expected.select(case, F.col(value).alias("_want")).distinct()
    rows = wanted.join(found.select(case, F.col(value).alias("_got")), case, "left")
    got = F.min(F.struct(~F.coalesce(F.col("_got") == F.col("_want"), F.lit(False)), F.col("_got").isNull(), "_got")).alias("x")
    best = rows.groupBy(case, "_want").agg(got).select(case, F.col("_want").alias("expected"), F.col("x._got").alias("found"))
    verdict = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("expected"), "pass").otherwise("fail")
    return best.withColumn("verdict", verdict)
