"""Evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, truth: Column, predicted: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and ratios of a binary prediction; a ratio without cases is null."""
    n = lambda c: F.count_if(c)
    df = rows.groupBy(*keys).agg(
        n(truth & predicted).alias("tp"), n(~truth & predicted).alias("fp"), n(truth & ~predicted).alias("fn"), n(~truth & ~predicted).alias("tn")
    )
    ratio = lambda a, b: F.round(F.try_divide(a, b), 4)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({
        "sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "ppv": ratio(tp, tp + fp), "npv": ratio(tn, tn + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    })


def weighted_kappa(rows: DataFrame, expected: str, observed: str, labels: list) -> DataFrame:
    """Quadratic weighted kappa over ordered labels: one row (n, kappa); 1 where everything agrees by necessity."""
    place = lambda c: F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(c)) - 1
    cells = rows.select(place(expected).alias("i"), place(observed).alias("j")).where("i >= 0 and j >= 0")
    cells = cells.groupBy("i", "j").agg(F.count("*").cast("double").alias("n"))
    across, down = (cells.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in ("i", "j"))
    span = float(max(1, (len(labels) - 1) ** 2))
    weight = (F.col("i") - F.col("j")) * (F.col("i") - F.col("j")) / F.lit(span)
    seen = cells.agg(F.sum("n").alias("n"), F.sum(weight * F.col("n")).alias("seen"))
    # the margins have one row a label
    chance = across.crossJoin(down).agg(F.sum(weight * F.col("n_i") * F.col("n_j")).alias("chance"))
    kappa = F.when(F.col("chance") == 0, 1.0).otherwise(1 - F.col("seen") * F.col("n") / F.col("chance"))
    return seen.crossJoin(chance).select(F.col("n").cast("long").alias("n"), F.round(kappa, 4).alias("kappa"))


def latencies(rows: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, and linearly interpolated percentiles 50, 95 and 99."""
    p = lambda q: F.round(F.percentile(value, F.lit(q)), 4)
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99")
    )


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.round(F.size(F.array_intersect(a, b)) / union, 4)).otherwise(0.0)


def gate(value: Column, comparator: Column, target: Column) -> Column:
    """pass, needs-review, or pending-data where there is no value."""
    met = F.when(comparator == ">=", value >= target).when(comparator == "<=", value <= target).otherwise(value == target)
    return F.when(value.isNull(), "pending-data").when(met, "pass").otherwise("needs-review")
