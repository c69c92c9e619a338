"""Writers: node and edge tables replaced in a new place, and evaluation scoreboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes a table to a path that is not the one being read, and reads it; an upsert is a join, then this."""
    df.write.mode("errorifexists").partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(df: DataFrame) -> DataFrame:
    """The table without rows, which is how all of it is deleted."""
    return df.limit(0)


def without(df: DataFrame, condition: Column, *columns: str) -> DataFrame:
    """Rows where a condition holds lose the values of some columns."""
    return df.withColumns({c: F.when(condition, F.lit(None)).otherwise(F.col(c)) for c in columns})


def with_properties(df: DataFrame, old: str, new: str) -> DataFrame:
    """Property maps with new entries over old ones."""
    a, b = F.coalesce(old, F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")), F.coalesce(new, F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return df.withColumn(old, F.map_concat(kept, b)).drop(new)


def write_scoreboard(rows: DataFrame, path: str) -> None:
    """(metric, value, target, status) as JSON lines and as a text table beside it; a scoreboard has few rows."""
    rows.write.mode("errorifexists").json(f"{path}/json")
    line = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns])
    rows.orderBy(rows.columns[0]).select(F.concat(F.lit("| "), line, F.lit(" |")).alias("value")).coalesce(1).write.mode("errorifexists").text(f"{path}/table")
