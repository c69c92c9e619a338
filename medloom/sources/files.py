"""Readers of the file layouts that datasets come in. Encodings and separators are stated, never guessed from a prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(
    spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", multi_line: bool = False, **options: str
) -> DataFrame:
    """Delimited text with a header, all columns as text; a folder is read with all its files.

    multi_line: quoted fields may hold line breaks; Spark then cannot split a file, so each is one task.
    """
    reader = spark.read.options(header=True, sep=sep, encoding=encoding, quote='"', escape='"', multiLine=multi_line, **options)
    return reader.option("pathGlobFilter", options.get("pathGlobFilter", "*")).csv(path)


def with_header(df: DataFrame, aliases: dict[str, tuple[str, ...]], required: tuple[str, ...]) -> DataFrame:
    """Columns under their own names: each takes the first column whose name is an alias, regardless of case and signs.

    Missing columns become null; a missing required one raises ValueError.
    """
    plain = lambda name: "".join(c for c in name.lower() if c.isalnum())
    have = {plain(c): c for c in reversed(df.columns)}
    found = {own: next((have[plain(a)] for a in (own, *names) if plain(a) in have), None) for own, names in aliases.items()}
    if missing := [c for c in required if not found[c]]:
        raise ValueError(f"columns missing: {', '.join(missing)}; there are {', '.join(df.columns)}")
    column = lambda c: F.col(f"`{c}`") if c else F.lit(None).cast("string")
    return df.select(*[column(c).alias(own) for own, c in found.items()])


def read_positional(spark: SparkSession, path: str, names: dict[int, str], sep: str = "\t") -> DataFrame:
    """Text without a header by position; rows that are too short for the last named column go. Gzip files are read as such."""
    width = max(names) + 1
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(width)])
    df = spark.read.options(sep=sep, header=False, mode="PERMISSIVE").schema(schema).csv(path)
    return df.where(F.col(f"_{width - 1}").isNotNull()).select(*[F.col(f"_{i}").alias(n) for i, n in names.items()])


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document that spans lines, by a stated schema; use F.inline on its arrays."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_mapping(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object of objects as rows (key, value columns); `value` is the schema of the inner object."""
    text = spark.read.option("wholetext", True).text(path)
    entries = F.from_json("value", f"map<string, struct<{value}>>")
    return text.select(F.explode(entries).alias("key", "item")).select("key", "item.*")


def unpivoted(df: DataFrame, key: str, separator: str = r"\s*,\s*") -> DataFrame:
    """A wide table of lists as (key, heading, item): what tables of a web page hold."""
    rest = [c for c in df.columns if c != key]
    long = df.unpivot([key], rest, "heading", "items").where("items is not null")
    items = F.transform(F.split("items", separator), lambda x: F.trim(x))
    return long.select(key, "heading", F.explode(F.filter(items, lambda x: x != "")).alias("item"))


def matched_lines(df: DataFrame, text: str, pattern: str, names: tuple[str, ...]) -> DataFrame:
    """Lines of a text that match a pattern, one column a group: what a document's printed table holds."""
    lines = df.select(F.explode(F.split(text, "\n")).alias("line"))
    groups = [F.trim(F.regexp_extract("line", pattern, i + 1)).alias(n) for i, n in enumerate(names)]
    return lines.where(F.col("line").rlike(pattern)).select(*groups)


def bucketed(df: DataFrame, key: Column, buckets: Column, *extra: Column) -> DataFrame:
    """A map of lists as rows (key, bucket, name): {major: [a, b], minor: [c]}."""
    long = df.select(key.alias("key"), *extra, F.explode(buckets).alias("bucket", "names"))
    return long.select("key", *[c for c in long.columns if c not in ("key", "bucket", "names")], "bucket", F.explode("names").alias("name"))


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table, as (label, n)."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n") for name, df in sorted(tables.items())]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return out
