"""A medication graph projected from the driver's tables, in Spark and, word for word, in SQL.

Drugs are parts; enzymes are suppliers; lineitem rows by return flag are inhibits (R), is-substrate-of (A) and induces (N);
orders are patients; direct edges are parts that share an order. Names of parts repeat, so keys join, never names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Fixed value: lines for one part of the patients.
LINES = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> int:
    """How many parts the patients are dealt to: one for each `LINES` lines, so that a task's share does not grow with the tables."""
    return 1 + table(spark, sf_dir, "lineitem").count() // LINES


def dealt(spark: SparkSession, sf_dir: str, df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys as the patients are dealt."""
    return df.repartition(parts(spark, sf_dir), *keys)


def drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drug, name, class, brand, nti, acb."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("drug"), F.col("p_name").alias("name"), F.col("p_type").alias("class"), F.col("p_brand").alias("brand"),
        (F.col("p_size") % 10 == 0).alias("nti"), (F.col("p_size") % 4).alias("acb"),
    )


def mechanism(spark: SparkSession, sf_dir: str, flag: str, column: str, words: tuple[str, str, str]) -> DataFrame:
    """src, dst, a band by the smallest line number, confidence."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    edges = lines.groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(
        F.min("l_linenumber").alias("num"), F.round(F.max(1 - F.col("l_discount")), 4).alias("confidence")
    )
    band = F.when(F.col("num") == 1, words[0]).when(F.col("num") <= 3, words[1]).otherwise(words[2])
    return edges.select("src", "dst", band.alias(column), "confidence")


def inhibits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mechanism(spark, sf_dir, "R", "strength", ("strong", "moderate", "weak"))


def substrates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mechanism(spark, sf_dir, "A", "fraction", ("major", "moderate", "minor"))


def induces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mechanism(spark, sf_dir, "N", "strength", ("strong", "moderate", "weak"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient, drug, age: each drug of a patient once, dealt by patients so that every later step by patient stays in place."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("patient"), (60 + F.col("o_custkey") % 30).alias("age"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("patient"), F.col("l_partkey").alias("drug"))
    lines = lines.repartition(parts(spark, sf_dir), "patient").distinct()
    return lines.join(orders, "patient").select("patient", "drug", "age")


def direct_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lo, hi, severity, source, source_rank, evidence, guideline, seq: one edge for each order that holds both."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("drug"))
    lines = lines.repartition(parts(spark, sf_dir), "seq").distinct()
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "F", "major").when(F.col("o_orderstatus") == "O", "moderate").otherwise("unknown").alias("severity"),
        F.col("o_orderpriority").alias("source"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("source_rank"),
        F.lit(None).cast("string").alias("evidence"), F.col("o_orderpriority").startswith("1").alias("guideline"),
    )
    pairs = lines.withColumnRenamed("drug", "lo").join(lines.withColumnRenamed("drug", "hi"), "seq").where("lo < hi")
    return pairs.join(orders, "seq")


def dealt_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direct edges, dealt by pairs as the patients are dealt, for steps that group or look them up by pair."""
    return direct_edges(spark, sf_dir).repartition(parts(spark, sf_dir), "lo", "hi")


GRAPH = """WITH drugs AS (
  SELECT p_partkey AS drug, p_name AS name, p_type AS class, p_brand AS brand, p_size % 10 = 0 AS nti, p_size % 4 AS acb FROM part
), mech AS (
  SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS flag, min(l_linenumber) AS num, round(max(1 - l_discount), 4) AS confidence
  FROM lineitem GROUP BY ALL
), inhibits AS (
  SELECT src, dst, CASE WHEN num = 1 THEN 'strong' WHEN num <= 3 THEN 'moderate' ELSE 'weak' END AS strength, confidence FROM mech WHERE flag = 'R'
), substrates AS (
  SELECT src, dst, CASE WHEN num = 1 THEN 'major' WHEN num <= 3 THEN 'moderate' ELSE 'minor' END AS fraction, confidence FROM mech WHERE flag = 'A'
), induces AS (
  SELECT src, dst, CASE WHEN num = 1 THEN 'strong' WHEN num <= 3 THEN 'moderate' ELSE 'weak' END AS strength, confidence FROM mech WHERE flag = 'N'
), baskets AS (
  SELECT DISTINCT l_orderkey AS patient, l_partkey AS drug, 60 + o_custkey % 30 AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), edges AS (
  SELECT a.drug AS lo, b.drug AS hi, a.patient AS seq, o_orderpriority AS source, 6 - substr(o_orderpriority, 1, 1)::INT AS source_rank,
         CASE o_orderstatus WHEN 'F' THEN 'major' WHEN 'O' THEN 'moderate' ELSE 'unknown' END AS severity,
         starts_with(o_orderpriority, '1') AS guideline
  FROM baskets a JOIN baskets b ON a.patient = b.patient AND a.drug < b.drug JOIN orders ON o_orderkey = a.patient
), sevrank AS (
  SELECT * FROM (VALUES ('critical', 5), ('major', 4), ('moderate', 3), ('minor', 2), ('unknown', 1)) t(severity, rank)
)"""
