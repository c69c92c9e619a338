"""Relevance search over names: an inverted index with document frequencies, BM25 scores, match tiers and gates.

Every search variant of a query is a question; equal questions are answered once. Questions and names meet on tokens held by
at most a stated share of the names. Commoner tokens (a dosage form, a unit) add to the score of what was met but bring
no candidates of their own, unless a query has no rarer one in any variant: then the rarest token of each question does, so
the word that all names share never pairs all with all, only each distinct question made of such words with its names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medloom.functions import text
from medloom.sources.shared import stored

# The usual saturation and length parameters of BM25.
K1, B = 1.2, 0.75
#: What a match is, best first.
TIERS = ("phrase", "all", "any")


class Index(NamedTuple):
    """names: name, words; postings: token, name; terms: token, df; and the number and mean length of names."""

    names: DataFrame
    postings: DataFrame
    terms: DataFrame
    many: int
    length: float


def _words(t: Column) -> Column:
    return F.filter(F.split(t, " "), lambda w: w != "")


def build(names: DataFrame, name: str) -> Index:
    """The index of the distinct names, written to the shared folder."""
    rows = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    rows = stored(rows.select("name", _words(text.brand_text(F.col("name"))).alias("words")).where("size(words) > 0"), "fulltext-names")
    sums = rows.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("words")).first()
    postings = stored(rows.select(F.explode(F.array_distinct("words")).alias("token"), "name"), "fulltext-postings")
    terms = stored(postings.groupBy("token").agg(F.count("*").alias("df")), "fulltext-terms")
    return Index(rows, postings, terms, sums["n"], (sums["words"] or 0) / max(1, sums["n"]))


def _weighed(index: Index, questions: DataFrame) -> DataFrame:
    """question, place, token, df, idf: the tokens of questions that the index knows."""
    df = F.col("df").cast("double")
    idf = F.log(1.0 + (F.lit(float(index.many)) - df + 0.5) / (df + 0.5))
    tokens = questions.select("question", F.posexplode(F.split("question", " ")).alias("place", "token"))
    # questions compress so well that millions of them are taken for few bytes: they are merged, not sent whole through the driver
    return tokens.join(index.terms.hint("merge"), "token").withColumn("idf", idf)


def _scored(index: Index, pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """question, name, score, tier of candidate pairs."""
    terms = weights.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("place", "token", "idf"))).alias("terms"))
    rows = pairs.join(terms, "question").join(index.names, "name")
    norm = K1 * (1.0 - B + B * F.size("words").cast("double") / F.lit(max(index.length, 1e-9)))

    def part(total: Column, term: Column) -> Column:
        tf = F.size(F.filter("words", lambda w: w == term["token"])).cast("double")
        return total + term["idf"] * tf / (tf + norm)

    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    phrase = padded(F.array_join("words", " ")).contains(padded(F.col("question")))
    every = F.size(F.array_except(F.split("question", " "), F.col("words"))) == 0
    tier = F.when(phrase, 0).when(every, 1).otherwise(2)
    return rows.select("question", "name", F.aggregate("terms", F.lit(0.0), part).alias("score"), tier.alias("tier"))


def search(index: Index, queries: DataFrame, query: str, most: int = 5, gate: float = 0.0, common: float = 0.05, least: int = 20) -> DataFrame:
    """query, name, score, tier, rank: the `most` best names of each distinct query whose score is above the gate.

    common: the share of names, and least: the number, from which a token counts as common. A name's score is its best over
    the query's variants, its tier the best one too; higher scores come first, then tiers, then names. Scores are rounded to six places before they are compared. A null or empty query gives no rows.
    """
    asked = queries.select(F.col(query).alias("query")).where("query is not null").distinct()
    asked = stored(asked.select("query", F.explode(text.brand_variants(F.col("query"))).alias("question")), "fulltext-questions")
    weights = stored(_weighed(index, asked.select("question").distinct()), "fulltext-weights")
    rare = weights.where(F.col("df") <= max(float(least), common * index.many)).select("question", "token")
    good = asked.join(rare.select("question").distinct(), "question", "left_semi")
    bare = asked.join(good.select("query").distinct(), "query", "left_anti")
    asked = stored(good.unionByName(bare), "fulltext-asked")
    only = weights.join(bare.select("question").distinct(), "question", "left_semi").groupBy("question").agg(F.min(F.struct("df", "token")).alias("t"))
    seeds = rare.unionByName(only.select("question", "t.token"))
    found = stored(_scored(index, seeds.join(index.postings, "token").select("question", "name").distinct(), weights), "fulltext-answers")
    # only the best of a question can be among the best of a query, so the others need not be moved on
    order = W.partitionBy("question").orderBy(F.round("score", 6).desc(), "tier", "name")
    best = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    named = asked.join(best.hint("merge"), "question").select("query", "name").distinct()
    rows = named.join(asked.hint("merge"), "query").join(found.hint("merge"), ["question", "name"])
    rows = rows.groupBy("query", "name").agg(F.round(F.max("score"), 6).alias("score"), F.min("tier").alias("tier")).where(F.col("score") > gate)
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "tier", "name")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    label = F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1)
    return rows.select(F.col("query").alias(query), "name", "score", label.alias("tier"), "rank")
