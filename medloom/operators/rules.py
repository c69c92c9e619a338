"""Rules kept as tables: phrases, fragments, endings and lists that lead from a term to drugs, met on equal keys only.

What a rule asks of a text (to hold a phrase, to contain a fragment, to end in something) is turned into the pieces of that
text which have a rule's length, so no rule is tried on every text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.functions import text

#: Names shorter than this are not looked for inside a term.
LEAST = 5


def _lengths(rows: DataFrame, column: str) -> list[int]:
    """The distinct lengths of a rule table's pieces, of which there are few."""
    return sorted(r[0] for r in rows.select(F.length(column)).distinct().collect() if r[0])


def _pieces(t: Column, lengths: list[int]) -> Column:
    """All parts of a text of some lengths."""
    part = lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[part(n) for n in lengths]))) if lengths else F.array().cast("array<string>")


def containing(texts: DataFrame, column: str, pieces: DataFrame, piece: str) -> DataFrame:
    """The distinct texts of a column with every piece that they contain; blank pieces are contained in nothing."""
    asked = pieces.select(piece).where(F.col(piece) != "").distinct()
    every = texts.select(column).where(F.col(column).isNotNull()).distinct()
    return every.select(column, F.explode(_pieces(F.col(column), _lengths(asked, piece))).alias(piece)).join(asked, piece)


def ending(texts: DataFrame, column: str, endings: DataFrame, end: str) -> DataFrame:
    """The distinct texts of a column with every ending that they have."""
    asked = endings.select(end).where(F.col(end) != "").distinct()
    lengths = _lengths(asked, end)
    every = texts.select(column).where(F.col(column).isNotNull()).distinct()
    if not lengths:
        return every.withColumn(end, F.lit(None).cast("string")).limit(0)
    tails = F.array(*[F.when(F.length(column) >= n, F.right(F.col(column), F.lit(n))) for n in lengths])
    return every.select(column, F.explode(tails).alias(end)).join(asked, end)


def naming(texts: DataFrame, column: str, names: DataFrame, name: str, least: int = LEAST) -> DataFrame:
    """The distinct keys of a column with every name of `least` letters or more that stands in them as whole words."""
    asked = names.select(name).where(F.length(name) >= least).distinct()
    most = asked.agg(F.max(F.size(F.split(name, " ")))).first()[0] or 0
    every = texts.select(column).where(F.col(column).isNotNull()).distinct()
    words = F.split(column, " ")
    runs = lambda i: F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.lit(most), F.size(words) - i), F.lit(1))), lambda n: F.array_join(F.slice(words, i + 1, n), " "))
    phrases = F.array_distinct(F.flatten(F.transform(words, lambda w, i: runs(i))))
    return every.select(column, F.explode(phrases).alias(name)).join(asked, name)


def term_drugs(
    terms: DataFrame, drugs: DataFrame, fragments: DataFrame, endings: DataFrame, lists: DataFrame, explicit: DataFrame
) -> DataFrame:
    """(term, drug): the drugs (drug, class) that each distinct term stands for, by any rule.

    A term names a drug as whole words; fragments (term, fragment) of a drug's class; endings (marker, ending) of a drug's name
    and lists (marker, name), both for terms that contain the marker; explicit (term, drug). All are compared as lookup keys.
    """
    key = lambda df, *columns: df.select(*[text.lookup_key(F.col(c)).alias(c) for c in columns]).distinct()
    asked = terms.select(F.col("term").alias("raw"), text.lookup_key(F.col("term")).alias("term")).distinct()
    known = drugs.select("drug", text.lookup_key(F.col("drug")).alias("name"), F.coalesce(text.lookup_key(F.col("class")), F.lit("")).alias("class"))
    pairs = [naming(asked, "term", known, "name").select("term", "name")]
    wanted = key(fragments, "term", "fragment").join(asked.select("term").distinct(), "term", "left_semi")
    by_class = containing(known, "class", wanted, "fragment").join(wanted, "fragment").select("term", "class").distinct()
    pairs.append(by_class.join(known.select("class", "name"), "class").select("term", "name"))
    for rules, own, met in ((endings, "ending", lambda r: ending(known, "name", r, "ending")), (lists, "name", lambda r: r.select("name").distinct().join(known.select(F.col("name")), "name", "left_semi"))):
        rules = key(rules, "marker", own)
        marked = containing(asked, "term", rules, "marker").join(rules, "marker").select("term", own).distinct()
        pairs.append(marked.join(met(rules), own).select("term", "name"))
    found = reduce(DataFrame.union, pairs).distinct().join(known.select("name", "drug"), "name").select("term", "drug")
    found = found.union(key(explicit, "term").join(asked.select("term").distinct(), "term", "left_semi").join(explicit.select(text.lookup_key(F.col("term")).alias("term"), "drug"), "term"))
    return asked.join(found.distinct(), "term").select(F.col("raw").alias("term"), "drug").distinct()
