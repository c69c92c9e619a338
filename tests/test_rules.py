"""Rules as tables against plain Python on random texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from medloom.operators import rules, safety


def _texts(rng, n, letters="ab "):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))).strip() for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_pieces_endings_and_names(spark, seed):
    rng = random.Random(seed)
    texts, pieces = [*_texts(rng, 60), "", None], [*_texts(rng, 25), "", None]
    t, p = (spark.createDataFrame([(x,) for x in rows], f"{c} string") for rows, c in ((texts, "t"), (pieces, "p")))
    pairs = {(a, b) for a in texts for b in pieces if a is not None and b}
    take = lambda df: {(r.t, r.p) for r in df.collect()}
    assert take(rules.containing(t, "t", p, "p")) == {(a, b) for a, b in pairs if b in a}
    assert take(rules.ending(t, "t", p, "p")) == {(a, b) for a, b in pairs if a.endswith(b)}
    words = lambda x: " ".join(x.split())
    t, p = (spark.createDataFrame([(words(x) if x is not None else None,) for x in rows], f"{c} string") for rows, c in ((texts, "t"), (pieces, "p")))
    assert take(rules.naming(t, "t", p, "p", 2)) == {(words(a), words(b)) for a, b in pairs if len(words(b)) >= 2 and f" {words(b)} " in f" {words(a)} "}


def test_no_rules_and_no_terms(spark):
    t, none = spark.createDataFrame([("x y",)], "t string"), spark.createDataFrame([], "p string")
    assert [f(t, "t", none, "p").count() for f in (rules.containing, rules.ending, rules.naming)] == [0, 0, 0]
    make = spark.createDataFrame
    drugs = make([("simvastatin", "statin", ), ("Lorazepam", None), ("abc", "x")], "drug string, class string")
    none = make([], "marker string, ending string"), make([("cns depressant", "lorazepam")], "marker string, name string"), make([], "term string, drug string")
    found = rules.term_drugs(make([("CNS depressants",), ("abc",), (None,), ("Lorazepam-like",)], "term string"), drugs, make([], "term string, fragment string"), *none)
    assert {tuple(r) for r in found.collect()} == {("CNS depressants", "Lorazepam"), ("Lorazepam-like", "Lorazepam")}


def test_classes_that_were_warned_of(spark):
    rows = [(1, "c", "a"), (1, "c", "b"), (1, "d", "a"), (1, "d", "e"), (2, "c", "a"), (2, "c", "a"), (3, None, "a"), (3, "", "b")]
    named = spark.createDataFrame([(p, i, i, c) for p, c, i in rows], "patient int, drug string, ingredient string, class string")
    flagged = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a")], "patient int, ingredient string")
    assert {tuple(r) for r in safety.duplicate_classes(named, flagged).collect()} == {(1, "d", 2)}
    assert {tuple(r) for r in safety.duplicate_classes(named, flagged.where(F.lit(False))).collect()} == {(1, "c", 2), (1, "d", 2)}
