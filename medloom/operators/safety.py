"""Checks over patients' medicine lists. `baskets` has a row for each (patient, drug, age); all patients go in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.functions import scoring as S
from medloom.operators import graph as G
from medloom.operators import merge as M

# Fixed value: words that name a condition of the kidney.
KIDNEY = "kidney|renal|ckd|creatinine|egfr|nephro"
GERIATRIC_AGE = 65


def direct(baskets: DataFrame, edges: DataFrame) -> DataFrame:
    """The best edge of each pair of a patient's drugs: by severity, source and evidence; all sources counted."""
    priority = [S.ranked(F.col("severity"), S.SEVERITY_RANK, 1), F.col("source_rank"), S.ranked(F.col("evidence"), S.EVIDENCE_RANK, 0)]
    # the best edge of a pair is the same for every patient
    best = M.best_row(edges, ["lo", "hi"], priority, F.col("seq"), sources=F.countDistinct("source"), flagged=F.bool_or("guideline"))
    hits = G.pairwise_edges(baskets, best, "patient", "drug")
    return hits.withColumn("confidence", S.source_confidence(F.col("sources"), F.col("flagged")))


def metabolic(
    baskets: DataFrame, changes: DataFrame, substrates: DataFrame, drugs: DataFrame, induces: bool = False, met: DataFrame | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Drugs that inhibit (or induce) what metabolises another: score and confidence of each path.

    changes: src, dst, strength, confidence; substrates: src, dst, fraction, confidence; drugs: drug, nti.
    """
    paths = G.two_hop(baskets, changes, substrates, "patient", "drug", carried=("age",), met=met, parts=parts)
    paths = paths.join(drugs.select(F.col("drug").alias("b"), "nti"), "b")
    nti, age = F.coalesce("nti", F.lit(False)), F.col("age")
    score = S.induction_score(nti, age) if induces else S.inhibition_score(F.col("a_strength"), F.col("b_fraction"), nti, age)
    confidence = S.path_confidence(F.col("a_confidence"), F.col("b_confidence"))
    kind = F.lit("induction" if induces else "inhibition")
    return paths.select("patient", "a", "b", "mid", kind.alias("mechanism"), score.alias("score"), confidence.alias("confidence"))


def shared_effect(baskets: DataFrame, causes: DataFrame, effect: str, met: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Pairs of drugs that cause the same effect (qt, cns)."""
    pairs = G.shared_neighbour(baskets, causes, "patient", "drug", ("age",), met, parts)
    return pairs.select(
        "patient", "a", "b", "mid", F.lit(effect).alias("mechanism"), S.effect_score(effect, F.col("age")).alias("score"),
        S.path_confidence(F.col("a_confidence"), F.col("b_confidence")).alias("confidence"),
    )


def cascade(baskets: DataFrame, depletes: DataFrame, sensitive: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """A drug that depletes what another is sensitive to; never a drug with itself."""
    paths = G.two_hop(baskets, depletes, sensitive, "patient", "drug", carried=("age",), met=met)
    return paths.select(
        "patient", "a", "b", "mid", F.lit("electrolyte").alias("mechanism"), S.effect_score("electrolyte", F.col("age")).alias("score"),
        S.path_confidence(F.col("a_confidence"), F.col("b_confidence")).alias("confidence"),
    )


def with_herbs(herbs: DataFrame, baskets: DataFrame, edges: DataFrame, changes: DataFrame, substrates: DataFrame) -> DataFrame:
    """Herbs (patient, herb) against drugs: direct edges (src, dst, severity), and herb -> enzyme <- drug paths."""
    pairs = herbs.join(baskets.select("patient", "drug"), "patient")
    # edges made by an explode are many more than they are taken for, so they are never sent whole to every task
    straight = pairs.join(edges.hint("merge"), (F.col("herb") == F.col("src")) & (F.col("drug") == F.col("dst")))
    straight = straight.select("patient", "herb", "drug", "severity", F.lit("direct").alias("mechanism"))
    # which herb reaches which drug does not depend on the patient
    first = changes.join(herbs.select(F.col("herb").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("herb"), "dst")
    reach = first.join(substrates.select(F.col("src").alias("drug"), "dst"), "dst").select("herb", "drug").distinct()
    path = pairs.select("patient", "herb", "drug").join(reach, ["herb", "drug"], "left_semi")
    path = path.select("patient", "herb", "drug", F.lit("moderate").alias("severity"), F.lit("metabolic").alias("mechanism"))
    return straight.unionByName(path.distinct())


def herb_tier(in_database: Column, has_data: Column) -> Column:
    """What is known of a herb; without data a herb is never called safe."""
    return F.when(~in_database, "unknown_herb").when(~has_data, "known_without_data").otherwise("known_with_data")


def criteria(baskets: DataFrame, drugs: DataFrame, conditions: DataFrame, rules: DataFrame, pairs: DataFrame) -> DataFrame:
    """Screening of patients from 65: listed drugs, drug against condition, drug pairs, renal dosing.

    drugs: drug, listed, renal; conditions: patient, condition; rules: drug, word; pairs: lo, hi.
    """
    old = baskets.where(F.col("age") >= GERIATRIC_AGE)
    mine = old.join(drugs, "drug")
    row = lambda df, rule, what: df.select("patient", "drug", F.lit(rule).alias("rule"), what.cast("string").alias("detail"))
    listed = row(mine.where("listed"), "listed", F.lit(""))
    against = old.join(rules, "drug").join(conditions, "patient").where(F.lower("condition").contains(F.lower("word")))
    against = row(against, "condition", F.col("word")).distinct()
    both = G.pairwise_edges(old, pairs.select("lo", "hi").distinct(), "patient", "drug")
    both = row(both.withColumn("drug", F.col("lo")), "pair", F.col("hi"))
    kidneys = conditions.where(F.lower("condition").rlike(KIDNEY)).select("patient").distinct()
    renal = row(mine.where("renal").join(kidneys, "patient", "left_semi"), "renal", F.lit(""))
    return listed.unionByName(against).unionByName(both).unionByName(renal)


def burden(baskets: DataFrame, drugs: DataFrame) -> DataFrame:
    """Anticholinergic burden of each patient: total, band, and the drugs that add to it."""
    mine = baskets.select("patient", "drug").distinct().join(drugs.select("drug", "acb"), "drug")
    total = F.sum(F.coalesce("acb", F.lit(0))).cast("long")
    df = mine.groupBy("patient").agg(total.alias("total"), F.count_if(F.col("acb") > 0).alias("contributors"))
    return df.withColumn("band", S.burden_band(F.col("total")))


def duplicates(named: DataFrame) -> DataFrame:
    """Repeated ingredients and classes of a list (patient, drug, ingredient, class), on the raw inputs.

    A class counts where it has two or more ingredients; the same ingredient twice is reported as such only.
    """
    same = named.groupBy("patient", "ingredient").agg(F.count("*").alias("n")).where("n > 1")
    same = same.select("patient", F.lit("ingredient").alias("kind"), F.col("ingredient").alias("what"), "n")
    classes = named.where("class is not null and class <> ''").groupBy("patient", "class").agg(F.countDistinct("ingredient").alias("n"))
    classes = classes.where("n > 1").select("patient", F.lit("class").alias("kind"), F.col("class").alias("what"), "n")
    return same.unionByName(classes)


def duplicate_classes(named: DataFrame, flagged: DataFrame) -> DataFrame:
    """(patient, class, n): classes of two or more ingredients of a list, unless all of their ingredients are flagged already
    (patient, ingredient): what a warning has been given for is not warned of again."""
    rows = named.where("class is not null and class <> ''").select("patient", "class", "ingredient").distinct()
    known = flagged.select("patient", "ingredient").distinct().withColumn("known", F.lit(1))
    groups = rows.join(known, ["patient", "ingredient"], "left").groupBy("patient", "class")
    return groups.agg(F.count("*").alias("n"), F.count("known").alias("k")).where("n > 1 and k < n").select("patient", "class", "n")


def side_effects(drugs: DataFrame, effects: DataFrame, most: int = 5) -> DataFrame:
    """The most frequent effects of each drug (drug, effect, frequency); frequencies are numbers, unknown ones last."""
    mine = effects.join(drugs.select("drug").distinct(), "drug", "left_semi")
    return M.top_per_key(mine, ["drug"], [F.col("frequency").desc_nulls_last(), F.col("effect")], most)


def verified(claims: DataFrame, changes: DataFrame, substrates: DataFrame) -> DataFrame:
    """Claims (a, mid, b, confidence) held against the graph: both hops confirm, one keeps with less, none removes."""
    one = changes.select(F.col("src").alias("a"), F.col("dst").alias("mid"), F.lit(1).alias("hop_a")).distinct()
    two = substrates.select(F.col("src").alias("b"), F.col("dst").alias("mid"), F.lit(1).alias("hop_b")).distinct()
    df = claims.join(one, ["a", "mid"], "left").join(two, ["b", "mid"], "left")
    hops = F.coalesce("hop_a", F.lit(0)) + F.coalesce("hop_b", F.lit(0))
    verdict = F.when(hops == 2, "confirmed").when(hops == 1, "partial").otherwise("removed")
    df = df.withColumns({"verdict": verdict, "confidence": S.verified_confidence(F.col("confidence"), hops)})
    return df.withColumn("is_ai_assessed", F.col("verdict") != "confirmed").drop("hop_a", "hop_b")


def new_pairs(found: DataFrame, known: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Findings whose unordered pair no known finding of the patient has."""
    pair = lambda df: df.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)})
    return pair(found).join(pair(known).select("patient", "lo", "hi").distinct(), ["patient", "lo", "hi"], "left_anti")


def summary(findings: DataFrame) -> DataFrame:
    """Findings (patient, severity, score) counted by display severity; all kinds count."""
    shown = findings.withColumn("shown", S.display_severity(F.col("severity"), F.col("score")))
    kinds = ("critical", "major", "moderate", "minor", "doctor_review")
    return shown.groupBy("patient").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("shown") == k).alias(f"n_{k}") for k in kinds]
    )


def report(findings: DataFrame, most: int = 15) -> DataFrame:
    """The most serious findings of each patient with ids finding_1 ...; ties by mechanism and pair."""
    shown = S.display_severity(F.col("severity"), F.col("score"))
    df = findings.withColumn("shown", shown)
    rank = S.ranked(F.col("shown"), S.SEVERITY_RANK, 1)
    metabolic_path = F.col("mechanism").isin("inhibition", "induction")
    df = df.withColumn("priority", S.finding_priority(rank, metabolic_path))
    top = M.top_per_key(df, ["patient"], [F.col("priority").desc(), F.col("score").desc_nulls_last(), *map(F.col, ("mechanism", "a", "b", "mid"))], most)
    return top.withColumn("finding_id", F.concat(F.lit("finding_"), F.col("rank").cast("string")))
