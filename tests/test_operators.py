"""Cases of the domain: mechanisms, criteria, burden, duplication, claims, herbs without data."""

from __future__ import annotations

from pyspark.sql import functions as F

from medloom.operators import graph as G
from medloom.operators import merge as M
from medloom.operators import metrics as E
from medloom.operators import resolve as R
from medloom.operators import safety, severity


def basket(spark, *drugs, age=72):
    return spark.createDataFrame([(1, d, age) for d in drugs], "patient int, drug string, age int")


def edges(spark, column, *rows):
    return spark.createDataFrame(list(rows), f"src string, dst string, {column} string, confidence double")


def test_inhibited_metabolism(spark):
    drugs = spark.createDataFrame([("simvastatin", False), ("clarithromycin", False)], "drug string, nti boolean")
    found = safety.metabolic(
        basket(spark, "clarithromycin", "simvastatin"), edges(spark, "strength", ("clarithromycin", "CYP3A4", "strong", 0.9)),
        edges(spark, "fraction", ("simvastatin", "CYP3A4", "major", 1.0)), drugs,
    ).collect()
    assert [(r.a, r.mid, r.b, r.score, r.confidence) for r in found] == [("clarithromycin", "CYP3A4", "simvastatin", 10.8, 0.81)]


def test_cascade_never_pairs_a_drug_with_itself(spark):
    both = edges(spark, "x", ("furosemide", "potassium", "", 1.0), ("digoxin", "potassium", "", 1.0))
    found = safety.cascade(basket(spark, "furosemide", "digoxin"), edges(spark, "x", ("furosemide", "potassium", "", 1.0)), both).collect()
    assert [(r.a, r.b) for r in found] == [("furosemide", "digoxin")]


def test_shared_effect_is_unordered(spark):
    causes = edges(spark, "x", ("amiodarone", "QT", "", 1.0), ("ondansetron", "QT", "", 1.0))
    found = safety.shared_effect(basket(spark, "ondansetron", "amiodarone", age=60), causes, "qt").collect()
    assert [(r.a, r.b, r.score) for r in found] == [("amiodarone", "ondansetron", 8.0)]


def test_burden(spark):
    drugs = spark.createDataFrame([("diphenhydramine", 3), ("amitriptyline", 3), ("metformin", 0)], "drug string, acb int")
    total = lambda *names: safety.burden(basket(spark, *names), drugs).first()
    assert (total("diphenhydramine", "amitriptyline").total, total("metformin").band) == (6, "low")


def test_duplicates(spark):
    rows = [(1, "a", "ibuprofen", "nsaid"), (1, "b", "diclofenac", "nsaid"), (2, "c", "metformin", "biguanide"), (2, "d", "amlodipine", "ccb"), (3, "e", "aspirin", "x"), (3, "f", "aspirin", "x")]
    found = safety.duplicates(spark.createDataFrame(rows, "patient int, drug string, ingredient string, class string")).collect()
    assert {(r.patient, r.kind, r.what) for r in found} == {(1, "class", "nsaid"), (3, "ingredient", "aspirin")}


def test_criteria_need_age(spark):
    drugs = spark.createDataFrame([("nitrofurantoin", False, True)], "drug string, listed boolean, renal boolean")
    kidneys = spark.createDataFrame([(1, "chronic Kidney disease")], "patient int, condition string")
    rules = spark.createDataFrame([("nitrofurantoin", "kidney")], "drug string, word string")
    pairs = spark.createDataFrame([], "lo string, hi string")
    found = lambda age: {r.rule for r in safety.criteria(basket(spark, "nitrofurantoin", age=age), drugs, kidneys, rules, pairs).collect()}
    assert found(65) == {"condition", "renal"}
    assert found(64) == set()


def test_herb_without_data_is_never_safe(spark):
    tier = lambda known, data: spark.range(1).select(safety.herb_tier(F.lit(known), F.lit(data))).first()[0]
    assert [tier(False, False), tier(True, False), tier(True, True)] == ["unknown_herb", "known_without_data", "known_with_data"]


def test_side_effects_put_unknown_frequencies_last(spark):
    effects = spark.createDataFrame([("a", "rash", None), ("a", "pain", 0.2), ("a", "cough", 0.01)], "drug string, effect string, frequency double")
    assert [r.effect for r in safety.side_effects(effects.select("drug"), effects, 2).orderBy("rank").collect()] == ["pain", "cough"]


def test_best_row_breaks_ties_by_seq(spark):
    rows = spark.createDataFrame([("k", 1, 5, "b"), ("k", 1, 4, "a"), ("k", 0, 1, "c")], "key string, p int, seq int, v string")
    assert M.best_row(rows, ["key"], [F.col("p")], F.col("seq")).first().v == "a"


def test_reachability_stops_and_finds_the_fewest_hops(spark):
    path = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "c")], "src string, dst string")
    found = {r.node: r.hops for r in G.reachable(path, spark.createDataFrame([("a",)], "start string"), 2).collect()}
    assert found == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_copied_severity_never_hands_on_unknown(spark):
    rows = [("a", "b", "x", "unknown"), ("a", "b", "y", "unknown"), ("c", "d", "x", "unknown"), ("c", "d", "y", "major")]
    edges_ = spark.createDataFrame(rows, "lo string, hi string, source string, severity string")
    found = {(r.lo, r.source): r.severity for r in M.copied_from_peer(edges_, "x", "y", "severity").collect()}
    assert (found["a", "x"], found["c", "x"]) == ("unknown", "major")


def test_tiers(spark):
    df = spark.createDataFrame([("unknown", ["Cardiac Arrest"], False), (None, [], True), ("unknown", [], False), ("Minor", [], True)], "severity string, events array<string>, nti boolean")
    out = severity.inferred(df, [severity.event_tier(F.col("events")), severity.rule_tier(F.col("nti"), F.lit(False))], "minor").collect()
    assert [(r.severity, r.method, r.review_needed) for r in out] == [
        ("major", "shared_events", False), ("major", "pharmacology_rule", False), ("minor", "default", True), ("minor", "original", False)]


def test_cascade_returns_unresolved_names(spark):
    names = spark.createDataFrame([("Acetylsalicylic acid",), ("zzz",)], "raw string")
    synonyms = spark.createDataFrame([("acetylsalicylic acid", "aspirin")], "key string, entity string")
    found = {r.raw: (r.entity, r.match_type) for r in R.cascade(names, "raw", [("synonym", synonyms)]).collect()}
    assert found == {"Acetylsalicylic acid": ("aspirin", "synonym"), "zzz": (None, "none")}


def test_claims(spark):
    claims = spark.createDataFrame([("x", "e", "y", 0.9), ("x", "e", "z", 0.5), ("q", "e", "z", 0.5)], "a string, mid string, b string, confidence double")
    out = safety.verified(claims, edges(spark, "strength", ("x", "e", "strong", 1.0)), edges(spark, "fraction", ("y", "e", "major", 1.0)))
    found = {(r.a, r.b): (r.verdict, r.confidence, r.is_ai_assessed) for r in out.collect()}
    assert found == {("x", "y"): ("confirmed", 0.825, False), ("x", "z"): ("partial", 0.4, True), ("q", "z"): ("removed", 0.5, True)}


def test_kappa_of_agreement(spark):
    rows = spark.createDataFrame([(i % 4, i % 4) for i in range(40)], "e int, o int")
    assert E.weighted_kappa(rows, "e", "o", [0, 1, 2, 3]).first().kappa == 1.0


def test_entity_merge_drops_self_edges(spark):
    nodes = spark.createDataFrame([("Aspirin", "1", 3), ("aspirin ec", "1", 1), ("warfarin", "2", 1)], "node string, same string, degree int")
    links = spark.createDataFrame([("aspirin ec", "Aspirin"), ("aspirin ec", "warfarin"), ("Aspirin", "warfarin")], "src string, dst string")
    found = M.rewired(links, M.primaries(nodes, "node", "same", "degree"), []).collect()
    assert [(r.src, r.dst) for r in found] == [("Aspirin", "warfarin")]
