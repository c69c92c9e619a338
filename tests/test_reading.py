"""Label texts, entries, names and severities on odd rows and published examples."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from medloom.functions import pharmacology, text
from medloom.operators import medicines, resolve, severity


def _read(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return {r.id: r for r in medicines.extracted(df, "t", ["id"]).collect()}


def test_label_texts(spark):
    rows = _read(spark, [
        "Dolo 650\nEach uncoated tablet\nEach tablet contains: Paracetamol IP 650 mg.",
        "Composition:\nPAN 40 tablet\nPantoprazole Sodium IP 40 mg gastro resistant tablet",
        "Warning: x\n  \nOK\nUrimax D\nEach film coated capsule contain Tamsulosin Hydrochloride equivalent to Tamsulosin 400 mcg + Dutasteride 500 MCG, Lactose",
        "nothing here", "", None, "Each tablet contains: 5 mg.", "Each ml contains Iron 2.5 mg",
    ])
    assert set(rows) == {0, 1, 2, 7} and rows[7].generic_name == "Iron 2"  # the sentence ends at the first full stop, as published
    assert (rows[0].brand_name, rows[0].generic_name, rows[0].dosage_form, rows[0].confidence) == ("Dolo 650", "Paracetamol", "tablet", 0.72)
    assert [tuple(i) for i in rows[1].ingredients] == [("Pantoprazole Sodium", "40mg")]
    assert [tuple(i) for i in rows[2].ingredients] == [("Tamsulosin", "400mcg"), ("Dutasteride", "500MCG"), ("Lactose", "")]


def test_names_of_a_cell(spark):
    cells = ["Omeprazole (a, b)", "S-Warfarin", "Abacavir/Lamivudine (Kivexa)", " - ", None, "plain,;"]
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, c string").select("i", medicines.candidate_names(F.col("c")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {
        0: ["Omeprazole"], 1: ["S-Warfarin", "Warfarin"], 2: ["Abacavir/Lamivudine (Kivexa)", "Abacavir/Lamivudine", "Kivexa", "Abacavir", "Lamivudine (Kivexa)"], 3: [], 4: [], 5: ["plain"],
    }


def test_quality_of_brands_and_terms(spark):
    given = [("Dolo 650", 6), ("10 tablets", -8), ("", -5), (None, -5), ("Dolo tablet", 4), ("12", -3)]
    df = spark.createDataFrame(given, "b string, want int")
    assert df.where(medicines.brand_quality(F.col("b")) != F.col("want")).count() == 0
    t = spark.createDataFrame([("The Vitamin D3 Test, Aspirin and Chronic Kidney Disease. Aspirin",), (None,)], "t string")
    got = [r.x for r in t.select(medicines.medical_terms(F.col("t")).alias("x")).collect()]
    assert got[1] == [] and got[0] == ["The Vitamin", "Test", "Aspirin", "Chronic Kidney Disease. Aspirin"]


ENTRY = "doc int, entry int, brand_name string, generic_name string, ingredients array<struct<name:string,dose:string>>, dosage_form string, confidence double"


def test_entries_are_enriched_and_made_one(spark):
    rows = [
        (1, 1, "10 tablets", None, [("paracetamol", "650 MG"), ("blur", "650 mg"), (" ", "1"), ("Paracetamol", "650mg")], "Tablet", 0.4),
        (1, 2, "Dolo 650", "", [("acetaminophen", "650mg")], "tablet ", 7.0), (1, 3, None, "unknown thing", [], None, None), (2, 1, None, None, None, None, -1.0),
    ]
    known = spark.createDataFrame([("paracetamol", "acetaminophen", "synonym"), ("acetaminophen", "acetaminophen", "exact")], "key string, entity string, match_type string")
    df = medicines.enriched(spark.createDataFrame(rows, ENTRY).withColumn("id", F.struct("doc", "entry")), "id", known)
    found = {(r.doc, r.entry): r for r in df.collect()}
    assert [tuple(i) for i in found[1, 1].ingredients] == [("acetaminophen", "650 MG")] and found[1, 1].match_type == "ingredient_resolved"
    assert (found[1, 3].generic_name, found[1, 3].match_type, found[2, 1].confidence, found[2, 1].generic_name) == ("unknown thing", "not_found", 0.0, "")
    one = {(r.doc, r.entry): r for r in medicines.deduped(df, "doc").collect()}
    assert set(one) == {(1, 1), (1, 3), (2, 1)}
    best = one[1, 1]
    assert (best.brand_name, best.confidence, best.readings, best.graph_match) == ("Dolo 650", 1.0, 2, True)


def test_entries_of_a_brand_are_united(spark):
    rows = [
        (None, 1, " X ", None, [("a", "1"), (None, None)], None, 0.1), (None, 2, "x", "g", [("A", "1"), ("b", None)], "gel", 0.3), (5, 1, None, "G", [], None, None), (5, 2, "", "g", None, "gel", None),
    ]
    got = sorted(((r.doc, r.entry, r.generic_name, [tuple(i) for i in r.ingredients], r.dosage_form, r.confidence) for r in medicines.merged(spark.createDataFrame(rows, ENTRY), "doc").collect()), key=repr)
    assert got == [(5, 1, "G", [], "gel", None), (None, 1, "g", [("a", "1"), ("b", None)], "gel", 0.3)]


def test_groups_of_drugs(spark):
    pairs = [
        (("Warfarin", "", None), ("x", "", None), ("major", "narrow_therapeutic_index")), (("x", None, True), (None, None, None), ("major", "narrow_therapeutic_index")),
        (("Tramadol", "", False), ("y", "Benzodiazepine derivative", False), ("major", "dual_cns_depressants")), (("aspirin", "", None), ("b", "Antiplatelet agent", None), ("major", "dual_anticoagulant_or_antiplatelet")),
        (("losartan", "", None), ("b", "ACE-inhibitor", None), ("moderate", "dual_antihypertensives")), (("metformin", "", None), ("b", "DPP-4 inhibitor", None), ("moderate", "dual_antidiabetics")),
        (("erlotinib", "", None), ("omeprazole", "", None), ("minor", "ppi_with_gastric_ph_sensitive_drug")), (("a", "", None), ("b", None, None), None), (("omeprazole", "", None), ("rabeprazole", "", None), None),
    ]
    df = spark.createDataFrame([(i, *a, *b) for i, (a, b, _) in enumerate(pairs)], "i int, na string, ca string, ta boolean, nb string, cb string, tb boolean")
    rule = pharmacology.pair_rule(*[(F.col(f"n{e}"), F.col(f"c{e}"), F.col(f"t{e}")) for e in "ab"])
    got = {r.i: r.r and tuple(r.r) for r in df.select("i", rule.alias("r")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(pairs)}


def test_severities_through_all_tiers(spark):
    edges = [(1, 2, "unknown", "b", False), (1, 2, "Minor", "a", None), (1, 2, "major", "a", None), (1, 3, None, "b", None), (1, 3, "x", "c", None), (1, 4, "unknown", "b", True), (2, 3, "Unknown", "b", None), (2, 4, "unknown", "b", None), (3, 4, "unknown", "b", None), (3, 4, "unknown", "z", None)]
    drugs = spark.createDataFrame([(2, "aspirin", None, None), (4, None, "anticoagulant", None)], "drug int, name string, class string, nti boolean")
    events = spark.createDataFrame([(2, 3, ["Cardiac Arrest", "rash"]), (3, 4, [])], "lo int, hi int, events array<string>")
    rows = severity.repaired_source(spark.createDataFrame(edges, "lo int, hi int, severity string, source string, flagged boolean"), drugs, events, "b", "a", "c").collect()
    got = {(r.lo, r.hi, r.source): (r.severity, r.method, r.evidence, r.sure, r.review_needed) for r in rows}
    assert len(rows) == len(edges)
    assert got[1, 2, "b"] == ("major", "matched_trusted", "major", "high", False) and got[1, 3, "b"][:2] == ("major", "matched_listed") and got[1, 4, "b"][:2] == ("major", "matched_listed")
    assert got[2, 3, "b"] == ("major", "shared_events", "cardiac arrest", "medium", False) and got[2, 4, "b"][:3] == ("major", "pharmacology_rule", "dual_anticoagulant_or_antiplatelet")
    assert got[3, 4, "b"] == ("minor", "default_low_confidence", "no_stronger_support", "low", True) and got[3, 4, "z"][:2] == ("unknown", "original")


def test_a_cascade_of_names(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    drugs = frame([("aspirin", "aspirin"), ("clopidogrel", "clopidogrel"), ("levothyroxine", "levothyroxine")], "key string, entity string")
    synonyms = frame([("acetylsalicylic acid", "aspirin")], "key string, entity string")
    brands = frame([("Clopitab A 75", "clopidogrel"), ("Clopitab A 75", "aspirin"), ("Thyronorm 50 tablet", "levothyroxine"), ("Nothing", "unlisted"), *[(f"Filler{i} {i}", "unlisted") for i in range(100, 160)]], "brand string, entity string")
    names = ["Aspirin", " Acetylsalicylic  acid", "clopitaba75", "Thyronorm50mcg", "levothyroxin", "zzz", "", None, "nothing"]
    rows = {r.raw: r for r in resolve.drug_cascade(frame([(n,) for n in names], "raw string"), "raw", drugs, synonyms, brands).collect()}
    assert [(rows[n].entity, rows[n].match_type) for n in names] == [
        ("aspirin", "exact"), ("aspirin", "synonym"), (rows["clopitaba75"].entity, rows["clopitaba75"].match_type), ("levothyroxine", "brand"), ("levothyroxine", "fuzzy"),
        (None, "none"), (None, "none"), (None, "none"), (None, "none"),
    ]
    assert 0.55 < rows["Thyronorm50mcg"].confidence <= 0.93 and 0.35 < rows["levothyroxin"].confidence <= 0.85


@pytest.mark.parametrize("name,kind", [("Metformin", "biguanide"), ("rosuvastatin", "statin"), ("verapamil", "ccb"), ("Polyethylene Glycol", "laxative"), ("zzz", None), (None, None)])
def test_classes_by_family(spark, name, kind):
    df = spark.createDataFrame([(name,)], "n string").select(text.class_by_suffix(F.col("n")).alias("c"))
    assert df.first().c == kind
