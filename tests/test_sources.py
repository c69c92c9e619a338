"""Readers and ingest jobs on small files."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from medloom.sources import files, ingest, sinks
from medloom.streaming.edges import follow_edges


def known(spark, *names):
    return spark.createDataFrame([(n.lower(), n) for n in names], "key string, entity string")


def test_header_aliases(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Drug_A,Drug B,LEVEL\nx,y,Major\n")
    (tmp_path / "b.csv").write_text("Drug_A,Drug B,LEVEL\nz,w,Minor\n")
    df = files.with_header(files.read_delimited(spark, str(tmp_path)), {"drug_a": (), "drug_b": (), "level": ("severity",), "note": ()}, ("drug_a", "drug_b"))
    assert sorted(map(tuple, df.collect())) == [("x", "y", "Major", None), ("z", "w", "Minor", None)]
    with pytest.raises(ValueError, match="herb"):
        files.with_header(df, {"herb": ()}, ("herb",))


def test_positional_and_gzip(spark, tmp_path):
    (tmp_path / "e.tsv.gz").write_bytes(gzip.compress(b"C1\tS1\tx\tPT\tU\tNausea\nC2\tS2\n"))
    df = files.read_positional(spark, str(tmp_path / "e.tsv.gz"), {0: "flat", 3: "kind", 5: "effect"})
    assert [tuple(r) for r in df.collect()] == [("C1", "PT", "Nausea")]


def test_documents_and_mappings(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"Dolo": {"generic": "paracetamol", "dose": "650"}}))
    assert files.read_mapping(spark, str(tmp_path / "m.json"), "generic string, dose string").first().asDict() == {"key": "Dolo", "generic": "paracetamol", "dose": "650"}
    doc = {"enzymes": [{"name": "CYP3A4", "substrates": {"major": ["Simvastatin"], "minor": ["simvastatin"]}, "inhibitors": {"strong": ["Clarithromycin"]}, "inducers": {}}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    part = "map<string, array<string>>"
    df = files.read_document(spark, str(tmp_path / "c.json"), f"enzymes array<struct<name: string, substrates: {part}, inhibitors: {part}, inducers: {part}>>")
    found = {(r.drug, r.relation, r.band) for r in ingest.enzyme_roles(df).collect()}
    assert found == {("simvastatin", "IS_SUBSTRATE_OF", "major"), ("clarithromycin", "INHIBITS", "strong")}


def test_wide_tables_and_lines(spark):
    wide = spark.createDataFrame([("CYP3A4", "a, b", None)], "enzyme string, strong string, weak string")
    assert {tuple(r) for r in files.unpivoted(wide, "enzyme").collect()} == {("CYP3A4", "strong", "a"), ("CYP3A4", "strong", "b")}
    page = spark.createDataFrame([("Title\nAmiodarone  Known Risk\nother",)], "text string")
    assert [tuple(r) for r in files.matched_lines(page, "text", r"^(\w+) +((?:Known|Possible) Risk)$", ("drug", "risk")).collect()] == [("Amiodarone", "Known Risk")]


def test_pair_table(spark):
    rows = [("aspirin", "Warfarin sodium", "major", None, "watch", 2), ("Warfarin", "Aspirin", "minor", "inr", "", 3), ("a", "A", "major", "", "", 4)]
    df = spark.createDataFrame(rows, "drug_a string, drug_b string, level string, mechanism string, management string, seq int")
    found = ingest.pair_interactions(df, known(spark, "Aspirin", "Warfarin")).collect()
    assert [(r.lo, r.hi, r.severity, r.mechanism, r.management) for r in found] == [("Aspirin", "Warfarin", "major", "inr", "watch")]


def test_co_prescriptions(spark):
    rows = [("A", "b", "rash", "2.5"), ("B", "A", "rash", "3.5"), ("a", "b", "pain", "9"), ("a", "zzz", "pain", "9"), ("a", "b", "x", "bad")]
    df = spark.createDataFrame(rows, "drug_1 string, drug_2 string, event string, prr string")
    r = ingest.co_prescriptions(df, known(spark, "A", "B"), 1).first()
    assert (r.lo, r.hi, r.adverse_events, r.max_prr, r.num_events, r.events_truncated) == ("A", "B", ["pain"], 9.0, 2, True)


def test_knowledge_edges(spark):
    nodes = spark.createDataFrame([(0, "drug", "d1"), (1, "drug", "d2"), (2, "disease", "flu"), (3, "gene/protein", "G")], "node_index int, node_type string, node_name string")
    rows = [("drug_drug", 1, 0), ("drug_drug", 0, 1), ("indication", 2, 0), ("target", 0, 3), ("ppi", 3, 3)]
    found = {tuple(r) for r in ingest.knowledge_edges(spark.createDataFrame(rows, "relation string, x_index int, y_index int"), nodes).collect()}
    assert found == {("INTERACTS_WITH", "d1", "d2"), ("INDICATION", "d1", "flu"), ("TARGETS", "d1", "G")}


def test_open_graph(spark):
    schema = "nodes array<struct<kind: string, identifier: string, name: string, data: map<string,string>>>, edges array<struct<source_id: array<string>, target_id: array<string>, kind: string, direction: string, data: map<string,string>>>"
    doc = spark.createDataFrame([([("Side Effect", "C1", "rash", {"my url": "u"})], [(["Compound", "D1"], ["Side Effect", "C1"], "causes", "both", None)])], schema)
    nodes, edges = ingest.open_graph(doc)
    assert tuple(nodes.first()) == ("SIDE_EFFECT", "C1", "rash", {"meta_my-url": "u"})
    assert tuple(edges.first())[:3] == ("D1", "C1", "CAUSES")


def test_label_effects(spark):
    t = spark.createDataFrame
    found = ingest.label_effects(
        t([(1, "e1"), (1, "e2")], "label_id int, effect_id string"), t([("i1", "e1")], "ingredient_id string, effect_id string"),
        t([(1, 10)], "label_id int, product_id int"), t([(10, "i1"), (10, "i2")], "product_id int, ingredient_id string"),
        t([("i1", "aspirin"), ("i2", "x")], "ingredient_id string, drug string"), t([("e1", "rash"), ("e2", "pain")], "effect_id string, effect string"),
    )
    assert {tuple(r) for r in found.collect()} == {
        ("aspirin", "rash", "high_confidence"), ("aspirin", "pain", "label_derived"), ("x", "rash", "label_derived"), ("x", "pain", "label_derived")}


def test_frequencies_fall_back_to_the_stereo_id(spark):
    effects = spark.createDataFrame([("CID100000001", "CID0001", "PT", "rash"), ("CID100000001", "CID0001", "LLT", "pain")], "flat string, stereo string, kind string, effect string")
    freq = spark.createDataFrame([("CID0001", "rash", "12%")], "flat string, effect string, frequency string")
    drugs = spark.createDataFrame([(1, "d")], "compound int, drug string")
    assert [tuple(r) for r in ingest.effect_frequencies(effects, freq, drugs).collect()] == [("d", "rash", 0.12, "common")]


def test_brands(spark):
    rows = [("Dolo", None, "strip of 10 tablets", "paracetamol (650mg)", 1), ("Dolo", "Micro", None, "paracetamol (650mg) + Caffeine (5mg)", 2)]
    brands, edges = ingest.brand_products(spark.createDataFrame(rows, "name string, manufacturer string, pack string, composition string, seq int"), spark.createDataFrame([("paracetamol", "Acetaminophen")], "key string, entity string"))
    b = brands.first()
    assert (b.manufacturer, b.form, b.composition) == ("Micro", "tablet", "paracetamol (650mg) + Caffeine (5mg)")
    assert {r.ingredient for r in edges.collect()} == {"Acetaminophen", "Caffeine"}


def test_products_herbs_and_criteria(spark):
    schema = "results array<struct<brand_name: string, product_ndc: string, dosage_form: string, labeler_name: string, route: array<string>, active_ingredients: array<struct<name: string>>>>"
    products, edges = ingest.registered_products(spark.createDataFrame([([("B", "1-2", "TABLET", "L", ["ORAL"], [("ASPIRIN (X)",)])],)], schema))
    assert tuple(products.first()) == ("1-2", "B", "L", "ORAL", "tablet")
    assert tuple(edges.first()) == ("1-2", "aspirin")
    herbs = spark.createDataFrame([("garlic", "blood thinners such as warfarin", "major"), ("x", "any statin drugs", "minor")], "herb string, term string, severity string")
    drugs = spark.createDataFrame([("warfarin", "anticoagulant"), ("simvastatin", "statin")], "drug string, class string")
    assert {tuple(r) for r in ingest.herb_rules(herbs, drugs).collect()} == {("garlic", "warfarin", "major"), ("x", "simvastatin", "minor")}
    table5 = "table5 array<struct<drug_names_1: array<string>, drug_names_2: array<string>, risk: string, recommendation: string>>"
    pairs = ingest.criteria_pairs(spark.createDataFrame([([(["B"], ["a", "b"], "r1", None), (["a"], ["B"], "r2", "avoid")],)], table5))
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", "r1", "avoid")]


def test_food_and_herbs(spark):
    rows = [("d", "h", "herb", "No effect", "strong", 1), ("d", "h", "herb", "increases exposure", "weak", 2), ("d", "h", "herb", "severe bleeding", "n/a", 3)]
    r = ingest.food_and_herb(spark.createDataFrame(rows, "drug string, herb string, kind string, effect string, evidence string, seq int")).first()
    assert (r.severity_rank, r.evidence_rank, r.effect, r.mechanism, r.n_studies) == (4, 1, "increases exposure", "increases exposure | severe bleeding", 2)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sinks.replace_table(df, str(tmp_path / "t")).count() == 2
    assert sinks.emptied(df).count() == 0
    assert [r.v for r in sinks.without(df, F.col("k") == "a", "v").orderBy("k").collect()] == [None, 2]
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"})], "old map<string,string>, new map<string,string>")
    assert sinks.with_properties(maps, "old", "new").first().old == {"a": "1", "b": "3"}
    sinks.write_scoreboard(spark.createDataFrame([("m", 0.5, "pass")], "metric string, value double, status string"), str(tmp_path / "board"))
    assert spark.read.text(str(tmp_path / "board/table")).first()[0] == "| m | 0.5 | pass |"
    assert {tuple(r) for r in files.catalogue({"t": df}).collect()} == {("t", 2)}


def test_streamed_edges(spark, tmp_path):
    schema = "src string, dst string, severity string"
    put = lambda rows, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/{name}")
    start = lambda: follow_edges(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", schema, ["src", "dst"], f"{tmp_path}/check").awaitTermination()
    put([("a", "b", "minor"), ("c", "d", "major")], "one")
    start()
    put([("a", "b", "major"), ("c", "d", None)], "two")
    start()
    found = {(r.src, r.dst): r.severity for r in spark.read.parquet(f"{tmp_path}/out/version=1").collect()}
    assert found == {("a", "b"): "major", ("c", "d"): "major"}


def test_streamed_rows_are_not_mixed(spark, tmp_path):
    schema = "src string, at int, severity string, note string"
    rows = [("a", 1, "major", "old"), ("a", 2, "minor", None), ("b", None, "x", "y")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/one")
    follow_edges(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", schema, ["src"], f"{tmp_path}/check", "at").awaitTermination()
    found = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/version=0").select("src", "at", "severity", "note").collect()}
    assert found == {("a", 2, "minor", None), ("b", None, "x", "y")}
