"""What a report is made of, on a few odd rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from medloom.operators import audit, report, support


def test_read_names_stand_for_drugs(spark):
    read = spark.createDataFrame([(1, 70, "Combo-A"), (1, 70, "combo a"), (1, 70, "x"), (1, 70, None), (2, None, "")], "patient int, age int, raw string")
    known = spark.createDataFrame([("combo a", 5), ("combo a", 6), ("combo a", 6), ("y", 7)], "key string, drug int")
    found, lost = report.effective(read, known)
    assert {tuple(r) for r in found.collect()} == {(1, 70, 5), (1, 70, 6)}
    assert {tuple(r) for r in lost.collect()} == {(1, "x"), (1, None), (2, "")}


def test_herbs_are_never_safe(spark):
    herbs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, None)], "patient int, herb string")
    rows = report.herb_tiers(herbs, herbs.where("herb <> 'c'").select("herb"), herbs.where("herb = 'b'").select("herb")).collect()
    assert {r.herb: r.tier for r in rows} == {"a": "known_without_data", "b": "known_with_data", "c": "unknown_herb", None: "unknown_herb"}


def test_self_started_medicines(spark):
    rows = [(1, " Dolo", "SELF "), (1, "x", "doctor"), (1, "y", None), (2, "dolo", "medical shop")]
    found = report.self_started(spark.createDataFrame(rows, "patient int, medicine string, source string"), spark.createDataFrame([(1, "DOLO"), (1, "dolo ")], "patient int, medicine string"))
    assert {tuple(r) for r in found.collect()} == {(1, " Dolo", True), (2, "dolo", False)}


def test_texts_by_id_and_links(spark):
    rows = spark.createDataFrame([("f1", "t"), ("f2", None)], "id string, title string")
    written = spark.createDataFrame([("f1", " "), ("f1", " b"), ("f1", "c"), ("f9", "z"), (None, "n")], "id string, title string")
    assert {tuple(r) for r in report.merged_by_id(rows, written, "id", ["title"]).collect()} == {("f1", "b"), ("f2", None)}
    links = [(1, [(" a", "u1 "), ("b", "u1"), ("", "u2"), (None, None)]), (2, None)]
    df = spark.createDataFrame(links, "id int, links array<struct<label:string,url:string>>")
    found = report.record_links(df, "id", "links", [(F.lit("p"), F.lit("u1")), (F.lit("q"), F.lit(None).cast("string")), (F.lit("r"), F.lit("u3"))]).collect()
    assert {r.id: [tuple(x) for x in r.links] for r in found} == {1: [("a", "u1"), ("r", "u3")], 2: [("p", "u1"), ("r", "u3")]}


def test_findings_are_grounded_by_kind(spark):
    rows = [("pair", 2, 1), ("pair", 1, 3), ("herb", 2, 1), ("herb", 1, 2), ("herb", None, 2), (None, 1, 2)]
    shown = [("pair", 1, 2), ("pair", 2, 1), ("herb", 1, 2), (None, 1, 2)]
    found = support.grounded(*[spark.createDataFrame(x, "kind string, a int, b int") for x in (rows, shown)]).collect()
    assert sorted(((r.kind, r.a, r.b) for r in found if r.grounded), key=repr) == [("herb", 1, 2), ("pair", 2, 1)] and len(found) == len(rows)


def test_expectations(spark):
    want = [("a", "x"), ("a", "x"), ("b", "x"), ("c", "x"), ("d", "x")]
    got = [("a", "y"), ("a", "x"), ("b", "z"), ("b", "y"), ("c", None), ("e", "x")]
    rows = audit.held(*[spark.createDataFrame(x, "k string, v string") for x in (want, got)], "k", "v").collect()
    assert {r.k: (r.expected, r.found, r.verdict) for r in rows} == {"a": ("x", "x", "pass"), "b": ("x", "y", "fail"), "c": ("x", None, "missing"), "d": ("x", None, "missing")}
