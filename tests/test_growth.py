"""How many rows the steps of an operator make where ends have many edges, and that the results stay whole."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from medloom.operators import graph as G
from medloom.functions import text
from medloom.operators import fuzzy, medicines, paths, report, resolve, safety, support
from medloom.plans import queries, reading, standin
from medloom.sources import ingest


def most_rows(df):
    """Collected rows, and the most rows that any step of the executed plan made."""
    rows = df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        count = node.metrics().get("numOutputRows")
        if count.isDefined() and name != "RangeExec":
            most = max(most, count.get().value())
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


def broadcast_rows(df):
    """Collected rows, and the most rows that one broadcast of the executed plan sends to every task."""
    rows = df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "BroadcastExchangeExec":
            most = max(most, node.metrics().get("numOutputRows").get().value())
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


def dealt_rows(df):
    """Collected rows, and the most rows that one exchange of the executed plan deals out."""
    rows = df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name, count = node.getClass().getSimpleName(), node.metrics().get("shuffleRecordsWritten")
        if count.isDefined():
            most = max(most, count.get().value())
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


def test_transporter_paths_are_not_dealt_out(spark):
    baskets = spark.range(100).select(F.col("id").alias("patient"), F.explode(F.array(F.lit(1), F.lit(2))).alias("drug"))
    edges = lambda src: spark.range(600).select(F.lit(src).alias("src"), F.col("id").alias("dst"))
    rows, most = dealt_rows(support.transporter_paths(baskets, edges(1), edges(2).union(edges(2)), "patient", "drug"))
    assert len(rows) == 60_000 == len({tuple(r) for r in rows}) and {(r.a, r.b) for r in rows} == {(1, 2)} and most < 3000


def test_mids_of_split_rows_and_odd_ends(spark, monkeypatch):
    monkeypatch.setattr(G, "IN_A_ROW", 3)
    first = [(d, (d * 7919 + k * 104729) % 300) for d in range(4) for k in range(200)] + [(1, None), (2, 5), (2, 5), (3, 5), (None, 5)]
    second = [(d, (d * 31 + k * 104729) % 300) for d in range(4) for k in range(200)] + [(0, None), (1, 5), (None, 5)]
    one, two = (spark.createDataFrame(e, "src long, dst long") for e in (first, second))
    baskets = spark.createDataFrame([(p, d) for p in (7, 8) for d in range(4) if d != p - 7] + [(7, 1), (None, 1), (None, 2), (7, None)], "p long, d long")
    found = sorted((r.p, r.a, r.b, r.mid, r.way) for r in G.mids(baskets, [one, two], [(0, 1, "a <> b"), (0, 0, "a < b")], "p", "d", 3).collect())
    pairs = [(w, x, y) for w, e in enumerate((second, first)) for x, y in product(set(first), set(e)) if None not in (*x, *y) and x[1] == y[1] and (x[0] < y[0] if w else x[0] != y[0])]
    assert found == sorted((p, a, b, m, w) for p in (7, 8) for w, (a, m), (b, _) in pairs if p - 7 not in (a, b)) and len(found) > 100


def test_two_hops_list_no_edges_of_what_does_not_meet(spark):
    baskets = spark.range(100).select(F.col("id").alias("patient"), F.explode(F.array(F.lit(1), F.lit(2))).alias("drug"))
    edges = lambda src, start: spark.range(start, start + 200).select(F.lit(src).alias("src"), F.col("id").alias("dst"))
    rows, most = most_rows(G.two_hop(baskets, edges(1, 0), edges(2, 199), "patient", "drug"))
    assert {(r.a, r.b, r.mid) for r in rows} == {(1, 2, 199)} and len(rows) == 100
    assert most < 5000


def test_two_hops_of_split_rows_and_equal_marks(spark, monkeypatch):
    monkeypatch.setattr(G, "IN_A_ROW", 3)
    first = [(d, (d * 7919 + k * 104729) % 60_000) for d in range(4) for k in range(700)] + [(1, None), (2, 5), (2, 5), (3, 5)]
    second = [(d, (d * 31 + k * 104729) % 60_000) for d in range(4) for k in range(700)] + [(0, None), (1, 5)]
    one, two = (spark.createDataFrame(e, "src long, dst long").withColumn("w", F.lit(1)) for e in (first, second))
    baskets = spark.createDataFrame([(p, d) for p in (7, 8) for d in range(4) if d != p - 7], "p long, d long")
    found = sorted(tuple(r) for r in G.two_hop(baskets, one, two, "p", "d").select("p", "a", "b", "mid").collect())
    wanted = [(p, a, b, m) for p in (7, 8) for (a, m), (b, n) in product(first, second) if m == n and m is not None and a != b and p - 7 not in (a, b)]
    assert found == sorted(wanted)


def test_all_mechanisms_share_one_meeting_of_baskets(spark):
    baskets = spark.range(50).select(F.col("id").alias("patient"), F.explode(F.array(F.lit(1), F.lit(2))).alias("drug"), F.lit(70).alias("age"))
    def edges(column, *rows):
        return spark.createDataFrame([(s, d, "strong", 1.0) for s, d in rows], f"src int, dst int, {column} string, confidence double")

    inhibits, induces, substrates = edges("strength", *[(1, k) for k in range(100)]), edges("strength", (2, 7)), edges("fraction", (2, 5), (1, 7))
    drugs = spark.createDataFrame([(1, True), (2, False)], "drug int, nti boolean")
    rows, most = most_rows(report.indirect(baskets, inhibits, induces, substrates, inhibits, substrates, induces, inhibits, drugs))
    assert {(r.mechanism, r.a, r.b, r.mid) for r in rows} == {("inhibition", 1, 2, 5), ("induction", 2, 1, 7), ("electrolyte", 2, 1, 7)}
    assert len(rows) == 150 and most < 1000


def test_herbs_reach_drugs_once_for_all_patients(spark):
    baskets = spark.range(200).select(F.col("id").alias("patient"), F.lit(1).alias("drug"), F.lit(70).alias("age"))
    herbs = baskets.select("patient", F.lit(9).alias("herb"))
    edges = lambda src: spark.range(100).select(F.lit(src).alias("src"), F.col("id").alias("dst"))
    none = spark.createDataFrame([], "src int, dst int, severity string")
    rows, most = most_rows(safety.with_herbs(herbs, baskets, none, edges(9), edges(1)))
    assert len(rows) == 200 and {(r.herb, r.drug, r.mechanism) for r in rows} == {(9, 1, "metabolic")}
    assert most < 1000


def test_edges_of_herbs_are_not_broadcast(spark):
    """Edges that an explode makes are taken for as few as what it starts from."""
    baskets = spark.range(30).select(F.col("id").alias("patient"), F.col("id").alias("drug"), F.lit(70).alias("age"))
    herbs = baskets.select("patient", (F.col("patient") % 3).alias("herb"))
    edges = spark.range(100).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(98).cast("long"), F.lit(2).cast("long"))).alias("src"), F.col("id").alias("dst"), F.lit("major").alias("severity"))
    none = spark.createDataFrame([], "src long, dst long")
    rows, most = broadcast_rows(safety.with_herbs(herbs, baskets, edges, none, none))
    assert sorted((r.patient, r.herb) for r in rows) == [(p, p % 3) for p in range(30) if p % 3 != 1] and most < 1000


def test_best_edges_are_chosen_before_patients(spark):
    baskets = spark.range(100).select(F.col("id").alias("patient"), F.explode(F.array(F.lit(1), F.lit(2))).alias("drug"))
    edge = spark.range(100).select(F.lit(1).alias("lo"), F.lit(2).alias("hi"), F.lit("major").alias("severity"), F.lit("s").alias("source"), F.lit(1).alias("source_rank"),
                                   F.lit(None).cast("string").alias("evidence"), F.lit(False).alias("guideline"), F.col("id").alias("seq"))
    rows, most = most_rows(safety.direct(baskets, edge))
    assert len(rows) == 100 and {(r.seq, r.sources, r.confidence) for r in rows} == {(0, 1, 0.95)}
    assert most < 1000


def test_support_lists_no_edges_of_pairs_that_do_not_meet(spark):
    pairs = spark.range(300).select(F.lit(-1).cast("long").alias("a"), F.col("id").alias("b")).union(spark.createDataFrame([(None, 3), (4, 4)], "a long, b long"))
    first = spark.range(300).select(F.lit(-1).cast("long").alias("src"), (F.col("id") + 1000).alias("dst"))
    second = spark.createDataFrame([(4, 1000), (4, 1001), (5, 7)], "src long, dst long")
    none = spark.createDataFrame([(4, -1)], "lo long, hi long")
    rows, most = most_rows(support.best_support(pairs, none.where("lo = 0"), first, second))
    assert {(r.a, r.b, r.support, r.paths) for r in rows if r.b in (3, 4, 5)} == {(-1, 3, "none", 0), (None, 3, "none", 0), (4, 4, "none", 0), (-1, 4, "indirect", 2), (-1, 5, "none", 0)}
    assert len(rows) == 302 and most < 3000


def test_effects_are_carried_once_for_each_product(spark):
    effects = spark.range(300).select(F.col("id").alias("label_id"), F.lit("e").alias("effect_id"))
    labels = spark.range(300).select(F.col("id").alias("label_id"), F.lit(1).alias("product_id"))
    products = spark.range(300).select(F.lit(1).alias("product_id"), F.col("id").alias("ingredient_id"))
    drugs = spark.range(300).select(F.col("id").alias("ingredient_id"), F.col("id").alias("drug"))
    terms = spark.createDataFrame([("e", "E")], "effect_id string, effect string")
    sure = spark.createDataFrame([(5, "e")], "ingredient_id long, effect_id string")
    rows, most = most_rows(ingest.label_effects(effects, sure, labels, products, drugs, terms))
    assert len(rows) == 300 and [r.drug for r in rows if r.confidence == "high_confidence"] == [5]
    assert most < 1000


def test_hub_ends_are_looked_up(spark):
    hub = [("h", f"d{k}", "R") for k in range(400)]
    rest = [(f"d{k}", f"z{k}", "S") for k in range(400)]
    links = paths.undirected(spark.createDataFrame(hub + rest, "src string, dst string, rel string"))
    todo = spark.createDataFrame([("h", f"z{k}") for k in range(400)], "a string, b string")
    left = paths._grown(paths._ends(todo, "a"), links, todo, "a")
    rows, most = most_rows(paths._meeting(todo, left, paths._ends(todo, "b"), links))
    assert len(rows) == 400 and most <= 1600
    whole = paths.shortest_paths(spark.createDataFrame(hub + rest, "src string, dst string, rel string"), todo, 3)
    assert {(r.hops, len(r.nodes)) for r in whole.collect()} == {(2, 3)}


def test_names_that_differ_in_one_letter_meet_at_its_place_only(spark):
    names = [f"customer {k:09d}" for k in range(0, 4000, 7)]
    left = spark.createDataFrame([(n,) for n in [*names, "aspirinnn", "aabaabaab"]], "n string")
    right = spark.createDataFrame([(n,) for n in [*names, "aspirinn", "aspirinnnn", "abaabaabaa", "aabaabaaab"]], "n string")
    keys = left.select(F.col("n").alias("key"), F.lit(0).alias("side")).union(right.select("n", F.lit(1)))
    rows, most = most_rows(fuzzy._by_one_edit(keys, 0.9))
    near = {(a, b) for a in names for b in names if a != b and sum(x != y for x, y in zip(a, b, strict=True)) == 1}
    assert {(r.a, r.b) for r in rows} == near | {("aspirinnn", "aspirinnnn"), ("aabaabaab", "aabaabaaab")}
    assert most < 30 * len(names)


def test_grams_of_names_are_not_broadcast(spark):
    """Names compress to almost nothing, and their grams are many."""
    names = [f"customer {k:09d}" for k in range(1500)]
    left = spark.createDataFrame([(n,) for n in [*names, "hot copper bolt of brass", "abc"]], "n string")
    right = spark.createDataFrame([(n,) for n in [*names, "hot coper boltt of brass", "xabc"]], "n string")
    rows, most = broadcast_rows(fuzzy.fuzzy_keys(left, right))
    found = {(r.a, r.b) for r in rows}
    assert most < 1000 and (names[0], names[9]) in found and ("hot copper bolt of brass", "hot coper boltt of brass") in found
    assert all(sum(x != y for x, y in zip(a, b, strict=True)) < 2 for a, b in found if a.startswith("cust"))


def test_names_of_a_cascade_are_not_broadcast(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    known = [(f"customer {k:09d}", f"C{k}") for k in range(1500)]
    names = frame([(n.replace("tom", "tm" if k % 2 else "tom"),) for k, (n, _) in enumerate(known)], "raw string")
    brands = frame([("some brand", "C1")], "brand string, entity string")
    rows, most = broadcast_rows(resolve.drug_cascade(names, "raw", frame(known, "key string, entity string"), frame([("syn", "C1")], "key string, entity string"), brands, frame([(f"zz {k}", "Z") for k in range(1500)], "key string, entity string")))
    assert most < 1000 and {(int(r.raw[-9:]), r.entity, r.match_type) for r in rows} == {(k, f"C{k}", "fuzzy" if k % 2 else "exact") for k in range(1500)}


def test_herb_rules_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(ingest, "ROWS", 50)
    herbs = spark.range(100).select(F.col("id").alias("herb"), F.lit("any statin or garlicin").alias("term"), F.lit("major").alias("severity")).repartition(1)
    drugs = spark.createDataFrame([("garlicin", "x"), ("simva", "statin"), ("garlicin", "statin")], "drug string, class string")
    rules = ingest.herb_rules(herbs.union(herbs), drugs)
    shares = [r["count"] for r in rules.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 200 and len(shares) > 4 and max(shares) < 80
    assert {(r.herb, r.drug) for r in rules.collect()} == {(h, d) for h in range(100) for d in ("garlicin", "simva")}


def test_direct_edges_are_dealt_by_the_lines(spark, small, monkeypatch):
    monkeypatch.setattr(standin, "LINES", 500)
    shares = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    for df in (standin.direct_edges(spark, small), standin.dealt_edges(spark, small), standin.dealt_edges(spark, small).groupBy("lo", "hi").count()):
        each = shares(df)
        assert len(each) > 8 and max(each) < 2 * sum(each) / len(each)


def test_nodes_with_the_same_neighbours_are_reached_together(spark):
    """The pairs of 400 leaves of a hub are made last: no step deals them out."""
    star = spark.range(400).select(F.concat(F.lit("s"), "id").alias("src"), F.lit("n").alias("dst"))
    df = G.reachable(star, star.select(F.col("src").alias("start")), 3)
    assert df.groupBy("hops").count().sort("hops").collect() == [(0, 400), (1, 400), (2, 400 * 399)]
    df.collect()
    dealt, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name, count = node.getClass().getSimpleName(), node.metrics().get("shuffleRecordsWritten")
        if count.isDefined():
            dealt.append(count.get().value())
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    assert dealt and max(dealt) < 5000


def test_reachability_of_loops_twins_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(G, "IN_A_BUNDLE", 2)
    monkeypatch.setattr(G, "REACHED", 10)
    pairs = [(i, (i * i * 7 + 3) % 23) for i in range(40)] + [(50, 3), (51, 3), (52, 3), (60, 61), (70, 70), (80, 80), (81, 81), (80, 81), (5, None), (None, 6), (90, None)]
    starts = [*range(0, 40, 3), 50, 51, 52, 60, 61, 70, 80, 81, 90, 99, 5, 5, None]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    wanted = []
    for start in starts:
        wanted.append((str(start), str(start), 0))
    for start in set(starts) - {None}:
        seen, front = {start}, {start}
        for hop in range(1, 4):
            front = {b for a in front if a is not None for b in near.get(a, ())} - seen
            seen |= front
            wanted += [(str(start), str(node), hop) for node in front]
    found = G.reachable(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(s,) for s in starts], "start long"), 3)
    assert sorted((str(r.start), str(r.node), r.hops) for r in found.collect()) == sorted(wanted)


def test_variants_of_a_brand_are_computed_once(spark):
    df = spark.createDataFrame([("Crocin650mg Tablet",), ("tablet",), ("5 ml drops",), (None,), ("",)], "raw string")
    plan = df.select(text.brand_variants(F.col("raw")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") < 20
    found = {r.raw: r.v for r in df.select("raw", text.brand_variants(F.col("raw")).alias("v")).collect()}
    assert found["Crocin650mg Tablet"] == ["crocin 650 mg tablet", "crocin 650 mg", "crocin 650mg", "crocin 650", "crocin", "650 crocin"]
    assert found["tablet"] == ["tablet"] and found["5 ml drops"] == ["5 ml drops", "5 ml", "5"] and found[""] == [] and not found[None]


def test_herbs_and_food_are_read_once(spark):
    rows = [("d", "h", "k", f"alters {i % 6}", "Strong" if i == 7 else None, i) for i in range(12)] + [("d", "h", "k", "n/a", "strong", 3), ("d", None, "k", "x", "weak", 1), ("d", "h", "k", "No effect", "strong", 0)]
    df = ingest.food_and_herb(spark.createDataFrame(rows, "drug string, herb string, kind string, effect string, evidence string, seq int"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 1
    (row,) = df.collect()
    assert (row.effect, row.mechanism, row.n_studies) == (None, "alters 0 | alters 1 | alters 2 | alters 3", 13)


def test_findings_are_dealt_by_the_lines(spark, small, monkeypatch):
    monkeypatch.setattr(standin, "LINES", 500)
    shares = [r["count"] for r in queries._findings(spark, small).groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 8 and max(shares) < 3 * sum(shares) / len(shares)
    shares = [r["count"] for r in queries.ranked_ids(spark, small).groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 8 and max(shares) < 3 * sum(shares) / len(shares)


def test_entries_and_names_are_dealt_by_the_lines(spark, small, monkeypatch):
    monkeypatch.setattr(standin, "LINES", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name, df in (("united", reading.united_entries(spark, small)), ("merged", reading.merged_entries(spark, small)), ("named", queries._named(spark, small)), ("class", queries.duplicate_class(spark, small)), ("variants", queries.search_variants(spark, small))):
            shares = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            assert len(shares) > 8 and max(shares) < 3 * sum(shares) / len(shares), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_entries_without_a_document_are_united(spark):
    schema = "doc int, entry int, brand_name string, generic_name string, ingredients array<struct<name:string,dose:string>>, dosage_form string, confidence double"
    rows = [(None, 1, "A", None, [("x", "1")], None, 0.1), (None, 2, "a", "g", [("X", "1"), ("y", None)], "f", 0.2), (3, 1, "A", None, None, None, 0.3)]
    for parts in (None, 3):
        found = {r.doc: (r.entry, r.generic_name, [i.name for i in r.ingredients], r.confidence) for r in medicines.merged(spark.createDataFrame(rows, schema), "doc", parts=parts).collect()}
        assert found == {None: (1, "g", ["x", "y"], 0.2), 3: (1, None, [], 0.3)}
