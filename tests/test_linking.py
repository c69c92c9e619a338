"""Paths, search, fuzzy pairs, packing, components, sentinels and audits on small tables, against plain Python."""

from __future__ import annotations

import random
from collections import deque
from itertools import product

import numpy as np
import pytest
from oracle import TABLES, connection, of_spark, of_sql
from pyspark.sql import functions as F

from medloom.functions import text as T
from medloom.operators import audit, canonical, fulltext, fuzzy, packing, paths, resolve, sentinel
from medloom.plans import linking  # noqa: F401
from medloom.plans import queries as graph

# --- paths ----------------------------------------------------------------------------------------------------------


def _shortest(edges, a, b, hops):
    near = {}
    for s, t, r in edges:
        if s is not None and t is not None and s != t:
            for x, y in ((s, t), (t, s)):
                old = near.setdefault(x, {}).get(y)
                near[x][y] = r if old is None else min(old, r)
    found, queue = [], deque([((a,), ())])
    while queue:
        nodes, rels = queue.popleft()
        if nodes[-1] == b:
            found.append((len(rels), nodes, rels))
        elif len(rels) < hops:
            queue += [((*nodes, y), (*rels, r)) for y, r in near.get(nodes[-1], {}).items() if y not in nodes]
    return min(found, default=None)


@pytest.mark.parametrize("hops", [1, 3, 5])
def test_paths_against_search(spark, hops):
    rng = random.Random(hops)
    nodes = [f"n{i}" for i in range(24)]
    edges = [(rng.choice(nodes), rng.choice(nodes), rng.choice("xyz")) for _ in range(26)] + [("n0", None, "x"), ("n1", "n1", "y")]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)] + [("n0", "gone"), ("n0", "n0"), (None, "n1")]
    df = paths.shortest_paths(spark.createDataFrame(edges, "src string, dst string, rel string"), spark.createDataFrame([*pairs, *pairs], "a string, b string"), hops)
    rows = df.collect()
    assert len(rows) == len(set(pairs))
    for r in rows:
        want = _shortest(edges, r.a, r.b, hops) if r.a and r.b else None
        assert (None if r.hops is None else (r.hops, tuple(r.nodes), tuple(r.rels))) == want


def test_paths_of_nothing(spark):
    none, asked = spark.createDataFrame([], "src string, dst string, rel string"), spark.createDataFrame([("a", "b")], "a string, b string")
    assert paths.shortest_paths(none, asked).collect()[0].hops is None
    assert paths.shortest_paths(none, asked.limit(0)).count() == 0


# --- search ---------------------------------------------------------------------------------------------------------


def _found(spark, names, queries, **more):
    index = fulltext.build(spark.createDataFrame([(n,) for n in names], "n string"), "n")
    rows = fulltext.search(index, spark.createDataFrame([(q,) for q in queries], "q string"), "q", **more).collect()
    return {q: [(r.name, r.tier) for r in sorted((r for r in rows if r.q == q), key=lambda r: r["rank"])] for q in queries}


def test_tiers_of_a_search(spark):
    names = ["Dolo 650 tablet", "Dolo 500 tablet", "Combi Dolo forte tablet", "650 Calpol tablet", "Pan 40 tablet", None, "", "Dolo 650 tablet"]
    found = _found(spark, names, ["dolo650", "650 Dolo", "PAN40 tablets", "zzz", "", None], common=0.7, least=1)
    assert found["dolo650"][0] == ("Dolo 650 tablet", "phrase") and set(n for n, _ in found["dolo650"]) == {"Dolo 650 tablet", "Dolo 500 tablet", "Combi Dolo forte tablet", "650 Calpol tablet"}
    assert found["650 Dolo"][0] == ("Dolo 650 tablet", "phrase")
    assert found["PAN40 tablets"] == [("Pan 40 tablet", "phrase")] and not found["zzz"] and not found[""] and not found[None]


def test_common_words_bring_candidates_only_alone(spark):
    names = [f"brand{i} tablet" for i in range(50)]
    found = _found(spark, names, ["brand7 tablet", "tablet", "unknown tablet"], most=3, common=0.1, least=1)
    assert found["brand7 tablet"] == [("brand7 tablet", "phrase")]
    assert found["tablet"] == [("brand0 tablet", "phrase"), ("brand1 tablet", "phrase"), ("brand10 tablet", "phrase")]
    assert [t for _, t in found["unknown tablet"]] == ["any"] * 3


def test_a_gate_on_the_score(spark):
    assert _found(spark, ["a b", "a c"], ["a b"], gate=100.0) == {"a b": []}


# --- fuzzy pairs ----------------------------------------------------------------------------------------------------


def _names(rng, n):
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 22))) for _ in range(n)]
    out = []
    for b in base:
        c = list(b)
        for _ in range(rng.randint(0, 3)):
            if c:
                i = rng.randrange(len(c))
                c[i : i + 1] = rng.choice([[], [rng.choice("abcd")], [c[i], rng.choice("abcd")]])
        out += [b, "".join(c), rng.choice(["x", ""]) + b[rng.randint(0, 4) :] + rng.choice(["", " zz"])]
    return out


@pytest.mark.parametrize("ratio,overlap", [(0.9, 0.6), (0.7, 0.5)])
def test_fuzzy_pairs_lose_none(spark, ratio, overlap):
    rng = random.Random(9)
    left, right = _names(rng, 40), _names(rng, 30)
    right += rng.sample(left, 40)
    a, b = (spark.createDataFrame([(n,) for n in [*names, None, "", " - "]], "n string") for names in (left, right))
    got = {(r.a, r.b) for r in fuzzy.fuzzy_keys(a, b, ratio, overlap).collect()}
    keys = [df.select(T.lookup_key(F.col("n")).alias(k)).where(f"{k} <> ''").distinct() for df, k in ((a, "a"), (b, "b"))]
    want = {(r.a, r.b) for r in keys[0].crossJoin(keys[1]).where(T.fuzzy_match(F.col("a"), F.col("b"), ratio, overlap)).collect()}
    assert got == want and len(want) > 50


def test_ratios_without_a_shared_gram():
    fuzzy.check_ratio(0.7)
    with pytest.raises(ValueError):
        fuzzy.check_ratio(0.5)


def test_names_without_a_shared_token_do_not_meet(spark):
    names = spark.createDataFrame([("abcd e",)], "n string")
    with pytest.raises(ValueError):
        fuzzy.fuzzy_keys(names, names, overlap=0.0)


def test_pairs_of_odd_names_equal_their_sql(spark, small, tmp_path):
    """Null, blank and repeated words, names of signs only, and close ones at the bounds of all rules."""
    rng = random.Random(4)
    odd = [None, "", "###", "-- ", "a a b c d", "a b c d e", "AB-ab ab x y", "Custmer#000000001", "cust 1 2 3 4", "cust 1 2 3 5", *_names(rng, 30)]
    for name in TABLES:
        rows = spark.read.parquet(f"{small}/{name}.parquet")
        if name == "customer":
            rows = rows.select("c_custkey", F.element_at(F.array(*[F.lit(n) for n in odd]), (F.col("c_custkey") % len(odd) + 1).cast("int")).alias("c_name"))
        if name == "part":
            rows = rows.withColumn("p_type", F.when(F.col("p_partkey") % 7 == 0, None).when(F.col("p_partkey") % 7 == 1, F.lit("#")).otherwise(F.col("p_type")))
            rows = rows.withColumn("p_name", F.when(F.col("p_partkey") % 11 == 0, None).when(F.col("p_partkey") % 11 == 1, F.lit(" ")).otherwise(F.col("p_name")))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    got = of_spark(graph.QUERIES["fuzzy_ratio"](spark, str(tmp_path)))
    assert got == of_sql(connection(str(tmp_path)), graph.ORACLES["fuzzy_ratio"]) and ("", "") in got and len(got) > 100


def test_prefix_pairs_and_families(spark):
    rng = random.Random(2)
    words = lambda n: ["".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(n)]
    left, right = words(40), words(30)
    frame = lambda w: spark.createDataFrame([(x,) for x in [*w, None]], "n string")
    got = {(r.a, r.b) for r in fuzzy.prefix_pairs(frame(left), frame(right)).collect()}
    assert got == {(a, b) for a, b in product(left, right) if a and b and (a.startswith(b) or b.startswith(a))}
    known = spark.createDataFrame([("pan", "pantoprazole"), ("dolo", "paracetamol"), ("dolonex", "piroxicam")], "brand_key string, generic string")
    rows = resolve.family_generic(spark.createDataFrame([("Pan D",), ("pa",), ("Dolo 650",), ("dolonex dt",), ("zz",), (None,)], "b string"), "b", known).collect()
    assert {r.b: r.generic for r in rows} == {"Pan D": "pantoprazole", "pa": "pantoprazole", "Dolo 650": "paracetamol", "dolonex dt": None, "zz": None, None: None}


# --- packing --------------------------------------------------------------------------------------------------------


def _fold(sizes, most, used=0, chunk=0):
    out = []
    for n in sizes:
        if used and used + n > most:
            chunk, used = chunk + 1, 0
        used += n
        out.append(chunk)
    return out, used, chunk


def test_what_passes_through_a_block():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes, most = rng.choice([0, 0, 1, 2, 5, 9, 30], int(rng.integers(1, 12))), int(rng.integers(1, 20))
        used, chunks = packing.passed(sizes, most)
        for u in range(most + 2):
            _, after, chunk = _fold(sizes.tolist(), most, u)
            assert (used[u], chunks[u]) == (after, chunk)
            got, after2, chunk2 = packing.numbered(sizes, most, u, 3)
            assert (got.tolist(), after2, chunk2) == ([c + 3 for c in _fold(sizes.tolist(), most, u)[0]], after, chunk + 3)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_packing_against_a_fold(spark, block):
    rng = random.Random(block)
    rows = [(k, i, rng.choice([None, 0, 0, 3, 8, 25])) for k in (None, "a", "b", "c") for i in range({"b": 60, "c": 1}.get(k, 9))] + [("a", None, 4), ("a", 2, 3), ("a", 2, 3)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, t int, n int, chunk string").repartition(5)
    got = sorted(((r.k, r.t, r["size"] if "size" in r else r.n, r.chunk) for r in packing.packed(df, "k", "t", "n", 20, block).collect()), key=repr)
    want = []
    for k in {r[0] for r in rows}:
        own = sorted(((t, n or 0) for q, t, n in rows if q == k), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        want += [(k, t, n, c) for (t, n), c in zip(own, _fold([n for _, n in own], 20)[0], strict=True)]
    assert got == sorted(want, key=repr)


def test_packing_of_a_long_group(spark):
    df = spark.range(300_000).select(F.lit("one").alias("k"), F.col("id").alias("t"), (F.col("id") * 7919 % 13).alias("n"))
    got = [r.chunk for r in packing.packed(df, "k", "t", "n", 40, 1 << 14).orderBy("t").collect()]
    assert got == _fold([i * 7919 % 13 for i in range(300_000)], 40)[0]


def test_packing_of_nothing_and_of_less_than_nothing(spark):
    assert packing.packed(spark.createDataFrame([], "k string, t int, n int"), "k", "t", "n", 5).count() == 0
    with pytest.raises(Exception, match="negative"):
        packing.packed(spark.createDataFrame([("a", 1, -1)], "k string, t int, n int"), "k", "t", "n", 5).count()


# --- entities -------------------------------------------------------------------------------------------------------


def test_components_against_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(400, 400 + i) for i in range(1, 50)] + [(500, 500)]
    root = {x: x for pair in links for x in pair}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    rows = canonical.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {x: top(x) for x in root} and len(rows) == len(root)


def test_entities_of_several_identifiers(spark):
    rows = [(1, "Aspirin", 5, "", None), (2, "ASA", 9, " nsaid ", ""), (3, "Acetyl", 9, "other", "B01"), (4, "Alone", 1, None, "X"), (5, "n/a ids", 2, None, None), (6, "too", 2, None, None)]
    ids = [(1, "rx", "11"), (2, "rx", " 11 "), (2, "ndc", "7"), (3, "ndc", "7"), (5, "rx", "n/a"), (6, "rx", "N/A"), (4, "rx", None), (4, "ndc", "11")]
    df = spark.createDataFrame(rows, "id long, name string, degree int, class string, code string")
    found = canonical.members(df, spark.createDataFrame(ids, "entity long, kind string, value string"))
    one = {r.component: r for r in canonical.canonical(found, [-F.col("degree"), F.col("name")], ["class", "code"]).collect()}
    assert set(one) == {1, 4, 5, 6} and one[1].asDict() == {"component": 1, "primary": 2, "name": "ASA", "members": 3, "class": "nsaid", "code": "B01"}
    names = canonical.names_of(found, spark.createDataFrame([(1, "aspirin  tab"), (3, None), (9, "stray")], "id long, synonym string"))
    assert {r.synonym for r in names.where("component = 1").collect()} == {"Aspirin", "ASA", "Acetyl", "aspirin tab"}


# --- sentinels ------------------------------------------------------------------------------------------------------


def test_sentinels_are_repaired_once(spark):
    names = spark.createDataFrame([("a", "n1", "drug", 3), ("a", "n2", "drug", 9), ("b", "n3", "drug", 1), ("c", "n4", "drug", 1), ("h", "g1", "herb", 1)], "key string, node string, kind string, degree long")
    edges = spark.createDataFrame(
        [("drug-drug", "n3", "n1", "minor", "low", None), ("drug-drug", "n2", "n3", "major", "low", None), ("drug-drug", "n3", "n2", "moderate", "high", None),
         ("herb-drug", "g1", "n3", "minor", None, None), ("drug-drug", "n2", "n4", "minor", "sentinel_curated", "old")],
        "kind string, src string, dst string, severity string, source string, mechanism string",
    )
    entries = spark.createDataFrame(
        [(1, "drug-drug", "A", "b", "major", None), (2, "herb-drug", "H", "C", None, "m"), (3, "drug-drug", "b", "new one", "minor", None), (4, "drug-drug", "c", "a", "major", None), (5, "herb-drug", "h", "b", "minor", None)],
        "entry int, kind string, a string, b string, expected string, mechanism string",
    )
    rows = {r.entry: r for r in sentinel.validated(entries, names, edges, {"high": 50, "low": 10}).collect()}
    assert [rows[i].reason for i in range(1, 6)] == ["severity_mismatch", "not_found", "not_found", "severity_mismatch", None]
    assert all(r.found and r.matches for r in rows.values()) and [rows[i].source for i in range(1, 6)] == ["sentinel_curated"] * 4 + [None]
    assert rows[2].hint == "g1>n3>n2>n4" and rows[3].hint is None and rows[2].severity == "moderate"


# --- audits ---------------------------------------------------------------------------------------------------------


def test_verdicts_of_an_audit(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 3)], "k string, n int")
    checks = [audit.Check("rows", "t", F.count("*"), 3, 3), audit.Check("few", "t", F.count("n"), None, 1), audit.Check("free", "t", F.sum("n")), audit.Check("none", "e", F.max("n"), 0)]
    parts = [audit.Breakdown("by k", "t", "k"), audit.Breakdown("some", "t", "k", F.col("n") > 1)]
    rows = {(r.check, r.item): (r.value, r.verdict) for r in audit.audited({"t": df, "e": df.limit(0)}, checks, parts).collect()}
    assert rows == {
        ("rows", None): (3.0, "pass"), ("few", None): (2.0, "fail"), ("free", None): (4.0, "info"), ("none", None): (None, "fail"),
        ("by k", "a"): (2.0, "info"), ("by k", "(none)"): (1.0, "info"), ("some", "(none)"): (1.0, "info"),
    }
    with pytest.raises(ValueError):
        audit.audited({"t": df}, [audit.Check("x", "gone", F.count("*"))])
