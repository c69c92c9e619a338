"""Url verdicts, ranked search and hard negatives: odd rows, ties, and the same results by brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from oracle import connection, of_spark, of_sql
from pyspark.sql import functions as F

from medloom.llm import lexical, negatives, queries, urls


@pytest.mark.parametrize("name", ["op11_urls", "op12_search", "op13_negatives"])
def test_query_matches_sql(spark, small, name):
    assert of_spark(queries.QUERIES[name](spark, small)) == of_sql(connection(small), queries.ORACLES[name])


# --- urls -----------------------------------------------------------------------------------------------------------

PAGE = "page_id long, url string, host string"


def _judged(spark, pages, outcomes, rules=(), **more):
    rows = spark.createDataFrame([(i, u, "clash") for i, u in pages], PAGE)
    labels = spark.createDataFrame(outcomes, "url string, bad boolean")
    return {r.page_id: r for r in urls.judged(rows, labels, [urls.parse_rule(r) for r in rules], **more).collect()}


def test_parts_of_odd_urls(spark):
    given = [None, "", "no scheme/x", "HTTP://User@A.Example.ORG:80/Pa/th?q#f", "http://b.org", "x://c.org?y=/z", "y://://d/", "http://É.org/\nline?"]
    rows = _judged(spark, list(enumerate(given)), [])
    parts = [(rows[i].host, rows[i].path) for i in range(len(given))]
    assert parts == [("", ""), ("", ""), ("", ""), ("user@a.example.org:80", "/Pa/th"), ("b.org", ""), ("c.org", ""), (":", "//d/"), ("É.org", "/\nline")]
    assert rows[3].domain == "example.org" and {r.verdict for r in rows.values()} == {"allow"}


def test_longest_rule_wins(spark):
    rules = ["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"]
    given = {
        "http://example.net/en/": ("example.net/en/", "allow"), "http://example.net/en": ("net/", "block"), "http://sub.example.net/en/1": ("example.net/en/", "allow"),
        "http://badexample.net/en/1": ("net/", "block"), "http://net": (None, "allow"), "http://net/": ("net/", "block"), "http://EXAMPLE.com/de/#x": ("example.com/de/", "block"),
        "http://example.com/DE/": (None, "allow"), "http://a.b.org/fr/": ("org/fr/", "allow"), "http://org.com/fr/": (None, "allow"),
    }
    rows = _judged(spark, list(enumerate(given)), [], rules)
    assert {u: (rows[i].rule, rows[i].verdict) for i, u in enumerate(given)} == given
    assert [rows[i].by_rule for i, u in enumerate(given)] == [given[u][0] is not None for u in given]


@pytest.mark.parametrize("line", ["", "deny x/", "block /path"])
def test_what_is_no_rule(line):
    with pytest.raises(ValueError):
        urls.parse_rule(line)


def test_evidence_moves_from_hosts_to_domains(spark):
    rng = random.Random(3)
    outcomes = [(f"http://h{i % 5}.bad.org/{i}", rng.random() < 0.95) for i in range(400)]
    outcomes += [(f"http://h{i % 40}.good{i % 30}.org/{i}", rng.random() < 0.05) for i in range(2000)]
    outcomes += [("http://once.net/1", True), ("http://once.net/2", None), (None, True)]
    pages = ["http://h1.bad.org/x", "http://new.bad.org/x", "http://h1.good1.org/", "http://new.good1.org/", "http://once.net/3", "http://never.net/", None]
    rows = _judged(spark, list(enumerate(pages)) * 2, outcomes)
    assert [rows[i].verdict for i in range(7)] == ["block", "block", "allow", "allow", "allow", "allow", "allow"]
    assert rows[1].n_labelled == 0 and rows[4].n_labelled == 1 and rows[0].lower > 0.5 > rows[2].lower


def test_strengths_and_posterior_by_hand(spark):
    hosts = {"a.x.org": (10, 9), "b.x.org": (20, 3), "c.y.org": (8, 1), "d.z.com": (30, 12), "z.com": (4, 0)}
    outcomes = [(f"http://{h}/", i < k) for h, (n, k) in hosts.items() for i in range(n)]
    names = spark.createDataFrame([("e.y.org",)], "host string")
    got = {r.host: r for r in urls.reputations(spark.createDataFrame(outcomes, "url string, bad boolean"), names).collect()}
    domain = {h: ".".join(h.split(".")[-2:]) for h in [*hosts, "e.y.org"]}
    level = lambda key: {p: tuple(sum(hosts[h][i] for h in hosts if key(h) == p) for i in (0, 1)) for p in map(key, domain)}
    domains, ends, total = level(domain.__getitem__), level(lambda h: h.split(".")[-1]), level(lambda h: "")

    def strength(children, parent):
        seen = drawn = full = 0
        for (n, k), (n_p, k_p) in ((children[c], parent(c)) for c in children if children[c][0]):
            p = k_p / n_p
            seen, drawn, full = seen + int(1e6 * n * (k / n - p) ** 2), drawn + int(1e6 * p * (1 - p) * (1 - n / n_p)), full + int(1e6 * p * (1 - p) * (1 - n / n_p) * n)
        return urls.strength(seen, drawn, full)

    mh = strength(hosts, lambda h: domains[domain[h]])
    md = strength(domains, lambda d: ends[d.split(".")[-1]])
    ms = strength(ends, lambda _: total[""])
    n_all, k_all = total[""]
    for h, d in domain.items():
        (n, k), (nd, kd), (ns, ks) = hosts.get(h, (0, 0)), domains[d], ends[d.split(".")[-1]]
        prior = (ks - kd + ms * (k_all + 0.5) / (n_all + 1)) / (ns - nd + ms)
        prior = (kd - k + md * prior) / (nd - n + md)
        assert got[h].alpha == pytest.approx(k + mh * prior, rel=1e-4) and got[h].beta == pytest.approx(n - k + mh * (1 - prior), rel=1e-4)


def test_names_and_suffixes(spark):
    given = ["a.b.co.uk", "co.uk", "uk", "10.0.0.1", "x.", "", "u@h.com:80", "b.com"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(given)], "i int, h string").withColumn("n", urls.site(F.col("h")))
    for suffixes, want in (((), ["co.uk", "co.uk", "uk", "10.0.0.1", "x", "", "h.com", "b.com"]), (("co.uk",), ["b.co.uk", "co.uk", "uk", "10.0.0.1", "x", "", "h.com", "b.com"])):
        rows = df.select("i", urls.domain_of(F.col("n"), urls.suffix_of(F.col("n"), suffixes)).alias("d")).orderBy("i").collect()
        assert [r.d for r in rows] == want


def test_no_pages_and_no_outcomes(spark):
    assert _judged(spark, [], []) == {} and _judged(spark, [], [("http://a.org/", True)]) == {}
    assert _judged(spark, [(1, "http://a.org/")], [])[1].verdict == "allow"


# --- ranked search --------------------------------------------------------------------------------------------------


def _ranked(docs, items, k):
    """Rows (item, rank, doc, score) by the formula, one document at a time."""
    tf = [(key, lexical.terms_of(text)) for key, text in docs]
    tf = [(key, t) for key, t in tf if t]
    many, total, df = len(tf), sum(sum(t.values()) for _, t in tf), Counter(w for _, t in tf for w in t)
    out = []
    for item, text in items:
        found = []
        for key, t in tf:
            m = 25 + 75 * sum(t.values()) * many // total
            score = sum(n * int(np.floor(1000 * np.log((2.0 * many + 2) / (2.0 * df[w] + 1)))) * (10**9 * t[w] // (1000 * t[w] + 8 * m)) for w, n in lexical.terms_of(text).items() if w in t)
            if score > 0:
                found.append((-score, key is None, key or 0))
        out += [(item, r, None if none else key, -score) for r, (score, none, key) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 7)
    monkeypatch.setattr(lexical, "SHARD_BYTES", 2000)
    monkeypatch.setattr(lexical, "SLICE", 64)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 20)


def _search(spark, docs, items, k=10, parts=3):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, term string").repartition(parts)
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, score string")
    rows = lexical.search(lexical.build(d), q, k).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=repr)


def test_search_in_small_shards_and_blocks(spark, tiny):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "naïve", "x" * 300, "日本"]
    pick = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "-", "\n", "A"]) for _ in range(n))
    docs = [(i, pick(rng.randint(0, 60))) for i in range(60)] + [(None, pick(20)), (None, None), (7, pick(9)), (7, ""), (100, pick(3000))]
    items = [(i, pick(rng.randint(1, 12))) for i in range(9)] + [(3, "w1 W1 unknown"), (None, "w2"), (20, None), (21, ""), (22, "unknown ?")]
    for k in (1, 10, 100):
        assert _search(spark, docs, items, k) == _ranked(docs, items, k)


def test_equal_scores_go_by_id(spark, tiny):
    docs = [(i, "same words here") for i in (9, 3, 27, 1, 14, 5, 2, 8, 30, 31, 12, 40, 41, 42)] + [(None, "same words here")] * 3 + [(50 + i, "other text") for i in range(40)]
    rows = _search(spark, docs, [(1, "words")], 5)
    assert [r[2] for r in sorted(rows, key=lambda r: r[1])] == [1, 2, 3, 5, 8]
    assert [r[2] for r in sorted(_search(spark, docs, [(1, "words")], 16), key=lambda r: r[1])][-3:] == [42, None, None]


def test_search_of_nothing(spark):
    assert _search(spark, [], [(1, "a")]) == [] and _search(spark, [(1, None), (2, "?!")], [(1, "a")]) == [] and _search(spark, [(1, "a")], []) == []


def test_common_terms_can_weigh_less_than_nothing(spark):
    docs, items = [(i, "all") for i in range(5)], [(1, "all"), (2, "all rare")]
    assert _search(spark, [*docs, (9, "rare all")], items) == _ranked([*docs, (9, "rare all")], items, 10)


def test_best_against_sorting():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, k = int(rng.integers(0, 30)), int(rng.integers(1, 8))
        scores, ids, known = rng.integers(-2, 4, n), rng.integers(0, 9, n), rng.random(n) < 0.8
        want = sorted((-s, not o, i if o else 0) for s, i, o in zip(scores.tolist(), ids.tolist(), known.tolist(), strict=True) if s > 0)[:k]
        got = [(-scores[p], not known[p], ids[p] if known[p] else 0) for p in lexical.best(scores, ids, known, k)]
        assert got == want


def test_damping_beyond_64_bits():
    n = np.array([1, 10**9, 10**12], np.int64)
    assert lexical.damping(n, 10**11, 10**14).tolist() == [25 + 75 * int(x) * 10**11 // 10**14 for x in n]


# --- hard negatives -------------------------------------------------------------------------------------------------


def _mined(rows, every, positives, negs, low=50, high=95):
    whole = [(i, lab, [int(np.floor(256.0 * x)) for x in v]) for i, lab, v in rows]
    out = []
    anchors = {}
    for i, lab, v in whole:
        if i % every == 0 and (i not in anchors or (lab, v) < anchors[i]):
            anchors[i] = (lab, v)
    for a, (lab, v) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other == lab) for i, other, w in whole if i != a]
        for s, p, _ in sorted(x for x in scored if x[2])[:positives]:
            fitting = sorted(x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s)[:negs]
            out += [(a, p, r, x[1], -s, -x[0]) for r, x in enumerate(fitting, 1)]
    return sorted(out)


def _df(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, label int, embedding array<double>, id int").repartition(3)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("block,rows_at_once", [(4096, 512), (3, 5)])
def test_mined_against_brute_force(spark, monkeypatch, block, rows_at_once):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ROWS", rows_at_once)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 9))
    rows = [(i, i % 3, (centres[i % 4] + rng.normal(size=9) * 0.4).round(2).tolist()) for i in range(120)]
    rows += [(200 + i, i % 2, centres[0].round(2).tolist()) for i in range(30)] + [(5, 1, [0.0] * 9), (10, 0, [0.0] * 9), (10, 0, centres[1].tolist())]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in negatives.mined(_df(spark, rows), F.col("vec_id") % 5 == 0, F.col("label")).collect())
    assert got == _mined(rows, 5, 5, 3) and len(got) > 200


def test_mined_leaves_out_bad_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(7)
    good = [(i, i % 2, rng.normal(size=3).round(3).tolist()) for i in range(40)]
    bad = [(None, 1, [1.0] * 3), (100, None, [1.0] * 3), (101, 1, None), (102, 1, []), (103, 1, [1.0, None, 1.0]), (104, 0, [nan] * 3), (105, 0, [inf, 1.0, 1.0]), (106, 0, [1.0] * 2), (107, 0, [1e300] * 3)]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in negatives.mined(_df(spark, [*good, *bad]), F.col("vec_id") % 2 == 0, F.col("label")).collect())
    assert got == _mined(good, 2, 5, 3)


def test_mined_from_nothing(spark):
    for rows in ([], [(1, None, [1.0])], [(0, 1, [1.0, 2.0])]):
        assert negatives.mined(_df(spark, rows), F.col("vec_id") % 5 == 0, F.col("label")).count() == 0


def test_pruned_products_lose_nothing():
    rng = np.random.default_rng(8)
    turn = np.linalg.qr(rng.normal(size=(32, 32)))[0]
    x, y = (rng.integers(-3000, 3000, (n, 32)) * (rng.random((n, 1)) ** 4 * 1000 + 1).astype(np.int64) for n in (40, 700))
    a, b = (negatives._Side(np.arange(len(v)), np.zeros(len(v)), v, turn) for v in (x, y))
    full = x @ y.T
    needed = np.sort(full, axis=1)[:, -20]
    i, j, score = negatives.products(a, b, needed, np.ones(full.shape, bool))
    assert {(p, q): s for p, q, s in zip(i.tolist(), j.tolist(), score.tolist(), strict=True)} == {(p, q): full[p, q] for p, q in np.argwhere(full >= needed[:, None]).tolist()}
