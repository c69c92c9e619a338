"""Every operator of the graph engine as a query over the stand-in graph, beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medloom.functions import scoring as S
from medloom.functions import text as T
from medloom.operators import graph as G
from medloom.operators import merge as M
from medloom.operators import metrics as E
from medloom.operators import provenance as P
from medloom.operators import resolve as R
from medloom.operators import safety
from medloom.operators import severity as V
from medloom.plans import standin as N
from medloom.plans.standin import GRAPH, table
from medloom.sources.shared import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def __getattr__(name: str) -> Query:
    """Queries that other modules register are found here too."""
    if name in QUERIES:
        return QUERIES[name]
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")


# --- projections and filters ----------------------------------------------------------------------------------------


@query("SELECT p_partkey, lower(p_name) AS name_lc, coalesce(p_type, '') AS class FROM part WHERE lower(p_brand) = 'brand#2'")
def scan_filter_project(spark, d):
    return table(spark, d, "part").where(F.lower("p_brand") == "brand#2").select(
        "p_partkey", F.lower("p_name").alias("name_lc"), F.coalesce("p_type", F.lit("")).alias("class")
    )


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high')""")
def lookup_in_list(spark, d):
    wanted = spark.createDataFrame([("1-urgent",), ("2-high",)], "p string")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return orders.join(wanted, F.lower("o_orderpriority") == F.col("p"), "left_semi")


@query("""SELECT p_partkey FROM part WHERE list_contains(list_transform(string_split(p_name, ' '), lambda x: lower(x)), 'bolt')""")
def exists_alias(spark, d):
    parts = table(spark, d, "part")
    return parts.where(F.exists(F.split("p_name", " "), lambda s: F.lower(s) == "bolt")).select("p_partkey")


@query("""SELECT DISTINCT p_partkey FROM part JOIN (SELECT unnest(['ring', 'red w', 'olt']) AS word) ON contains(lower(p_name), word)""")
def contains_condition(spark, d):
    words = spark.createDataFrame([("ring",), ("red w",), ("olt",)], "word string")
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    return parts.join(F.broadcast(words), F.lower("p_name").contains(F.col("word")), "left_semi").select("p_partkey")


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'targets' WHEN 'signup' THEN 'indicated' WHEN 'error' THEN 'adverse' END AS route
FROM events WHERE event_type IN ('purchase', 'signup', 'error')""")
def case_routing(spark, d):
    kind = F.col("event_type")
    routes = {"targets": kind == "purchase", "indicated": kind == "signup", "adverse": kind == "error"}
    return G.routed(table(spark, d, "events"), **routes).select("event_id", "route")


@query("""SELECT p_partkey, bucket, word FROM (
  SELECT p_partkey, 'major' AS bucket, unnest(string_split(p_name, ' ')) AS word FROM part
  UNION ALL SELECT p_partkey, 'minor', unnest([lower(p_brand), lower(p_type)]) FROM part)""")
def bucket_explode(spark, d):
    buckets = F.create_map(
        F.lit("major"), F.split("p_name", " "), F.lit("minor"), F.array(F.lower("p_brand"), F.lower("p_type"))
    )
    rows = table(spark, d, "part").select("p_partkey", F.explode(buckets).alias("bucket", "words"))
    return rows.select("p_partkey", "bucket", F.explode("words").alias("word"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'unknown' END AS domain FROM events")
def domain_validation(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").select("event_id", F.when(kind.isin("view", "click"), kind).otherwise("unknown").alias("domain"))


# --- joins ----------------------------------------------------------------------------------------------------------


@query(GRAPH + """ SELECT a.patient, a.drug AS lo, b.drug AS hi, e.severity, e.source, e.seq FROM baskets a
JOIN baskets b ON a.patient = b.patient AND a.drug < b.drug JOIN edges e ON e.lo = a.drug AND e.hi = b.drug""")
def pairwise_edges(spark, d):
    hits = G.pairwise_edges(N.baskets(spark, d), N.dealt_edges(spark, d), "patient", "drug")
    return hits.select("patient", "lo", "hi", "severity", "source", "seq")


@query(GRAPH + """ SELECT p.lo, p.hi, p.orders, coalesce(k.events, '') AS events FROM
(SELECT lo, hi, count(*) AS orders FROM edges GROUP BY ALL) p LEFT JOIN (
  SELECT src, array_to_string((list(DISTINCT dst ORDER BY dst))[1:5], ',') AS events FROM inhibits GROUP BY src) k ON k.src = p.lo""")
def pair_enrich_left(spark, d):
    pairs = N.direct_edges(spark, d).groupBy("lo", "hi").agg(F.count("*").alias("orders"))
    top = M.top_per_key(N.inhibits(spark, d).select("src", "dst"), ["src"], [F.col("dst")], 5)
    events = top.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: x.cast("string")), ",").alias("events"))
    return pairs.join(events, F.col("lo") == F.col("src"), "left").select("lo", "hi", "orders", F.coalesce("events", F.lit("")).alias("events"))


_PATHS = """ SELECT x.patient, x.drug AS a, y.drug AS b, i.dst AS mid, '{kind}' AS mechanism,
  round(least({score} * CASE WHEN g.nti THEN 1.5 ELSE 1.0 END::DOUBLE * CASE WHEN x.age >= 70 THEN 1.2 ELSE 1.0 END::DOUBLE, {cap}::DOUBLE), 2) AS score,
  round(least(i.confidence, s.confidence) * 0.9::DOUBLE, 3) AS confidence
FROM baskets x JOIN {first} i ON i.src = x.drug JOIN substrates s ON s.dst = i.dst JOIN baskets y ON y.patient = x.patient AND y.drug = s.src AND y.drug <> x.drug
JOIN drugs g ON g.drug = y.drug"""
_STRENGTH = "(CASE i.strength WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END * CASE s.fraction WHEN 'major' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END)::DOUBLE"


@query(GRAPH + _PATHS.format(kind="inhibition", score=_STRENGTH, cap=15, first="inhibits"))
def two_hop_inhibition(spark, d):
    return safety.metabolic(N.baskets(spark, d), N.inhibits(spark, d), N.substrates(spark, d), N.drugs(spark, d))


@query(GRAPH + _PATHS.format(kind="induction", score="4.0::DOUBLE", cap=10, first="induces"))
def two_hop_induction(spark, d):
    return safety.metabolic(N.baskets(spark, d), N.induces(spark, d), N.substrates(spark, d), N.drugs(spark, d), induces=True)


_SHARED = """ SELECT x.patient, x.drug AS a, y.drug AS b, i.dst AS mid, '{kind}' AS mechanism,
  round(least({score}::DOUBLE * CASE WHEN x.age >= 70 THEN 1.2 ELSE 1.0 END::DOUBLE, 10::DOUBLE), 2) AS score,
  round(least(i.confidence, s.confidence) * 0.9::DOUBLE, 3) AS confidence
FROM baskets x JOIN {first} i ON i.src = x.drug JOIN {second} s ON s.dst = i.dst JOIN baskets y ON y.patient = x.patient AND y.drug = s.src AND {pair}"""


@query(GRAPH + _SHARED.format(kind="qt", score=8.0, first="inhibits", second="inhibits", pair="x.drug < y.drug"))
def shared_neighbor(spark, d):
    return safety.shared_effect(N.baskets(spark, d), N.inhibits(spark, d), "qt")


@query(GRAPH + _SHARED.format(kind="cns", score=6.0, first="substrates", second="substrates", pair="x.drug < y.drug"))
def shared_neighbor_cns(spark, d):
    return safety.shared_effect(N.baskets(spark, d), N.substrates(spark, d), "cns")


@query(GRAPH + _SHARED.format(kind="electrolyte", score=7.0, first="induces", second="inhibits", pair="x.drug <> y.drug"))
def asymmetric_cascade(spark, d):
    return safety.cascade(N.baskets(spark, d), N.induces(spark, d), N.inhibits(spark, d))


@query(GRAPH + """ SELECT drug FROM drugs WHERE drug IN (SELECT src FROM inhibits) AND drug IN (SELECT src FROM substrates)
AND drug IN (SELECT src FROM induces) AND drug IN (SELECT lo FROM edges)""")
def semi_all_sources(spark, d):
    sets = [f(spark, d).select("src").distinct() for f in (N.inhibits, N.substrates, N.induces)]
    return G.in_all(N.drugs(spark, d).select("drug"), "drug", *sets, N.direct_edges(spark, d).select("lo").distinct())


@query(GRAPH + """ SELECT drug, name FROM drugs WHERE drug NOT IN (SELECT src FROM inhibits WHERE strength = 'strong')
AND drug NOT IN (SELECT src FROM substrates WHERE fraction = 'major')""")
def anti_orphans(spark, d):
    strong = N.inhibits(spark, d).where("strength = 'strong'").select("src", F.lit(-1).cast("long").alias("dst"))
    major = N.substrates(spark, d).where("fraction = 'major'").select("src", F.lit(-1).cast("long").alias("dst"))
    return G.orphans(N.drugs(spark, d).select("drug", "name"), "drug", strong, major)


@query(GRAPH + """ SELECT drug FROM drugs WHERE EXISTS (SELECT 1 FROM inhibits WHERE src = drug AND strength = 'strong')
AND NOT EXISTS (SELECT 1 FROM substrates WHERE src = drug AND fraction = 'major')""")
def exists_not_exists(spark, d):
    strong = N.inhibits(spark, d).where("strength = 'strong'").select(F.col("src").alias("drug"))
    major = N.substrates(spark, d).where("fraction = 'major'").select(F.col("src").alias("drug"))
    return N.drugs(spark, d).select("drug").join(strong, "drug", "left_semi").join(major, "drug", "left_anti")


@query("""SELECT r_name, n_name, count(DISTINCT o_orderkey) AS orders, count(DISTINCT l_partkey) AS drugs FROM region
JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def three_hop_chain(spark, d):
    t = lambda n: table(spark, d, n)
    df = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    df = df.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return df.groupBy("r_name", "n_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("drugs"))


@query(GRAPH + """, lookup AS (SELECT DISTINCT lower(name) AS key, upper(name) AS entity FROM drugs WHERE drug % 2 = 0)
SELECT drug, coalesce(a.entity, b.entity, array_to_string(list_transform(string_split(raw, ' '), lambda w:
  CASE WHEN w = lower(w) THEN upper(substr(w, 1, 1)) || substr(w, 2) ELSE w END), ' ')) AS entity
FROM (SELECT drug, CASE WHEN drug % 3 = 0 THEN name || ' sodium' ELSE name END AS raw, name FROM drugs) n
LEFT JOIN lookup a ON a.key = lower(raw) LEFT JOIN lookup b ON b.key = lower(name)""")
def two_tier_lookup(spark, d):
    drugs = N.drugs(spark, d)
    known = drugs.where("drug % 2 = 0").select(T.lookup_key(F.col("name")).alias("key"), F.upper("name").alias("entity")).distinct()
    raw = F.when(F.col("drug") % 3 == 0, F.concat("name", F.lit(" sodium"))).otherwise(F.col("name"))
    return R.two_tier(drugs.select("drug", raw.alias("raw")), "raw", known).select("drug", "entity")


@query(GRAPH + """ SELECT o.o_orderpriority AS label, l.l_suppkey AS product, g.class AS ingredient, count(*) AS n FROM orders o
JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN drugs g ON g.drug = l.l_partkey GROUP BY ALL""")
def label_product_chain(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = lines.join(N.drugs(spark, d), F.col("l_partkey") == F.col("drug"))
    return df.groupBy(F.col("o_orderpriority").alias("label"), F.col("l_suppkey").alias("product"), F.col("class").alias("ingredient")).agg(F.count("*").alias("n"))


@query(GRAPH + """, bridge AS (SELECT s_suppkey AS dst, s_nationkey AS target FROM supplier)
SELECT DISTINCT src, target::BIGINT AS dst FROM inhibits JOIN bridge USING (dst)
WHERE (src, target::BIGINT) NOT IN (SELECT (src, dst) FROM substrates)""")
def derived_edges(spark, d):
    bridge = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"), F.col("s_nationkey").cast("long").alias("target"))
    return G.derived_edges(N.inhibits(spark, d).select("src", "dst"), bridge, N.substrates(spark, d))


_REACH = """, near AS (SELECT DISTINCT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation
  UNION SELECT DISTINCT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
both_ways AS (SELECT src, dst FROM near UNION SELECT dst, src FROM near),
h0 AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS node, 0 AS hops FROM supplier),
h1 AS (SELECT DISTINCT start, dst AS node, 1 AS hops FROM h0 JOIN both_ways ON src = node),
h2 AS (SELECT DISTINCT start, dst AS node, 2 AS hops FROM h1 JOIN both_ways ON src = node),
h3 AS (SELECT DISTINCT start, dst AS node, 3 AS hops FROM h2 JOIN both_ways ON src = node)
SELECT start, node, min(hops)::INT AS hops FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY ALL"""


@query(GRAPH + _REACH)
def k_hop_reachability(spark, d):
    code = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    supplier = table(spark, d, "supplier")
    near = table(spark, d, "nation").select(code("n", "n_nationkey").alias("src"), code("r", "n_regionkey").alias("dst"))
    near = near.union(supplier.select(code("s", "s_suppkey"), code("n", "s_nationkey")))
    return G.reachable(near, supplier.select(code("s", "s_suppkey").alias("start")), 3)


@query(GRAPH + """, paths AS (SELECT DISTINCT least(x.drug, y.drug) AS lo, greatest(x.drug, y.drug) AS hi FROM baskets x JOIN inhibits i ON i.src = x.drug
  JOIN substrates s ON s.dst = i.dst JOIN baskets y ON y.patient = x.patient AND y.drug = s.src AND y.drug <> x.drug)
SELECT (SELECT count(*) FROM paths) AS pairs, (SELECT count(*) FROM paths JOIN (SELECT DISTINCT lo, hi FROM edges WHERE severity = 'major') USING (lo, hi)) AS overlapping""")
def path_edge_overlap(spark, d):
    paths = G.two_hop(N.baskets(spark, d), N.inhibits(spark, d), N.substrates(spark, d), "patient", "drug")
    pairs = paths.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    major = N.direct_edges(spark, d).where("severity = 'major'").select("lo", "hi").distinct().withColumn("hit", F.lit(1))
    return pairs.join(major, ["lo", "hi"], "left").agg(F.count("*").alias("pairs"), F.count("hit").alias("overlapping"))


# --- aggregations ---------------------------------------------------------------------------------------------------


_BEST = """, hits AS (SELECT a.patient, e.*, r.rank FROM baskets a JOIN baskets b ON a.patient = b.patient AND a.drug < b.drug
  JOIN edges e ON e.lo = a.drug AND e.hi = b.drug JOIN sevrank r ON r.severity = e.severity)
SELECT patient, lo, hi, arg_max(severity, row(rank, source_rank, -seq)) AS severity, arg_max(source, row(rank, source_rank, -seq)) AS source,
  count(DISTINCT source) AS sources, bool_or(guideline) AS flagged,
  CASE WHEN count(DISTINCT source) > 1 THEN 1.0 WHEN bool_or(guideline) THEN 0.98 ELSE 0.95 END::DOUBLE AS confidence FROM hits GROUP BY ALL"""


@query(GRAPH + _BEST)
def best_row_per_pair(spark, d):
    best = safety.direct(N.baskets(spark, d), N.dealt_edges(spark, d))
    return best.select("patient", "lo", "hi", "severity", "source", "sources", "flagged", "confidence")


@query(GRAPH + """ SELECT patient, sum(acb)::BIGINT AS total, count(*) FILTER (acb > 0) AS contributors,
CASE WHEN sum(acb) >= 3 THEN 'high' WHEN sum(acb) >= 1 THEN 'moderate' ELSE 'low' END AS band FROM baskets JOIN drugs USING (drug) GROUP BY patient""")
def burden_sum(spark, d):
    return safety.burden(N.baskets(spark, d), N.drugs(spark, d))


def _named(spark, d):
    drugs = N.drugs(spark, d).select("drug", F.col("name").alias("ingredient"), "class")
    # where drugs are too many to broadcast, the join deals the lines by drugs
    return N.dealt(spark, d, N.baskets(spark, d).join(drugs, "drug").select("patient", "drug", "ingredient", "class"), "patient")


@query(GRAPH + " SELECT patient, 'ingredient' AS kind, name AS what, count(*) AS n FROM baskets JOIN drugs USING (drug) GROUP BY ALL HAVING count(*) > 1")
def duplicate_ingredient(spark, d):
    return safety.duplicates(_named(spark, d)).where("kind = 'ingredient'")


@query(GRAPH + """ SELECT patient, 'class' AS kind, class AS what, count(DISTINCT name) AS n FROM baskets JOIN drugs USING (drug)
GROUP BY ALL HAVING count(DISTINCT name) > 1""")
def duplicate_class(spark, d):
    return safety.duplicates(_named(spark, d)).where("kind = 'class'")


@query("""SELECT c_mktsegment AS segment, count(*) AS total, count(*) FILTER (s = 'critical') AS n_critical, count(*) FILTER (s = 'major') AS n_major,
count(*) FILTER (s = 'moderate') AS n_moderate, count(*) FILTER (s = 'doctor_review') AS n_doctor_review FROM (
  SELECT c_mktsegment, CASE WHEN v >= 8 THEN 'critical' WHEN v >= 5 THEN 'major' WHEN v > 0 THEN 'moderate' ELSE 'doctor_review' END AS s
  FROM (SELECT c_mktsegment, c_acctbal / 1000 AS v FROM customer)) GROUP BY c_mktsegment""")
def severity_pivot(spark, d):
    shown = table(spark, d, "customer").select("c_mktsegment", S.score_severity(F.col("c_acctbal") / 1000).alias("s"))
    kinds = ("critical", "major", "moderate", "doctor_review")
    return shown.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("total"), *[F.count_if(F.col("s") == k).alias(f"n_{k}") for k in kinds])


@query("""WITH e AS (SELECT user_id, event_type, max(value) AS prr FROM events GROUP BY ALL)
SELECT user_id, max(prr) AS max_prr, count(*) AS num_events FROM e GROUP BY user_id""")
def prr_rollup(spark, d):
    each = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("prr"))
    return each.groupBy("user_id").agg(F.max("prr").alias("max_prr"), F.count("*").alias("num_events"))


@query("""WITH e AS (SELECT user_id, event_type, max(value) AS prr FROM events GROUP BY ALL)
SELECT user_id, array_to_string((list(event_type ORDER BY prr DESC, event_type))[1:3], ',') AS top_events, max(prr) AS top_score, count(*) AS many,
count(*) > 3 AS truncated FROM e GROUP BY user_id""")
def ranked_list_agg(spark, d):
    df = M.ranked_list(table(spark, d, "events"), ["user_id"], "event_type", "value", 3)
    return df.select("user_id", F.array_join("values", ",").alias("top_events"), "top_score", "many", "truncated")


@query("""SELECT o_custkey, arg_min(p, o_orderkey) FILTER (p IS NOT NULL) AS priority, arg_min(s, o_orderkey) FILTER (s IS NOT NULL) AS status FROM (
  SELECT o_custkey, o_orderkey, nullif(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END, '') AS p,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS s FROM orders) GROUP BY o_custkey""")
def first_non_empty(spark, d):
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        "o_custkey", key, F.when(key % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("priority"),
        F.when(key % 3 == 0, F.col("o_orderstatus")).alias("status"),
    )
    return M.first_values(rows, ["o_custkey"], ["priority", "status"], key)


@query("""SELECT p_brand, arg_min(p_type, p_partkey) AS form, arg_max(p_name, row(length(p_name), -p_partkey)) AS composition,
string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS ingredients FROM part GROUP BY p_brand""")
def longest_wins(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(
        F.min_by("p_type", "p_partkey").alias("form"),
        F.max_by("p_name", F.struct(F.length("p_name"), -F.col("p_partkey"))).alias("composition"),
        F.array_join(F.array_sort(F.collect_set("p_name")), ",").alias("ingredients"),
    )


@query(GRAPH + """ SELECT e.lo, e.hi, max(r.rank) AS worst, max(source_rank) AS evidence, arg_max(source, row(source_rank, -seq)) AS effect,
array_to_string((list(DISTINCT source ORDER BY source))[1:4], ' | ') AS mechanisms FROM edges e JOIN sevrank r USING (severity) GROUP BY ALL""")
def evidence_max(spark, d):
    sources = F.slice(F.array_sort(F.collect_set("source")), 1, 4)
    return N.direct_edges(spark, d).groupBy("lo", "hi").agg(
        F.max(S.ranked(F.col("severity"), S.SEVERITY_RANK, 1)).alias("worst"), F.max("source_rank").alias("evidence"),
        F.max_by("source", F.struct("source_rank", -F.col("seq"))).alias("effect"), F.array_join(sources, " | ").alias("mechanisms"),
    )


@query("""SELECT l_partkey, l_suppkey, CASE min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) WHEN 1 THEN 'high_confidence'
WHEN 2 THEN 'label_derived' ELSE 'weak' END AS confidence FROM lineitem GROUP BY ALL""")
def priority_merge(spark, d):
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("R", "high_confidence", "A", "label_derived", "N", "weak")]), F.col("l_returnflag"))
    rank = F.element_at(F.create_map(*[F.lit(x) for x in ("R", 1, "A", 2, "N", 3)]), F.col("l_returnflag"))
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min_by(kind, rank).alias("confidence"))


@query(GRAPH + """, ends AS (SELECT lo AS node FROM edges UNION ALL SELECT hi FROM edges), deg AS (SELECT node, count(*) AS degree FROM ends GROUP BY node),
grp AS (SELECT drug AS node, brand || '/' || name AS same, coalesce(degree, 0) AS degree FROM drugs LEFT JOIN deg ON node = drug),
prim AS (SELECT node, first_value(node) OVER (PARTITION BY same ORDER BY degree DESC, node) AS main FROM grp)
SELECT DISTINCT a.main AS src, b.main AS dst, e.source FROM edges e JOIN prim a ON a.node = e.lo JOIN prim b ON b.node = e.hi WHERE a.main <> b.main""")
def entity_merge(spark, d):
    edges = N.direct_edges(spark, d).select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "source")
    nodes = N.drugs(spark, d).select(F.col("drug").alias("node"), F.concat_ws("/", "brand", "name").alias("same"))
    nodes = nodes.join(G.degrees(edges), "node", "left").fillna(0, ["degree"])
    return M.rewired(edges, M.primaries(nodes, "node", "same", "degree"), ["source"])


@query(GRAPH + """ SELECT node, count(*) AS degree FROM (SELECT lo AS node FROM edges UNION ALL SELECT hi FROM edges
UNION ALL SELECT src FROM inhibits UNION ALL SELECT dst FROM inhibits) GROUP BY node""")
def degree(spark, d):
    pairs = N.direct_edges(spark, d).select(F.col("lo").alias("src"), F.col("hi").alias("dst"))
    return G.degrees(pairs, N.inhibits(spark, d).select("src", "dst"))


@query("""SELECT 'event' AS label, event_type AS kind, count(*) AS n FROM events GROUP BY event_type
UNION ALL SELECT 'part', p_type, count(*) FROM part GROUP BY p_type UNION ALL SELECT 'order', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus""")
def counts_by_type(spark, d):
    count = lambda t, c, label: table(spark, d, t).groupBy(F.col(c).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "kind", "n")
    return count("events", "event_type", "event").union(count("part", "p_type", "part")).union(count("orders", "o_orderstatus", "order"))


@query("""SELECT count(*) AS total, count(doc_id) AS has_doc_id, count(text) AS has_text, count(nullif(lang, 'en')) AS has_lang, count(source) AS has_source FROM documents""")
def completeness_profile(spark, d):
    docs = table(spark, d, "documents")
    return docs.agg(F.count("*").alias("total"), F.count("doc_id").alias("has_doc_id"), F.count("text").alias("has_text"),
                    F.count(F.nullif("lang", F.lit("en"))).alias("has_lang"), F.count("source").alias("has_source"))


@query(GRAPH + """ SELECT g.drug, coalesce(i.n, 0) AS enzymes, coalesce(s.n, 0) AS routes, coalesce(e.n, 0) AS partners FROM drugs g
LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM inhibits GROUP BY src) i ON i.src = g.drug
LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM substrates GROUP BY src) s ON s.src = g.drug
LEFT JOIN (SELECT lo, count(DISTINCT hi) AS n FROM edges GROUP BY lo) e ON e.lo = g.drug""")
def facet_counts(spark, d):
    two = lambda df: df.select("src", "dst")
    return G.facets(N.drugs(spark, d), "drug", enzymes=two(N.inhibits(spark, d)), routes=two(N.substrates(spark, d)),
                    partners=N.direct_edges(spark, d).select("lo", "hi"))


@query("""SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS filled, count(*) FILTER (o_totalprice > 100000) AS large,
count(DISTINCT (o_custkey, o_orderstatus)) AS customers FROM orders GROUP BY ALL""")
def conditional_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.count_if(F.col("o_totalprice") > 100000).alias("large"),
        F.countDistinct("o_custkey", "o_orderstatus").alias("customers"),
    )


@query("""SELECT p_type, p_name, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_type, p_name LIMIT 20""")
def unresolved_top(spark, d):
    counts = table(spark, d, "part").groupBy("p_type", "p_name").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "p_type", "p_name").limit(20)


@query("""SELECT tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), 4) AS sensitivity, round(tn / nullif(tn + fp, 0), 4) AS specificity,
round(tp / nullif(tp + fp, 0), 4) AS ppv, round(tn / nullif(tn + fn, 0), 4) AS npv, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM (
SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality <> 0 AND toxic = 1) AS fp,
count(*) FILTER (quality = 0 AND toxic <> 1) AS fn, count(*) FILTER (quality <> 0 AND toxic <> 1) AS tn FROM labels)""")
def confusion_metrics(spark, d):
    return E.confusion(table(spark, d, "labels"), F.col("quality") == 0, F.col("toxic") == 1)


@query("""WITH c AS (SELECT l_linenumber - 1 AS i, CASE WHEN l_quantity > 40 THEN 3 WHEN l_quantity > 25 THEN 2 WHEN l_quantity > 10 THEN 1 ELSE 0 END AS j
  FROM lineitem), n AS (SELECT i, j, count(*)::DOUBLE AS n FROM c GROUP BY ALL),
a AS (SELECT i, sum(n) AS ni FROM n GROUP BY i), b AS (SELECT j, sum(n) AS nj FROM n GROUP BY j)
SELECT (SELECT sum(n) FROM n)::BIGINT AS n, round(1 - (SELECT sum((i - j) * (i - j) / 36.0::DOUBLE * n) FROM n) * (SELECT sum(n) FROM n)
  / (SELECT sum((i - j) * (i - j) / 36.0::DOUBLE * ni * nj) FROM a, b), 4) AS kappa""")
def weighted_kappa(spark, d):
    q = F.col("l_quantity")
    seen = F.when(q > 40, 4).when(q > 25, 3).when(q > 10, 2).otherwise(1)
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("expected"), seen.alias("observed"))
    return E.weighted_kappa(rows, "expected", "observed", [1, 2, 3, 4, 5, 6, 7])


@query("""SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50,
round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY event_type""")
def latency_percentiles(spark, d):
    return E.latencies(table(spark, d, "events"), "value", ("event_type",))


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 4) AS jaccard FROM
(SELECT n_nationkey, n_regionkey, string_split(n_name || '_' || n_regionkey, '_') AS x FROM nation) a JOIN
(SELECT n_nationkey, n_regionkey, string_split(n_name || '_' || n_regionkey, '_') AS y FROM nation) b
ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def jaccard(spark, d):
    words = F.split(F.concat_ws("_", "n_name", F.col("n_regionkey").cast("string")), "_")
    one = table(spark, d, "nation").select("n_nationkey", "n_regionkey", words.alias("w"))
    a, b = (one.select(F.col("n_nationkey").alias(k), "n_regionkey", F.col("w").alias(f"w{k}")) for k in "ab")
    return a.join(b, "n_regionkey").where("a < b").select("a", "b", E.jaccard(F.col("wa"), F.col("wb")).alias("jaccard"))


# --- windows, order, sets -------------------------------------------------------------------------------------------


@query("""SELECT user_id AS drug, event_type AS effect, frequency, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frequency DESC NULLS LAST, event_type)::INT AS rank FROM (
    SELECT user_id, event_type, nullif(count(*), 1) AS frequency FROM events GROUP BY ALL)) WHERE rank <= 3""")
def top5_per_key(spark, d):
    effects = table(spark, d, "events").groupBy(F.col("user_id").alias("drug"), F.col("event_type").alias("effect")).agg(
        F.nullif(F.count("*"), F.lit(1)).alias("frequency")
    )
    return safety.side_effects(effects.select("drug"), effects, 3)


@query("""WITH q AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS q FROM part), s AS (
  SELECT q, p_partkey, p_retailprice, row_number() OVER (PARTITION BY q ORDER BY p_retailprice DESC, p_partkey) AS r
  FROM q JOIN part ON list_contains(string_split(p_name, ' '), q))
SELECT p_partkey, max(p_retailprice) AS score FROM s WHERE r <= 10 GROUP BY p_partkey""")
def topk_then_max(spark, d):
    words = table(spark, d, "part").select("p_partkey", "p_retailprice", F.explode(F.array_distinct(F.split("p_name", " "))).alias("q"))
    top = M.top_per_key(words, ["q"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 10)
    return top.groupBy("p_partkey").agg(F.max("p_retailprice").alias("score"))


_FINDINGS = """, f AS (""" + _PATHS.format(kind="inhibition", score=_STRENGTH, cap=15, first="inhibits") + """
  UNION ALL""" + _SHARED.format(kind="qt", score=8.0, first="inhibits", second="inhibits", pair="x.drug < y.drug") + """
), shown AS (SELECT *, CASE WHEN score >= 8 THEN 'critical' WHEN score >= 5 THEN 'major' WHEN score > 0 THEN 'moderate' ELSE 'doctor_review' END AS shown FROM f
), placed AS (SELECT s.*, coalesce(r.rank, 1) * 10 + CASE WHEN mechanism IN ('inhibition', 'induction') THEN 2 ELSE 0 END AS priority
  FROM shown s LEFT JOIN sevrank r ON r.severity = s.shown)"""


def _findings(spark, d):
    baskets, inhibits, many = N.baskets(spark, d), N.inhibits(spark, d), N.parts(spark, d)
    paths = safety.metabolic(baskets, inhibits, N.substrates(spark, d), N.drugs(spark, d), parts=many)
    found = paths.unionByName(safety.shared_effect(baskets, inhibits, "qt", parts=many))
    return found.withColumn("severity", F.lit(None).cast("string"))


@query(GRAPH + _FINDINGS + """ SELECT patient, mechanism, a, b, mid, shown, priority, 'finding_' || r AS finding_id FROM (
SELECT *, row_number() OVER (PARTITION BY patient ORDER BY priority DESC, score DESC, mechanism, a, b, mid) AS r FROM placed) WHERE r <= 15""")
def ranked_ids(spark, d):
    return safety.report(N.dealt(spark, d, _findings(spark, d), "patient")).select("patient", "mechanism", "a", "b", "mid", "shown", "priority", "finding_id")


@query(GRAPH + _FINDINGS + " SELECT patient, mechanism, a, b, mid, priority FROM placed ORDER BY priority DESC, patient, a, b, mid, mechanism LIMIT 60")
def priority_sort_limit(spark, d):
    shown = S.score_severity(F.col("score"))
    priority = S.finding_priority(S.ranked(shown, S.SEVERITY_RANK, 1), F.col("mechanism") == "inhibition")
    rows = _findings(spark, d).select("patient", "mechanism", "a", "b", "mid", priority.alias("priority"))
    return rows.orderBy(F.col("priority").desc(), "patient", "a", "b", "mid", "mechanism").limit(60)


@query(GRAPH + _FINDINGS + """ SELECT patient, count(*) AS total, count(*) FILTER (shown = 'critical') AS n_critical, count(*) FILTER (shown = 'major') AS n_major,
count(*) FILTER (shown = 'moderate') AS n_moderate, count(*) FILTER (shown = 'minor') AS n_minor, count(*) FILTER (shown = 'doctor_review') AS n_doctor_review
FROM placed GROUP BY patient""")
def union_findings(spark, d):
    return safety.summary(N.dealt(spark, d, _findings(spark, d), "patient"))


@query(GRAPH + """, known AS (SELECT a.patient, a.drug AS lo, b.drug AS hi FROM baskets a JOIN baskets b ON a.patient = b.patient AND a.drug < b.drug WHERE a.drug % 2 = 0),
found AS (SELECT a.patient, a.drug AS a, b.drug AS b FROM baskets a JOIN baskets b ON a.patient = b.patient AND a.drug > b.drug WHERE a.drug % 3 = 0)
SELECT patient, a, b, least(a, b) AS lo, greatest(a, b) AS hi FROM found WHERE (patient, least(a, b), greatest(a, b)) NOT IN (SELECT (patient, lo, hi) FROM known)""")
def drop_known_pairs(spark, d):
    pairs = G.basket_pairs(N.baskets(spark, d), "patient", "drug")
    known = pairs.where("lo % 2 = 0").select("patient", F.col("lo").alias("a"), F.col("hi").alias("b"))
    found = pairs.where("hi % 3 = 0").select("patient", F.col("hi").alias("a"), F.col("lo").alias("b"))
    return safety.new_pairs(found, known).select("patient", "a", "b", "lo", "hi")


@query("""SELECT coalesce(a.k, b.k) AS kind, a.n AS before, b.n AS after FROM (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a
FULL JOIN (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON a.k = b.k""")
def before_after_report(spark, d):
    count = lambda cond, name: table(spark, d, "orders").where(cond).groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias(name))
    return count("o_orderkey % 2 = 0", "before").join(count("o_orderstatus = 'F'", "after"), "kind", "full_outer")


# --- text -----------------------------------------------------------------------------------------------------------


@query(r"""SELECT url, nullif(trim(regexp_replace(url, '\s+', ' ', 'g')), '') AS cleaned, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS key FROM pages""")
def normalize_text(spark, d):
    return table(spark, d, "pages").select("url", T.clean(F.col("url")).alias("cleaned"), T.lookup_key(F.col("url")).alias("key"))


@query("""SELECT p_partkey, array_to_string(list_filter(string_split(lower(raw), ' '), lambda w: NOT list_contains(['sodium', 'hcl'], w)), ' ') AS bare FROM (
SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' Sodium' ELSE ' HCL' END AS raw FROM part)""")
def strip_qualifiers(spark, d):
    raw = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " Sodium").otherwise(" HCL"))
    return table(spark, d, "part").select("p_partkey", T.without_words(raw).alias("bare"))


@query("""WITH t AS (SELECT p_partkey, p_name AS n, (p_size * 10)::VARCHAR AS mg FROM part)
SELECT p_partkey, n || ' ' || mg || ' mg;' || n || ' ' || mg || 'mg;' || n || ' ' || mg || ';' || n || ';' || mg || ' ' || n AS variants FROM (
  SELECT p_partkey, lower(n) AS n, mg FROM t)""")
def search_variants(spark, d):
    raw = F.concat(F.initcap("p_name"), F.lit(" "), (F.col("p_size") * 10).cast("string"), F.lit("mg Tablet"))
    variants = T.brand_variants(raw)
    # the form stands in the first variant only, which the SQL leaves out
    parts = N.dealt(spark, d, table(spark, d, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    return parts.select("p_partkey", F.array_join(F.slice(variants, 2, 9), ";").alias("variants"))


@query("""SELECT l_orderkey, string_agg(k, '|' ORDER BY i) AS keys FROM (SELECT l_orderkey, k, min(i) AS i FROM (
  SELECT l_orderkey, trim(unnest(string_split(replace(s, ';', ','), ','))) AS k, generate_subscripts(string_split(replace(s, ';', ','), ','), 1) AS i FROM (
    SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, '; ' ORDER BY l_linenumber, l_partkey, l_returnflag || l_linestatus) AS s FROM lineitem WHERE l_linenumber > 0 GROUP BY l_orderkey))
  WHERE k <> '' GROUP BY ALL) GROUP BY l_orderkey""")
def split_source_keys(spark, d):
    each = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("s"))))
    rows = table(spark, d, "lineitem").where("l_linenumber > 0").groupBy("l_orderkey").agg(F.array_join(F.transform(each, lambda x: x["s"]), "; ").alias("s"))
    return rows.select("l_orderkey", F.array_join(T.split_keys(F.col("s")), "|").alias("keys"))


@query(r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'https://doi.org/10.1000/x' || page_id ELSE 'https://pubmed.ncbi.nlm.nih.gov/' || page_id || '/' END AS link FROM pages""")
def reference_url(spark, d):
    number = F.col("page_id").cast("string")
    text = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("see "), F.col("url"))).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit("doi 10.1000/x"), number, F.lit(").")))
    return table(spark, d, "pages").select("page_id", T.reference_url(text.otherwise(F.concat(F.lit("PMID: "), number))).alias("link"))


@query(r"""SELECT p_partkey, array_to_string(list_distinct(list_transform(regexp_extract_all(t, '([0-9]+(?:\.[0-9]+)? ?(?:mg|mcg|ml|g|iu))(?:[^a-z0-9]|$)', 1), lambda x: replace(x, ' ', ''))), ',') AS doses
FROM (SELECT p_partkey, lower(p_name || ' ' || p_size || ' MG daily') AS t FROM part)""")
def dose_extract(spark, d):
    text = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.lit("MG daily"))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.doses(text), ",").alias("doses"))


@query("""SELECT conv_id, turn, CASE turn % 5 WHEN 1 THEN 'ta' WHEN 2 THEN 'te' WHEN 3 THEN 'kn' WHEN 4 THEN 'hi' ELSE 'en' END AS lang, CASE WHEN length(text) > 100 THEN rtrim(substr(text, 1, 97)) || '...' ELSE text END AS short FROM conversations""")
def script_detect(spark, d):
    text = F.col("text")
    letter = F.element_at(F.create_map(*[F.lit(x) for x in (1, "\u0b85", 2, "\u0c05", 3, "\u0c85", 4, "\u0905")]), (F.col("turn") % 5).cast("int"))
    lang = T.script_language(F.concat_ws(" ", text, letter))
    return table(spark, d, "conversations").select("conv_id", "turn", lang.alias("lang"), T.truncated(text, 100).alias("short"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'statin' WHEN p_partkey % 3 = 1 THEN 'beta blocker' END AS class FROM part""")
def suffix_class(spark, d):
    ending = F.when(F.col("p_partkey") % 3 == 0, "vastatin").when(F.col("p_partkey") % 3 == 1, "prolol").otherwise("x")
    return table(spark, d, "part").select("p_partkey", T.class_by_suffix(F.concat("p_name", ending)).alias("class"))


@query("""SELECT user_id, event_type, CASE WHEN s >= 0.1 THEN 'common' WHEN s >= 0.01 THEN 'uncommon' ELSE 'rare' END AS band FROM (
SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) / 2 AS s FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL))""")
def frequency_class(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("user_id")) / 2
    return counts.select("user_id", "event_type", S.frequency_band(share).alias("band"))


@query("""SELECT event_id, (props->>'$.k')::INT AS k, CASE WHEN (props->>'$.k')::INT >= 50 THEN 'high' END AS level FROM events""")
def json_props(spark, d):
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.when(k >= 50, "high").alias("level"))


@query("SELECT p_partkey, lower(replace(p_name, ' ', '-')) AS slug, upper(replace(p_name, ' ', '_')) AS relation, p_name || ' | ' || p_brand AS locator FROM part")
def slugs(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", T.slug(name).alias("slug"), T.relation_name(name).alias("relation"), T.locator(name, F.lit(" "), F.col("p_brand")).alias("locator")
    )


# --- sinks ----------------------------------------------------------------------------------------------------------


def _old_new(spark, d):
    parts = table(spark, d, "part")
    old = parts.where("p_partkey % 3 <> 0").select("p_partkey", F.col("p_name").alias("name"), F.nullif("p_type", F.lit("SMALL")).alias("kind"))
    new = parts.where("p_partkey % 2 = 0").select("p_partkey", F.upper("p_name").alias("name"), F.nullif("p_brand", F.lit("Brand#2")).alias("kind"))
    return old, new


_OLD_NEW = """WITH o AS (SELECT p_partkey, p_name AS name, nullif(p_type, 'SMALL') AS kind FROM part WHERE p_partkey % 3 <> 0),
n AS (SELECT p_partkey, upper(p_name) AS name, nullif(p_brand, 'Brand#2') AS kind FROM part WHERE p_partkey % 2 = 0)"""


@query(_OLD_NEW + " SELECT p_partkey, coalesce(n.name, o.name) AS name, coalesce(n.kind, o.kind) AS kind FROM o FULL JOIN n USING (p_partkey)")
def upsert_new_wins(spark, d):
    return M.upsert(*_old_new(spark, d), ["p_partkey"], "new")


@query(_OLD_NEW + " SELECT p_partkey, coalesce(o.name, n.name) AS name, coalesce(o.kind, n.kind) AS kind FROM o FULL JOIN n USING (p_partkey)")
def upsert_old_wins(spark, d):
    return M.upsert(*_old_new(spark, d), ["p_partkey"], "old")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' | ' || p_brand ELSE p_name END AS note FROM part""")
def append_if_absent(spark, d):
    parts = table(spark, d, "part")
    old = parts.select("p_partkey", F.col("p_name").alias("note"))
    new = parts.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.substring("p_name", 1, 3)).alias("note"))
    return M.append_text(old, new, ["p_partkey"], "note")


@query(_OLD_NEW + " SELECT * FROM o UNION ALL SELECT * FROM n WHERE p_partkey NOT IN (SELECT p_partkey FROM o)")
def insert_if_absent(spark, d):
    return M.insert_missing(*_old_new(spark, d), ["p_partkey"])


@query(GRAPH + """, o AS (SELECT lo, hi, severity, seq FROM edges WHERE seq % 2 = 0), n AS (SELECT lo, hi, 'major' AS severity, min(seq) AS seq FROM edges WHERE seq % 3 = 0 GROUP BY lo, hi),
e AS (SELECT *, false AS fresh, CASE WHEN severity = 'unknown' THEN 0 ELSE 2 END AS w FROM o UNION ALL SELECT *, true, 1 FROM n),
b AS (SELECT lo, hi, arg_max(severity, row(w, -seq)) AS severity, arg_max(fresh, row(w, -seq)) AS fresh, bool_or(NOT fresh) AS had, bool_or(fresh) AS came FROM e GROUP BY lo, hi)
SELECT lo, hi, severity, CASE WHEN NOT came THEN 'untouched' WHEN NOT had THEN 'created' WHEN fresh THEN 'upgraded' ELSE 'skipped_existing' END AS outcome FROM b""")
def authoritative_upsert(spark, d):
    edges = N.direct_edges(spark, d).select("lo", "hi", "severity", "seq")
    new = edges.where("seq % 3 = 0").groupBy("lo", "hi").agg(F.lit("major").alias("severity"), F.min("seq").alias("seq"))
    best = M.authoritative(edges.where("seq % 2 = 0"), new, ["lo", "hi"], F.col("severity") == "unknown", F.col("seq"))
    return best.select("lo", "hi", "severity", "outcome")


@query(GRAPH + " SELECT src, dst, strength FROM inhibits WHERE src IN (SELECT drug FROM drugs WHERE nti) AND dst IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def match_only_edges(spark, d):
    alive = table(spark, d, "supplier").where("s_acctbal > 0")
    return M.match_only(N.inhibits(spark, d), N.drugs(spark, d).where("nti"), "drug", alive, "s_suppkey").select("src", "dst", "strength")


@query(GRAPH + """, k AS (SELECT lo, hi, min(severity) AS given FROM edges WHERE source = '1-URGENT' AND severity <> 'unknown' GROUP BY ALL)
SELECT lo, hi, source, seq, CASE WHEN source = '5-LOW' AND severity = 'unknown' THEN coalesce(given, severity) ELSE severity END AS severity
FROM edges LEFT JOIN k USING (lo, hi)""")
def copied_severity(spark, d):
    edges = N.direct_edges(spark, d).select("lo", "hi", "source", "seq", "severity")
    return M.copied_from_peer(edges, "5-LOW", "1-URGENT", "severity").select("lo", "hi", "source", "seq", "severity")


# --- inference, claims, resolution, report --------------------------------------------------------------------------


@query(GRAPH + """, ev AS (SELECT user_id, bool_or(event_type = 'error') AS bad, bool_or(event_type = 'purchase') AS mid FROM events WHERE value > 60 GROUP BY user_id),
t AS (SELECT e.lo, e.hi, e.seq, e.severity AS original_severity, CASE WHEN v.bad THEN 'major' WHEN v.mid THEN 'moderate' WHEN v.user_id IS NOT NULL THEN 'minor' END AS t1,
  CASE WHEN a.nti OR b.nti OR a.class = b.class AND a.class = 'PROMO' THEN 'major' END AS t2
  FROM edges e JOIN drugs a ON a.drug = e.lo JOIN drugs b ON b.drug = e.hi LEFT JOIN ev v ON v.user_id = e.lo)
SELECT lo, hi, seq, CASE WHEN original_severity = 'unknown' THEN coalesce(t1, t2, 'moderate') ELSE original_severity END AS severity,
  CASE WHEN original_severity <> 'unknown' THEN 'original' WHEN t1 IS NOT NULL THEN 'shared_events' WHEN t2 IS NOT NULL THEN 'pharmacology_rule' ELSE 'default' END AS method,
  original_severity = 'unknown' AND t1 IS NULL AND t2 IS NULL AS review_needed FROM t""")
def severity_tiers(spark, d):
    drugs = N.drugs(spark, d).select("drug", "nti", "class")
    word = F.when(F.col("event_type") == "error", "acute renal failure").when(F.col("event_type") == "purchase", "Bleeding").otherwise("rash")
    events = table(spark, d, "events").where("value > 60").groupBy("user_id").agg(F.collect_set(word).alias("events"))
    side = lambda c: drugs.select(F.col("drug").alias(c), F.col("nti").alias(f"nti_{c}"), F.col("class").alias(f"class_{c}"))
    edges = N.direct_edges(spark, d).select("lo", "hi", "seq", "severity").join(side("lo"), "lo").join(side("hi"), "hi")
    edges = edges.join(events, F.col("lo") == F.col("user_id"), "left").withColumn("events", F.coalesce("events", F.array().cast("array<string>")))
    same = (F.col("class_lo") == F.col("class_hi")) & (F.col("class_lo") == "PROMO")
    tiers = [V.event_tier(F.col("events")), V.rule_tier(F.col("nti_lo") | F.col("nti_hi"), same)]
    return V.inferred(edges, tiers, "moderate").select("lo", "hi", "seq", "severity", "method", "review_needed")


@query(GRAPH + " SELECT source, count(*) AS edges, count(*) FILTER (severity = 'unknown') AS unknown FROM edges GROUP BY source")
def unknown_severity_counts(spark, d):
    return V.unknown_counts(N.direct_edges(spark, d))


@query(GRAPH + """, c AS (SELECT src AS a, dst AS mid, (src + 7) % (SELECT count(*) FROM part) AS b, confidence FROM inhibits UNION ALL
  SELECT src + 1, dst, (src + 3) % (SELECT count(*) FROM part), confidence FROM inhibits),
h AS (SELECT c.*, (EXISTS (SELECT 1 FROM inhibits i WHERE i.src = c.a AND i.dst = c.mid))::INT + (EXISTS (SELECT 1 FROM substrates s WHERE s.src = c.b AND s.dst = c.mid))::INT AS hops FROM c)
SELECT a, mid, b, CASE hops WHEN 2 THEN 'confirmed' WHEN 1 THEN 'partial' ELSE 'removed' END AS verdict,
round(CASE hops WHEN 2 THEN least(least(confidence, 0.75::DOUBLE) * 1.1::DOUBLE, 1.0::DOUBLE) WHEN 1 THEN least(confidence, 0.75::DOUBLE) * 0.8::DOUBLE ELSE least(confidence, 0.75::DOUBLE) END, 4) AS confidence,
hops <> 2 AS is_ai_assessed FROM h""")
def claim_verification(spark, d):
    inhibits = N.inhibits(spark, d)
    many = table(spark, d, "part").count()
    other = lambda step: ((F.col("src") + step) % many).alias("b")
    claims = inhibits.select(F.col("src").alias("a"), F.col("dst").alias("mid"), other(7), "confidence").unionByName(
        inhibits.select((F.col("src") + 1).alias("a"), F.col("dst").alias("mid"), other(3), "confidence"))
    return safety.verified(claims, inhibits, N.substrates(spark, d)).select("a", "mid", "b", "verdict", "confidence", "is_ai_assessed")


@query("""WITH raw AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN 'old ' || p_name ELSE 'zzz' END AS raw FROM part),
n AS (SELECT *, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) AS key FROM raw),
e1 AS (SELECT DISTINCT lower(p_name) AS key, p_name AS entity FROM part), e2 AS (SELECT DISTINCT 'old ' || lower(p_name) AS key, p_name AS entity FROM part),
e3 AS (SELECT replace(lower(p_brand), '#', ' ') AS key, min(p_name) AS entity FROM part GROUP BY 1)
SELECT p_partkey, raw, coalesce(e1.entity, e2.entity, e3.entity) AS entity,
CASE WHEN e1.entity IS NOT NULL THEN 'exact' WHEN e2.entity IS NOT NULL THEN 'synonym' WHEN e3.entity IS NOT NULL THEN 'brand' ELSE 'none' END AS match_type,
CASE WHEN e1.entity IS NOT NULL THEN 1.0 WHEN e2.entity IS NOT NULL THEN 0.98 WHEN e3.entity IS NOT NULL THEN 0.93 ELSE 0.0 END::DOUBLE AS confidence
FROM n LEFT JOIN e1 USING (key) LEFT JOIN e2 USING (key) LEFT JOIN e3 USING (key)""")
def resolve_cascade(spark, d):
    parts = table(spark, d, "part")
    name = F.col("p_name")
    raw = F.when(F.col("p_partkey") % 4 == 0, name).when(F.col("p_partkey") % 4 == 1, F.col("p_brand")).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("old "), name)).otherwise("zzz")
    tier = lambda key: parts.select(T.lookup_key(key).alias("key"), name.alias("entity"))
    tiers = [("exact", tier(name)), ("synonym", tier(F.concat(F.lit("old "), name))), ("brand", tier(F.col("p_brand")))]
    found = R.cascade(parts.select("p_partkey", raw.alias("raw")), "raw", tiers)
    return found.select("p_partkey", "raw", "entity", "match_type", "confidence")


@query("""WITH q AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS q FROM part), n AS (SELECT DISTINCT p_name AS name FROM part),
h AS (SELECT q, name, row_number() OVER (PARTITION BY q ORDER BY name) AS rank FROM q JOIN n ON list_contains(string_split(name, ' '), q))
SELECT q, name, false AS exact, 1.0::DOUBLE AS score, rank::INT AS rank FROM h WHERE rank <= 5""")
def brand_search(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name"))
    wanted = names.select(F.split("name", " ")[1].alias("q")).distinct()
    return R.search(wanted, "q", names, "name", 5)


@query("""SELECT n_name, CASE WHEN n = 1 THEN g END AS generic FROM nation LEFT JOIN (
  SELECT a.n_nationkey AS k, count(DISTINCT b.n_regionkey) AS n, min('r' || b.n_regionkey) AS g FROM nation a JOIN nation b
  ON starts_with(lower(replace(b.n_name, '_', ' ')), lower(replace(a.n_name, '_', ' '))) OR starts_with(lower(replace(a.n_name, '_', ' ')), lower(replace(b.n_name, '_', ' '))) GROUP BY 1) ON k = n_nationkey""")
def brand_family(spark, d):
    nation = table(spark, d, "nation")
    known = nation.select(T.lookup_key(F.col("n_name")).alias("brand_key"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("generic"))
    return R.family_generic(nation.select("n_name"), "n_name", known)


@query(GRAPH + """, cond AS (SELECT o_orderkey AS patient, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Chronic Kidney Disease' ELSE lower(o_orderstatus) || ' heart' END AS condition FROM orders),
g AS (SELECT drug, acb = 3 AS listed, nti AS renal FROM drugs), old AS (SELECT * FROM baskets WHERE age >= 65)
SELECT patient, drug, 'listed' AS rule, '' AS detail FROM old JOIN g USING (drug) WHERE listed
UNION ALL SELECT DISTINCT patient, drug, 'condition', 'F Heart' FROM old JOIN cond USING (patient) WHERE drug % 10 = 0 AND contains(lower(condition), 'f heart')
UNION ALL SELECT a.patient, a.drug, 'pair', b.drug::VARCHAR FROM old a JOIN old b ON a.patient = b.patient AND a.drug < b.drug JOIN (SELECT DISTINCT lo, hi FROM edges WHERE guideline) e ON e.lo = a.drug AND e.hi = b.drug
UNION ALL SELECT patient, drug, 'renal', '' FROM old JOIN g USING (drug) JOIN cond USING (patient) WHERE renal AND contains(lower(condition), 'kidney')""")
def criteria_screening(spark, d):
    orders = table(spark, d, "orders")
    condition = F.when(F.col("o_orderpriority") == "1-URGENT", "Chronic Kidney Disease").otherwise(F.concat(F.lower("o_orderstatus"), F.lit(" heart")))
    conditions = orders.select(F.col("o_orderkey").alias("patient"), condition.alias("condition"))
    drugs = N.drugs(spark, d)
    listed = drugs.select("drug", (F.col("acb") == 3).alias("listed"), F.col("nti").alias("renal"))
    rules = drugs.where("drug % 10 = 0").select("drug", F.lit("F Heart").alias("word"))
    return safety.criteria(N.baskets(spark, d), listed, conditions, rules, N.dealt_edges(spark, d).where("guideline"))


@query(GRAPH + """, herbs AS (SELECT o_orderkey AS patient, o_custkey % 100 AS herb FROM orders)
SELECT h.patient, h.herb, b.drug, 'major' AS severity, 'direct' AS mechanism FROM herbs h JOIN baskets b USING (patient) WHERE b.drug % 7 = 0 AND h.herb % 2 = 0
UNION ALL SELECT DISTINCT h.patient, h.herb, b.drug, 'moderate', 'metabolic' FROM herbs h JOIN inhibits i ON i.src = h.herb JOIN substrates s ON s.dst = i.dst JOIN baskets b ON b.patient = h.patient AND b.drug = s.src""")
def herb_drug(spark, d):
    herbs = table(spark, d, "orders").select(F.col("o_orderkey").alias("patient"), (F.col("o_custkey") % 100).alias("herb"))
    drugs = N.drugs(spark, d).where("drug % 7 = 0").select(F.col("drug").alias("dst"))
    edges = drugs.withColumn("src", F.explode(F.sequence(F.lit(0), F.lit(98), F.lit(2)))).select(F.col("src").cast("long"), "dst", F.lit("major").alias("severity"))
    return safety.with_herbs(herbs, N.baskets(spark, d), edges, N.inhibits(spark, d), N.substrates(spark, d))


@query("""WITH s AS (SELECT l_suppkey, l_partkey, l_orderkey, l_quantity, l_linenumber FROM lineitem)
SELECT l_suppkey, l_partkey, count(*) AS n_studies, arg_max(l_orderkey, row(l_quantity, -(l_orderkey * 10 + l_linenumber))) AS best_order FROM s GROUP BY ALL""")
def best_study(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_quantity", "l_linenumber")
    best = P.best_study(rows, ["l_suppkey", "l_partkey"], [F.col("l_quantity")], F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return best.select("l_suppkey", "l_partkey", "n_studies", F.col("l_orderkey").alias("best_order"))


_SCOPES = """CASE WHEN k = 0 THEN 'guideline_table' WHEN k = 1 THEN 'exact_reference' WHEN k = 2 THEN 'literature_mention' WHEN k = 3 THEN 'dataset_record' WHEN k = 4 THEN 'dataset_source'
WHEN k = 5 THEN 'local_curated_rule' ELSE 'source_only' END"""


def _citations(spark, d):
    k = F.col("p_partkey") % 7
    on = lambda n, value: F.when(k == n, value)
    rows = table(spark, d, "part").select(
        "p_partkey", "p_brand", F.coalesce(on(0, "clinical_guideline"), on(5, "local_curated_layer"), F.when(k.isin(3, 4), "external_dataset")).alias("provenance"),
        on(1, "doi").alias("link_kind"), F.when(k.isin(1, 2), "some paper").alias("reference"), F.lit("").alias("table"), on(3, "row 1").alias("locator"),
        F.lit(None).cast("string").alias("backing"),
    )
    scope = P.evidence_scope({c: F.col(c) for c in ("provenance", "link_kind", "reference", "table", "locator", "backing")})
    return rows.withColumn("scope", scope)


@query(f"SELECT p_partkey, {_SCOPES} AS scope FROM (SELECT p_partkey, p_partkey % 7 AS k FROM part)")
def evidence_scopes(spark, d):
    return _citations(spark, d).select("p_partkey", "scope")


@query(f"""SELECT p_brand, array_to_string((list(scope ORDER BY r))[1:2], ' + ') AS scopes, count(*) AS n_scopes FROM (
SELECT DISTINCT p_brand, {_SCOPES} AS scope, CASE k WHEN 6 THEN 10 WHEN 5 THEN 7 ELSE k + 1 END AS r FROM (SELECT p_brand, p_partkey % 7 AS k FROM part)) GROUP BY p_brand""")
def scope_profile(spark, d):
    return P.scope_profile(_citations(spark, d), ["p_brand"], "scope")


@query("SELECT p_brand, p_type, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY p_brand, p_type")
def citation_dedupe(spark, d):
    rows = table(spark, d, "part").select("p_brand", "p_type", "p_partkey", "p_name")
    return P.deduplicated(rows, ["p_brand", "p_type"], F.col("p_partkey"))


@query("""SELECT metric, value, CASE WHEN value IS NULL THEN 'pending-data' WHEN value >= target THEN 'pass' ELSE 'needs-review' END AS status FROM (
SELECT 'quality_' || lang AS metric, round(avg(quality), 4) AS value, 0.85 AS target FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang)""")
def scoreboard(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.round(F.avg("quality"), 4).alias("value"))
    return rows.select(F.concat(F.lit("quality_"), "lang").alias("metric"), "value", E.gate(F.col("value"), F.lit(">="), F.lit(0.85)).alias("status"))


_REPORT = GRAPH + """, d AS (SELECT patient, count(*) AS direct_pairs, count(*) FILTER (rank = 4) AS direct_major FROM (
  SELECT a.patient, a.drug, b.drug, max(r.rank) AS rank FROM baskets a JOIN baskets b ON a.patient = b.patient AND a.drug < b.drug JOIN edges e ON e.lo = a.drug AND e.hi = b.drug
  JOIN sevrank r USING (severity) GROUP BY a.patient, a.drug, b.drug) GROUP BY patient),
i AS (SELECT x.patient, count(*) AS indirect FROM baskets x JOIN inhibits i ON i.src = x.drug JOIN substrates s ON s.dst = i.dst JOIN baskets y ON y.patient = x.patient AND y.drug = s.src AND y.drug <> x.drug GROUP BY x.patient),
b AS (SELECT patient, count(*) AS drugs, sum(acb)::BIGINT AS burden FROM baskets JOIN drugs USING (drug) GROUP BY patient),
u AS (SELECT patient, count(*) AS duplicates FROM (SELECT patient, name FROM baskets JOIN drugs USING (drug) GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT patient, class FROM baskets JOIN drugs USING (drug) GROUP BY ALL HAVING count(DISTINCT name) > 1) GROUP BY patient)
SELECT patient, drugs, coalesce(direct_pairs, 0) AS direct_pairs, coalesce(direct_major, 0) AS direct_major, coalesce(indirect, 0) AS indirect, burden,
CASE WHEN burden >= 3 THEN 'high' WHEN burden >= 1 THEN 'moderate' ELSE 'low' END AS band, coalesce(duplicates, 0) AS duplicates,
CASE WHEN drugs >= 8 THEN 'high' WHEN drugs >= 4 THEN 'medium' ELSE 'low' END AS complexity
FROM b LEFT JOIN d USING (patient) LEFT JOIN i USING (patient) LEFT JOIN u USING (patient)"""


@query(_REPORT)
def comprehensive_report(spark, d):
    baskets, drugs = N.baskets(spark, d), N.drugs(spark, d)
    # only the severity of a pair is counted; the counts of one kind are written before the next kind is looked for, so that the
    # shuffle files of all kinds never lie on the disks together
    rank = F.max(S.ranked(F.col("severity"), S.SEVERITY_RANK, 1)).alias("rank")
    best = N.dealt(spark, d, N.direct_edges(spark, d).select("lo", "hi", "severity"), "lo", "hi").groupBy("lo", "hi").agg(rank)
    direct = stored(G.pairwise_edges(baskets, best, "patient", "drug").groupBy("patient").agg(
        F.count("*").alias("direct_pairs"), F.count_if(F.col("rank") == S.SEVERITY_RANK["major"]).alias("direct_major")), "report-direct")
    paths = stored(safety.metabolic(baskets, N.inhibits(spark, d), N.substrates(spark, d), drugs).groupBy("patient").agg(F.count("*").alias("indirect")), "report-indirect")
    repeated = stored(safety.duplicates(_named(spark, d)).groupBy("patient").agg(F.count("*").alias("duplicates")), "report-repeats")
    direct, paths, repeated = (N.dealt(spark, d, counts, "patient") for counts in (direct, paths, repeated))
    size = baskets.groupBy("patient").agg(F.count("*").alias("drugs"))
    burden = safety.burden(baskets, drugs).select("patient", F.col("total").alias("burden"), "band")
    df = size.join(burden, "patient").join(direct, "patient", "left").join(paths, "patient", "left").join(repeated, "patient", "left")
    df = df.fillna(0, ["direct_pairs", "direct_major", "indirect", "duplicates"])
    return df.withColumn("complexity", S.complexity(F.col("drugs"), F.lit(0), F.lit(0)))
