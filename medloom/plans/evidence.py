"""Support of pairs, rates, herbs, combinations, aliases and nested values as queries, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from medloom.functions import scoring as S
from medloom.functions import text as T
from medloom.operators import merge as M
from medloom.operators import resolve as R
from medloom.operators import support as U
from medloom.plans import standin as N
from medloom.plans.queries import query
from medloom.plans.standin import GRAPH, table
from medloom.sources.shared import stored

_CARRIED = """, inh AS (SELECT DISTINCT src, s_nationkey AS dst FROM inhibits JOIN supplier ON s_suppkey = dst),
sub AS (SELECT DISTINCT src, s_nationkey AS dst FROM substrates JOIN supplier ON s_suppkey = dst)"""


def _carried(spark, d, edges):
    """Edges to suppliers as edges to their nations, which stand for transporters."""
    at = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"), F.col("s_nationkey").alias("nation"))
    return edges.join(at, "dst").select("src", F.col("nation").alias("dst")).distinct()


@query(GRAPH + _CARRIED + """ SELECT x.patient, x.drug AS a, y.drug AS b, i.dst AS mid FROM baskets x JOIN inh i ON i.src = x.drug JOIN sub s ON s.dst = i.dst
JOIN baskets y ON y.patient = x.patient AND y.drug = s.src AND y.drug <> x.drug""")
def transporter_paths(spark, d):
    inhibits, substrates = (_carried(spark, d, f(spark, d)) for f in (N.inhibits, N.substrates))
    return U.transporter_paths(N.baskets(spark, d), inhibits, substrates, "patient", "drug", N.parts(spark, d))


_PAIRS = """, pairs AS (SELECT DISTINCT a.drug AS a, b.drug AS b FROM baskets a JOIN baskets b ON a.patient = b.patient AND a.drug <> b.drug),
known AS (SELECT DISTINCT lo, hi FROM edges WHERE guideline)"""
_PATHWAYS = """SELECT DISTINCT p.a, p.b, i.dst AS mid FROM pairs p JOIN inhibits i ON i.src = p.a JOIN substrates s ON s.src = p.b AND s.dst = i.dst"""


def _pairs(spark, d, which="a <> b"):
    baskets = N.baskets(spark, d)
    a, b = (baskets.select("patient", F.col("drug").alias(k)) for k in "ab")
    return a.join(b, "patient").where(which).select("a", "b")


@query(GRAPH + _PAIRS + f""", ways AS ({_PATHWAYS}) SELECT a, b, mid FROM ways WHERE (least(a, b), greatest(a, b)) NOT IN (SELECT (lo, hi) FROM known)""")
def gap_pathways(spark, d):
    known = N.direct_edges(spark, d).where("guideline").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    pairs = _pairs(spark, d, "a < b").distinct().join(known, ["a", "b"], "left_anti")
    return U.pathways(pairs, N.inhibits(spark, d), N.substrates(spark, d), turned=True)


_SUPPORT = GRAPH + """, two AS (SELECT DISTINCT a.drug AS lo, b.drug AS hi FROM baskets a JOIN baskets b ON a.patient = b.patient AND a.drug < b.drug),
known AS (SELECT DISTINCT lo, hi FROM edges WHERE guideline),
ways AS (SELECT i.src, s.src AS dst, count(*) AS paths FROM inhibits i JOIN substrates s USING (dst) WHERE i.src <> s.src GROUP BY ALL),
many AS (SELECT lo, hi, sum(paths)::BIGINT AS paths FROM (SELECT lo, hi, paths FROM two JOIN ways ON src = lo AND dst = hi UNION ALL SELECT lo, hi, paths FROM two JOIN ways ON src = hi AND dst = lo) GROUP BY ALL),
one AS (SELECT two.lo, two.hi, CASE WHEN k.lo IS NOT NULL THEN 'direct' WHEN paths > 0 THEN 'indirect' ELSE 'none' END AS support, coalesce(paths, 0) AS paths
  FROM two LEFT JOIN known k USING (lo, hi) LEFT JOIN many USING (lo, hi)),
sup AS (SELECT lo AS a, hi AS b, support, paths FROM one UNION ALL SELECT hi, lo, support, paths FROM one)"""


def _support(spark, d, which="a <> b"):
    known = N.direct_edges(spark, d).where("guideline").select("lo", "hi")
    return U.best_support(_pairs(spark, d, which), known, N.inhibits(spark, d), N.substrates(spark, d))


@query(_SUPPORT + " SELECT * FROM sup")
def pair_support(spark, d):
    return _support(spark, d)


@query(_SUPPORT + """, f AS (SELECT x.patient, support FROM baskets x JOIN baskets y ON x.patient = y.patient AND x.drug < y.drug JOIN sup ON a = x.drug AND b = y.drug)
SELECT patient, count(support) AS findings, round(coalesce(count(*) FILTER (support = 'none') / nullif(count(support), 0), 0), 4) AS hallucination_rate,
round(10 * count(support) / any_value(items), 4) AS alerts_per_10 FROM (SELECT patient, count(*) AS items FROM baskets GROUP BY patient) LEFT JOIN f USING (patient) GROUP BY patient""")
def grounding_rates(spark, d):
    baskets = N.baskets(spark, d)
    a, b = (baskets.select("patient", F.col("drug").alias(k)) for k in "ab")
    support = stored(_support(spark, d, "a < b").select("a", "b", "support"), "grounding-support")
    findings = a.join(b, "patient").where("a < b").join(support, ["a", "b"])
    return U.alert_rates(findings, baskets, "patient", "drug", F.col("support") == "none")


@query(GRAPH + """, wanted AS (SELECT src AS lo, dst AS hi FROM inhibits WHERE src < dst)
SELECT lo, hi, seq, guideline OR EXISTS (SELECT 1 FROM wanted w WHERE w.lo = e.lo AND w.hi = e.hi) AS guideline FROM edges e
UNION ALL SELECT DISTINCT lo, hi, NULL, true FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE w.lo = e.lo AND w.hi = e.hi)""")
def flag_or_insert(spark, d):
    wanted = N.inhibits(spark, d).where("src < dst").select(F.col("src").alias("lo"), F.col("dst").alias("hi"))
    return M.flag_or_insert(N.direct_edges(spark, d).select("lo", "hi", "seq", "guideline"), wanted, ["lo", "hi"], "guideline").select("lo", "hi", "seq", "guideline")


@query("""WITH o AS (SELECT p_partkey, p_name AS name FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE upper(p_name) END AS name FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey, coalesce(nullif(n.name, ''), o.name) AS name FROM o FULL JOIN n USING (p_partkey)""")
def upsert_filled(spark, d):
    parts, key = table(spark, d, "part"), F.col("p_partkey")
    old = parts.where("p_partkey % 3 <> 0").select(key, F.col("p_name").alias("name"))
    new = parts.where("p_partkey % 2 = 0").select(key, F.when(key % 4 == 0, "").otherwise(F.upper("p_name")).alias("name"))
    return M.upsert(old, new, ["p_partkey"], "filled")


@query("""SELECT least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY ALL""")
def both_orientations(spark, d):
    df = M.both_ways(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_returnflag")
    return df.select("lo", "hi", F.array_join("values", ",").alias("flags"))


@query("""SELECT key, p_partkey, size FROM (SELECT p_brand || '/' || p_name AS key, p_partkey, count(*) OVER (PARTITION BY p_brand, p_name) AS size FROM part) WHERE size > 1""")
def shared_identifiers(spark, d):
    rows = table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_name").alias("key"), "p_partkey")
    return M.shared_keys(rows, "key").select("key", "p_partkey", "size")


@query(r"""WITH herbs AS (SELECT 'herb ' || n_name AS entity, 'sci ' || n_name || ' folium' AS scientific, 'hi ' || n_name AS hindi, 'ta ' || n_name AS tamil FROM nation),
h AS (SELECT entity, trim(regexp_replace(lower(entity), '[^a-z0-9]+', ' ', 'g')) AS own, trim(regexp_replace(lower(scientific), '[^a-z0-9]+', ' ', 'g')) AS science,
  trim(regexp_replace(lower(hindi), '[^a-z0-9]+', ' ', 'g')) AS hi, trim(regexp_replace(lower(tamil), '[^a-z0-9]+', ' ', 'g')) AS ta FROM herbs),
q AS (SELECT s_suppkey, raw, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) AS key FROM (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'HERB ' || n_name WHEN 1 THEN 'ta ' || n_name
  WHEN 2 THEN n_name || ' fol' WHEN 3 THEN 'herbal' WHEN 4 THEN 'hi ' || n_name ELSE 'zz' END AS raw FROM supplier JOIN nation ON n_nationkey = s_nationkey)),
t AS (SELECT s_suppkey, raw, (SELECT min(entity) FROM h WHERE own = key) AS e1, (SELECT min(entity) FROM h WHERE hi = key OR ta = key) AS e2,
  (SELECT min(entity) FROM h WHERE contains(' ' || science, ' ' || key)) AS e3, (SELECT min(entity) FROM h WHERE length(key) >= 4 AND substr(own, 1, 4) = substr(key, 1, 4)) AS e4 FROM q)
SELECT s_suppkey, raw, coalesce(e1, e2, e3, e4) AS entity, CASE WHEN e1 IS NOT NULL THEN 'exact' WHEN e2 IS NOT NULL THEN 'regional' WHEN e3 IS NOT NULL THEN 'scientific' WHEN e4 IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS match_type,
CASE WHEN e1 IS NOT NULL THEN 1.0 WHEN e2 IS NOT NULL THEN 0.97 WHEN e3 IS NOT NULL THEN 0.9 WHEN e4 IS NOT NULL THEN 0.72 ELSE 0.0 END::DOUBLE AS confidence FROM t""")
def herb_cascade(spark, d):
    nation, put = table(spark, d, "nation"), lambda *parts: F.concat(*[F.lit(p) if p != "n_name" else F.col(p) for p in parts])
    herbs = nation.select(put("herb ", "n_name").alias("entity"), put("sci ", "n_name", " folium").alias("scientific"), put("hi ", "n_name").alias("hindi"), put("ta ", "n_name").alias("tamil"))
    k = F.col("s_suppkey") % 6
    raw = F.when(k == 0, put("HERB ", "n_name")).when(k == 1, put("ta ", "n_name")).when(k == 2, put("n_name", " fol")).when(k == 3, "herbal").when(k == 4, put("hi ", "n_name"))
    names = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", raw.otherwise("zz").alias("raw"))
    return R.herb_cascade(names, "raw", herbs, ["hindi", "tamil"]).select("s_suppkey", "raw", "entity", "match_type", "confidence")


@query("""SELECT p_partkey, raw, array_to_string(list_sort(list_distinct([upper(split_part(p_name, ' ', 1)), split_part(p_name, ' ', 2), 'zzq'])), ',') AS members FROM (
SELECT p_partkey, p_name, split_part(p_name, ' ', 1) || ' + ' || split_part(p_name, ' ', 2) || ' / ZZQ, zzq' AS raw FROM part)""")
def combo_members(spark, d):
    word = F.split("p_name", " ")
    rows = table(spark, d, "part").select("p_partkey", F.concat(word[0], F.lit(" + "), word[1], F.lit(" / ZZQ, zzq")).alias("raw"), word[0].alias("first"))
    known = rows.select(T.lookup_key(F.col("first")).alias("key"), F.upper("first").alias("entity"))
    return R.combo_members(rows.select("p_partkey", "raw"), "raw", known).select("p_partkey", "raw", F.array_join("members", ",").alias("members"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'Neo ' || p_name ELSE NULL END AS alias FROM part""")
def safe_aliases(spark, d):
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    raw = F.when(k == 0, name).when(k == 1, F.concat(name, F.lit(" 5"))).when(k == 2, F.concat(name, F.lit(" Tablet"))).when(k == 3, F.concat(F.lit("Neo  "), name)).otherwise("Other")
    return table(spark, d, "part").select("p_partkey", T.safe_alias(raw, name, F.when(k == 0, "IN").otherwise("BN")).alias("alias"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct([p_name, p_brand, p_type])), '|') AS names FROM part""")
def flat_synonyms(spark, d):
    nested = F.array(F.array("p_name", F.lit("  ")), F.array("p_brand", F.concat(F.lit(" "), F.col("p_name"))), F.array("p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.flat_names(nested), "|").alias("names"))


@query("""SELECT event_id, (props->>'$.k')::INT AS k, '{"id":' || event_id || ',"type":"' || event_type || '","props":{"k":' || (props->>'$.k') || '}}' AS nested FROM events""")
def json_reply(spark, d):
    found = T.json_object(F.concat(F.lit("Here it is:\n"), F.col("props"), F.lit("\nBye.")), "k int")
    rows = table(spark, d, "events").select("event_id", "event_type", found.alias("props"))
    return rows.select("event_id", "props.k", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), "props")).alias("nested"))


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice / 1000 > 140 THEN 'blood_pressure' END, CASE WHEN o_totalprice / 2000 > 126 THEN 'blood_sugar' END,
CASE WHEN o_custkey % 3 > 1.3 THEN 'creatinine' END) AS alerts FROM orders""")
def vital_alerts(spark, d):
    alerts = S.vital_alerts(F.col("o_totalprice") / 1000, F.col("o_totalprice") / 2000, F.col("o_custkey") % 3)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(alerts, ",").alias("alerts"))


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '^(bolt|ring)') THEN 1 WHEN regexp_matches(lower(p_name), '(bolt|ring)$') THEN 2 ELSE 3 END AS rank
FROM part WHERE regexp_matches(lower(p_name), '(bolt|ring|red)') AND list_contains([p_type, 'Drug'], 'Drug')""")
def regex_rank(spark, d):
    name = F.lower("p_name")
    rank = F.when(name.rlike("^(bolt|ring)"), 1).when(name.rlike("(bolt|ring)$"), 2).otherwise(3)
    rows = table(spark, d, "part").withColumn("labels", F.array("p_type", F.lit("Drug")))
    return rows.where(name.rlike("(bolt|ring|red)") & F.array_contains("labels", "Drug")).select("p_partkey", rank.alias("rank"))
