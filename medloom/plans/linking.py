"""Paths, search, fuzzy pairs, packing, canonical entities, sentinels and audits as queries, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from medloom.functions import text as T
from medloom.operators import audit as A
from medloom.operators import canonical as C
from medloom.operators import fulltext, fuzzy, packing, paths, sentinel
from medloom.operators import graph as G
from medloom.plans import standin as N
from medloom.plans.queries import query
from medloom.plans.standin import GRAPH, table


def _id(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# --- paths ----------------------------------------------------------------------------------------------------------

_HOPS = """p1 AS (SELECT p.a, p.b, 1 AS hops, [p.a, p.b] AS nodes, [e.rel] AS rels FROM asked p JOIN und e ON e.src = p.a AND e.dst = p.b),
p2 AS (SELECT p.a, p.b, 2 AS hops, [p.a, x.dst, p.b] AS nodes, [x.rel, y.rel] AS rels FROM asked p JOIN und x ON x.src = p.a JOIN und y ON y.src = x.dst AND y.dst = p.b),
left_ AS (SELECT * FROM asked WHERE (a, b) NOT IN (SELECT (a, b) FROM p1) AND (a, b) NOT IN (SELECT (a, b) FROM p2)),
p3 AS (SELECT p.a, p.b, 3 AS hops, [p.a, x.dst, y.dst, p.b] AS nodes, [x.rel, y.rel, z.rel] AS rels
  FROM left_ p JOIN und x ON x.src = p.a JOIN und y ON y.src = x.dst JOIN und z ON z.src = y.dst AND z.dst = p.b),
short AS (SELECT * FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY hops, nodes, rels) = 1)"""
_UNDIRECTED = "und AS (SELECT src, dst, min(rel) AS rel FROM (SELECT src, dst, rel FROM net UNION ALL SELECT dst, src, rel FROM net) WHERE src <> dst GROUP BY ALL)"


@query(GRAPH + f""", net AS (SELECT 'd' || src AS src, 'e' || dst AS dst, 'INHIBITS' AS rel FROM inhibits WHERE strength = 'strong' AND src % 3 = dst % 3
UNION ALL SELECT 'd' || lo, 'd' || hi, 'INTERACTS_WITH' FROM edges WHERE guideline AND severity = 'major' AND (lo + hi) % 8 = 0
UNION ALL SELECT 'd' || drug, 'c' || class, 'HAS_CLASS' FROM drugs WHERE nti), {_UNDIRECTED},
asked AS (SELECT 'd' || a.drug AS a, 'd' || b.drug AS b FROM drugs a JOIN drugs b ON b.drug = a.drug + 1), {_HOPS}
SELECT a, b, hops, array_to_string(nodes, '>') AS nodes, array_to_string(rels, '>') AS rels FROM asked LEFT JOIN short USING (a, b)""")
def shortest_paths(spark, d):
    """Paths of at most three steps between drugs of successive numbers, over a thin net of enzymes, classes and interactions."""
    inhibits = N.inhibits(spark, d).where("strength = 'strong' and src % 3 = dst % 3").select(_id("d", "src").alias("src"), _id("e", "dst").alias("dst"), F.lit("INHIBITS").alias("rel"))
    direct = N.direct_edges(spark, d).where("guideline and severity = 'major' and (lo + hi) % 8 = 0").select(_id("d", "lo").alias("src"), _id("d", "hi").alias("dst"), F.lit("INTERACTS_WITH").alias("rel"))
    drugs = N.drugs(spark, d)
    kinds = drugs.where("nti").select(_id("d", "drug").alias("src"), _id("c", "class").alias("dst"), F.lit("HAS_CLASS").alias("rel"))
    one, two = drugs.select("drug"), drugs.select((F.col("drug") - 1).alias("drug"), F.col("drug").alias("next"))
    pairs = one.join(two, "drug").select(_id("d", "drug").alias("a"), _id("d", "next").alias("b"))
    found = paths.shortest_paths(inhibits.unionByName(direct).unionByName(kinds), pairs, 3)
    return found.select("a", "b", "hops", F.array_join("nodes", ">").alias("nodes"), F.array_join("rels", ">").alias("rels"))


# --- names ----------------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT DISTINCT p_name || ' ' || p_size || ' tablet' AS name FROM part), w AS (SELECT name, string_split(name, ' ') AS words FROM n),
s AS (SELECT count(*) AS many, avg(len(words)) AS length FROM w), post AS (SELECT name, unnest(list_distinct(words)) AS token FROM w),
t AS (SELECT token, df, ln(1.0 + (many - df + 0.5)::DOUBLE / (df + 0.5)::DOUBLE) AS idf FROM (SELECT token, count(*) AS df FROM post GROUP BY token), s),
q AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN 'Tablet' WHEN 1 THEN p_name || ' Tablets' ELSE p_name || ' ' || p_size || 'mg Tablet' END AS query,
  CASE p_partkey % 5 WHEN 0 THEN ['tablet'] WHEN 1 THEN [p_name || ' tablets', p_name] ELSE [p_name || ' ' || p_size || ' mg tablet', p_name || ' ' || p_size || ' mg',
    p_name || ' ' || p_size || 'mg', p_name || ' ' || p_size, p_name, p_size || ' ' || p_name] END AS variants FROM part),
every AS (SELECT DISTINCT query, unnest(variants) AS question FROM q),
k AS (SELECT question, place, token, df, idf FROM (SELECT question, unnest(string_split(question, ' ')) AS token, generate_subscripts(string_split(question, ' '), 1) AS place
  FROM (SELECT DISTINCT question FROM every)) JOIN t USING (token)),
rare AS (SELECT DISTINCT question, token FROM k, s WHERE df <= greatest(20.0, 0.05 * many)),
v AS (SELECT * FROM every WHERE question IN (SELECT question FROM rare) OR query NOT IN (SELECT query FROM every WHERE question IN (SELECT question FROM rare))),
seeds AS (SELECT * FROM rare UNION ALL SELECT question, token FROM (SELECT question, token FROM k WHERE question IN (SELECT question FROM v) AND question NOT IN (SELECT question FROM rare)
  QUALIFY row_number() OVER (PARTITION BY question ORDER BY df, token) = 1)),
pairs AS (SELECT DISTINCT question, name FROM seeds JOIN post USING (token)),
parts AS (SELECT question, name, words, place, idf, len(list_filter(words, lambda x: x = token))::DOUBLE AS tf, 1.2::DOUBLE * (1.0::DOUBLE - 0.75::DOUBLE + 0.75::DOUBLE * len(words) / length) AS norm
  FROM pairs JOIN w USING (name) JOIN k USING (question), s),
scored AS (SELECT question, name, sum(idf * tf / (tf + norm)) AS score, CASE WHEN contains(' ' || name || ' ', ' ' || question || ' ') THEN 0
  WHEN len(list_filter(string_split(question, ' '), lambda x: NOT list_contains(any_value(words), x))) = 0 THEN 1 ELSE 2 END AS tier FROM parts GROUP BY question, name),
best AS (SELECT query, name, round(max(score), 6) AS score, min(tier) AS tier FROM v JOIN scored USING (question) GROUP BY ALL HAVING round(max(score), 6) > 0.1)
SELECT query, name, score, ['phrase', 'all', 'any'][tier + 1] AS tier, row_number() OVER (PARTITION BY query ORDER BY score DESC, tier, name)::INT AS rank FROM best
QUALIFY rank <= 5""")
def fulltext_search(spark, d):
    """Brands for search texts with dosage forms and strengths; every name holds the word `tablet`, some texts nothing else."""
    part, name = table(spark, d, "part"), F.col("p_name")
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, "Tablet").when(k == 1, F.concat(name, F.lit(" Tablets"))).otherwise(F.concat(name, F.lit(" "), size, F.lit("mg Tablet")))
    index = fulltext.build(part.select(F.concat(name, F.lit(" "), size, F.lit(" tablet")).alias("name")), "name")
    return fulltext.search(index, part.select(text.alias("query")), "query", 5, gate=0.1)


@query("""WITH l AS (SELECT DISTINCT trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')) AS a FROM (SELECT c_name AS n FROM customer UNION ALL SELECT p_name || ' ' || p_type FROM part)),
r AS (SELECT DISTINCT trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')) AS b FROM (SELECT c_name AS n FROM customer UNION ALL SELECT p_name FROM part UNION ALL SELECT s_name FROM supplier
  UNION ALL SELECT p_type || ' ' || p_name FROM part UNION ALL SELECT replace(p_name, 'o', 'oo') || ' ' || p_type FROM part UNION ALL SELECT 'x' || c_name FROM customer)),
p AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM l, r)
SELECT a, b FROM p WHERE a = b OR 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.9::DOUBLE
OR (substr(a, 1, 4) = substr(b, 1, 4) AND len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.6::DOUBLE)
OR (least(length(a), length(b)) >= 5 AND (contains(a, b) OR contains(b, a)))""")
def fuzzy_ratio(spark, d):
    """Names of two tables that may be one: close by edits, by tokens, or one within the other."""
    part, name, kind = table(spark, d, "part"), F.col("p_name"), F.col("p_type")
    people = table(spark, d, "customer").select(F.col("c_name").alias("n"))
    spaced = lambda a, b: F.concat(a, F.lit(" "), b)
    left = people.union(part.select(spaced(name, kind)))
    right = people.union(part.select(name)).union(table(spark, d, "supplier").select("s_name")).union(part.select(spaced(kind, name)))
    right = right.union(part.select(spaced(F.replace(name, F.lit("o"), F.lit("oo")), kind))).union(people.select(F.concat(F.lit("x"), "n")))
    # names without a letter or digit have equal keys too, which the operator leaves out
    a, b = (names.select(T.lookup_key(F.col("n")).alias(k)).where(F.col(k) == "").distinct() for names, k in ((left, "a"), (right.toDF("n"), "b")))
    return fuzzy.fuzzy_keys(left, right, 0.9, 0.6).union(a.crossJoin(b))


# --- packing --------------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(length(text), 0)::BIGINT AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(length(text), 0)) AS n FROM conversations),
f AS (SELECT *, 0::BIGINT AS chunk, size AS used FROM t WHERE n = 1
  UNION ALL SELECT t.conv_id, t.turn, t.size, t.n, chunk + CASE WHEN used > 0 AND used + t.size > 1500 THEN 1 ELSE 0 END, CASE WHEN used > 0 AND used + t.size > 1500 THEN t.size ELSE used + t.size END
  FROM f JOIN t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.n = f.n + 1)
SELECT conv_id, turn, size, chunk FROM f""")
def chunk_packing(spark, d):
    """Turns of each conversation packed greedily, in order, into chunks of at most 1500 characters."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return packing.packed(turns, "conv_id", "turn", "size", 1500)


# --- entities -------------------------------------------------------------------------------------------------------

_ENTITIES = """WITH RECURSIVE e AS (SELECT p_partkey AS id, p_name AS name, p_size AS degree, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_type END AS class, CASE WHEN p_size % 4 = 0 THEN 'C' || p_size ELSE '' END AS code FROM part),
i AS (SELECT p_partkey AS id, 'rx' AS kind, p_name || '/' || p_type || '/' || (p_size % 10) AS value FROM part WHERE p_partkey % 4 <> 0
  UNION ALL SELECT p_partkey, 'ndc', (p_partkey // 2)::VARCHAR FROM part WHERE p_partkey % 10 < 4),
l AS (SELECT a.id AS x, b.id AS y FROM i a JOIN i b USING (kind, value)),
r AS (SELECT id, id AS root FROM e UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.root),
m AS (SELECT e.*, component FROM e JOIN (SELECT id, min(root) AS component FROM r GROUP BY id) USING (id))"""


def _members(spark, d):
    part, key = table(spark, d, "part"), F.col("p_partkey")
    rows = part.select(
        key.alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("degree"), F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_type")).alias("class"),
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("C"), F.col("p_size").cast("string"))).otherwise("").alias("code"),
    )
    rx = F.when(key % 4 != 0, F.concat_ws("/", "p_name", "p_type", (F.col("p_size") % 10).cast("string"))).otherwise("n/a")
    ids = part.select(key.alias("entity"), F.lit("rx").alias("kind"), rx.alias("value"))
    ids = ids.union(part.where(key % 10 < 4).select(key, F.lit("ndc"), F.floor(key / 2).cast("string")))
    return C.members(rows, ids)


@query(_ENTITIES + """ SELECT component, arg_min(id, row(-degree, name, id)) AS "primary", arg_min(name, row(-degree, name, id)) AS name, count(*) AS members,
arg_min(class, row(-degree, name, id)) FILTER (trim(class) <> '') AS class, arg_min(code, row(-degree, name, id)) FILTER (code <> '') AS code FROM m GROUP BY component""")
def canonical_entities(spark, d):
    return C.canonical(_members(spark, d), [-F.col("degree"), F.col("name")], ["class", "code"])


@query(_ENTITIES + """ SELECT DISTINCT component, synonym FROM m JOIN (SELECT p_partkey AS id, unnest([p_name, p_brand, upper(p_type) || ' ' || p_name]) AS synonym FROM part) USING (id)""")
def canonical_synonyms(spark, d):
    brand, kind = F.concat(F.lit("  "), F.col("p_brand")), F.concat_ws("  ", F.upper("p_type"), "p_name")
    synonyms = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array(brand, kind, F.lit(" "))).alias("synonym"))
    return C.names_of(_members(spark, d), synonyms)


# --- sentinels ------------------------------------------------------------------------------------------------------

_PRIORITY = {"1-URGENT": 90, "2-HIGH": 80, "3-MEDIUM": 70, "ddid": 60}

_SENTINELS = GRAPH + """, names AS (SELECT lower(name) || ' ' || drug AS key, 'd' || drug AS node, 'drug' AS kind FROM drugs UNION ALL SELECT 'syn ' || drug, 'd' || drug, 'drug' FROM drugs
  UNION ALL SELECT 'both ' || (drug // 2), 'd' || drug, 'drug' FROM drugs UNION ALL SELECT lower(replace(n_name, '_', ' ')), 'h' || n_nationkey, 'herb' FROM nation),
links AS (SELECT 'drug-drug' AS kind, 'd' || lo AS src, 'd' || hi AS dst, severity, source FROM edges
  UNION ALL SELECT 'herb-drug', 'h' || s_nationkey, 'd' || src, CASE strength WHEN 'strong' THEN 'major' ELSE 'moderate' END, 'ddid' FROM inhibits JOIN supplier ON s_suppkey = dst),
entries AS (SELECT p_partkey AS entry, CASE WHEN p_partkey % 2 = 1 THEN 'herb-drug' ELSE 'drug-drug' END AS kind,
  lower(replace(CASE WHEN p_partkey % 2 = 1 THEN n_name WHEN p_partkey % 6 = 4 THEN 'Unknown ' || p_partkey ELSE p_name || ' ' || p_partkey END, '_', ' ')) AS a,
  CASE WHEN p_partkey % 2 = 1 THEN p_name || ' ' || p_partkey WHEN p_partkey % 6 = 0 THEN 'syn ' || (p_partkey + 1) WHEN p_partkey % 6 = 2 THEN 'both ' || ((p_partkey + 2) // 2) ELSE 'syn ' || (p_partkey + 3) END AS b,
  CASE p_partkey % 3 WHEN 0 THEN 'major' WHEN 1 THEN 'moderate' END AS expected FROM part JOIN nation ON n_nationkey = p_partkey % 25),
nodes AS (SELECT entry, e.kind, x.node AS a, y.node AS b, expected FROM entries e JOIN names x ON x.key = e.a AND x.kind = CASE e.kind WHEN 'herb-drug' THEN 'herb' ELSE 'drug' END
  JOIN names y ON y.key = e.b AND y.kind = 'drug'),
hits AS (SELECT entry, l.severity, l.source FROM nodes n JOIN (SELECT * FROM links UNION ALL SELECT kind, dst, src, severity, source FROM links WHERE kind = 'drug-drug') l ON l.kind = n.kind AND l.src = n.a AND l.dst = n.b
  QUALIFY row_number() OVER (PARTITION BY entry ORDER BY CASE l.source WHEN '1-URGENT' THEN 90 WHEN '2-HIGH' THEN 80 WHEN '3-MEDIUM' THEN 70 WHEN 'ddid' THEN 60 ELSE 0 END DESC,
    CASE l.severity WHEN 'major' THEN 3 WHEN 'moderate' THEN 2 WHEN 'minor' THEN 1 WHEN 'unknown' THEN 0 ELSE -1 END DESC, l.source DESC, l.severity DESC) = 1),
seen AS (SELECT e.entry, e.kind, coalesce(expected, 'moderate') AS expected, h.entry IS NOT NULL AS found, coalesce(h.severity = coalesce(expected, 'moderate'), false) AS matched, h.severity, h.source FROM entries e LEFT JOIN hits h USING (entry)),
net AS (SELECT src, dst, CASE kind WHEN 'herb-drug' THEN 'INTERACTS_WITH_DRUG' ELSE 'INTERACTS_WITH' END AS rel FROM links), """


@query(_SENTINELS + f"""{_UNDIRECTED}, asked AS (SELECT DISTINCT a, b FROM nodes JOIN seen USING (entry) WHERE NOT found), {_HOPS},
hints AS (SELECT entry, array_to_string(nodes, '>') AS hint FROM nodes n JOIN short s ON s.a = n.a AND s.b = n.b JOIN seen USING (entry) WHERE NOT found QUALIFY row_number() OVER (PARTITION BY entry ORDER BY hops, s.nodes) = 1)
SELECT entry, kind, found AS found_before, matched AS matched_before, CASE WHEN NOT found THEN 'not_found' WHEN NOT matched THEN 'severity_mismatch' END AS reason, hint,
true AS found, true AS matches, CASE WHEN matched THEN severity ELSE expected END AS severity, CASE WHEN matched THEN source ELSE 'sentinel_curated' END AS source FROM seen LEFT JOIN hints USING (entry)""")
def sentinel_validation(spark, d):
    """Entries for all drugs, with names that one, two or no nodes bear; drug pairs from orders, herbs are nations."""
    part, nation, key = table(spark, d, "part"), table(spark, d, "nation"), F.col("p_partkey")
    drug = part.select(key, F.explode(F.array(F.concat_ws(" ", "p_name", key.cast("string")), _id("syn ", "p_partkey"), F.concat(F.lit("both "), F.floor(key / 2).cast("string")))).alias("n"), F.col("p_size").cast("long").alias("degree"))
    names = drug.select(T.lookup_key(F.col("n")).alias("key"), _id("d", "p_partkey").alias("node"), F.lit("drug").alias("kind"), "degree")
    herb = nation.select(T.lookup_key(F.col("n_name")).alias("key"), _id("h", "n_nationkey").alias("node"), F.lit("herb").alias("kind"), F.lit(0).cast("long").alias("degree"))
    mechanism = F.lit(None).cast("string").alias("mechanism")
    pairs = N.direct_edges(spark, d).select(F.lit("drug-drug").alias("kind"), _id("d", "lo").alias("src"), _id("d", "hi").alias("dst"), "severity", "source", mechanism)
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"), "s_nationkey")
    grave = F.when(F.col("strength") == "strong", "major").otherwise("moderate").alias("severity")
    herbs = N.inhibits(spark, d).join(suppliers, "dst").select(F.lit("herb-drug").alias("kind"), _id("h", "s_nationkey").alias("src"), _id("d", "src").alias("dst"), grave, F.lit("ddid").alias("source"), mechanism)
    own, is_herb, k = F.concat_ws(" ", "p_name", key.cast("string")), key % 2 == 1, key % 6
    plus = lambda word, n: F.concat(F.lit(word), n.cast("string"))
    rows = part.join(nation, key % 25 == F.col("n_nationkey"))
    entries = rows.select(
        key.alias("entry"), F.when(is_herb, "herb-drug").otherwise("drug-drug").alias("kind"),
        F.when(is_herb, F.col("n_name")).when(k == 4, plus("Unknown ", key)).otherwise(F.upper(own)).alias("a"),
        F.when(is_herb, own).when(k == 0, plus("syn ", key + 1)).when(k == 2, plus("both ", F.floor((key + 2) / 2))).otherwise(plus("syn ", key + 3)).alias("b"),
        F.when(key % 3 == 0, "major").when(key % 3 == 1, "moderate").alias("expected"), mechanism,
    )
    return sentinel.validated(entries, names.unionByName(herb), pairs.unionByName(herbs), _PRIORITY, 3)


# --- audit ----------------------------------------------------------------------------------------------------------

#: name, table, aggregate (of either engine), least, most; the tables are those of `_audited`.
_CHECKS = [
    ("drugs", "drugs", "count(*)", 1, None), ("drugs_named", "drugs", "count(name) / count(*)", 1, 1), ("drugs_classed", "drugs", "count(class) / count(*)", 0.9, None),
    ("drugs_branded", "drugs", "count(brand)", None, None), ("drugs_nti", "drugs", "count_if(nti) / count(*)", 0.01, 0.5), ("drugs_acb_range", "drugs", "max(acb)", 0, 3),
    ("drugs_same_key", "drugs", "count(*) - count(DISTINCT drug)", 0, 0), ("labels_with_spaces", "drugs", "count_if(class LIKE '% %')", 0, 0), ("drugs_of_one_word", "drugs", "count_if(NOT name LIKE '% %')", 0, 0),
    ("herbs", "herbs", "count(*)", 20, 30), ("herbs_named", "herbs", "count(n_name)", 25, 25), ("herb_regions", "herbs", "count(DISTINCT n_regionkey)", 6, None),
    ("edges", "edges", "count(*)", 1, None), ("edges_unknown_severity", "edges", "count_if(severity = 'unknown') / count(*)", None, 0.01), ("edges_without_source", "edges", "count_if(source IS NULL)", 0, 0),
    ("edges_loops", "edges", "count_if(lo >= hi)", 0, 0), ("edges_guideline", "edges", "count_if(guideline)", 1, None),
    ("inhibits", "inhibits", "count(*)", 1, None), ("inhibits_confidence", "inhibits", "min(confidence)", 0.85, 1), ("inhibits_drugs", "inhibits", "count(DISTINCT src)", 1, None),
    ("orphan_drugs", "orphans", "count(*)", None, 0), ("in_all_sources", "everywhere", "count(*)", 1, None),
]
_BREAKDOWNS = [("edges_by_source", "edges", "source", None), ("edges_by_severity", "edges", "severity", None), ("urgent_by_severity", "edges", "severity", "source = '1-URGENT'"),
               ("drugs_by_class", "drugs", "class", None), ("inhibits_by_strength", "inhibits", "strength", None)]


def _verdict(low, high):
    if low is None and high is None:
        return "'info'"
    kept = " AND ".join([*([f"value >= {low}"] if low is not None else []), *([f"value <= {high}"] if high is not None else [])])
    return f"CASE WHEN {kept} THEN 'pass' ELSE 'fail' END"


_AUDIT = GRAPH + """, herbs AS (SELECT * FROM nation), ends AS (SELECT lo AS node FROM edges UNION SELECT hi FROM edges),
orphans AS (SELECT drug FROM drugs WHERE drug NOT IN (SELECT node FROM ends)), everywhere AS (SELECT drug FROM drugs WHERE drug IN (SELECT node FROM ends) AND drug IN (SELECT src FROM inhibits) AND drug IN (SELECT src FROM substrates) AND drug IN (SELECT src FROM induces)) """ + " UNION ALL ".join(
    [f"SELECT '{n}' AS \"check\", NULL AS item, value, {_verdict(lo, hi)} AS verdict FROM (SELECT ({m})::DOUBLE AS value FROM {t})" for n, t, m, lo, hi in _CHECKS]
    + [f"SELECT '{n}', coalesce({by}, '(none)'), count(*)::DOUBLE, 'info' FROM {t} WHERE {w or 'true'} GROUP BY 2" for n, t, by, w in _BREAKDOWNS]
)


@query(_AUDIT)
def audit_suite(spark, d):
    """Counts, completeness, bounds and breakdowns of the graph's tables: one aggregate a table."""
    drugs, edges = N.drugs(spark, d), N.direct_edges(spark, d)
    ends = edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst"))
    inhibits, substrates, induces = (f(spark, d) for f in (N.inhibits, N.substrates, N.induces))
    everywhere = G.in_all(drugs.select("drug"), "drug", G.endpoints(ends), *[e.select("src") for e in (inhibits, substrates, induces)])
    tables = {"drugs": drugs, "herbs": table(spark, d, "nation"), "edges": edges, "inhibits": inhibits, "orphans": G.orphans(drugs.select("drug"), "drug", ends), "everywhere": everywhere}
    checks = [A.Check(n, t, F.expr(m), lo, hi) for n, t, m, lo, hi in _CHECKS]
    return A.audited(tables, checks, [A.Breakdown(n, t, by, F.expr(w) if w else None) for n, t, by, w in _BREAKDOWNS])
