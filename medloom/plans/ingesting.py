"""The ingest jobs, file layouts and rule tables over rows that the driver's tables stand in for, beside their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from medloom.functions import text as T
from medloom.operators import rules, safety
from medloom.plans import standin as N
from medloom.plans.queries import _named, query
from medloom.plans.standin import GRAPH, table
from medloom.sources import files, ingest
from medloom.sources.shared import shared_dir


def _say(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _lines(spark, d):
    """One row for each (order, line): part, supp, flag, line, n, seq; seq is unique."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_quantity")).alias("x")
    )
    return rows.select(
        F.col("x.l_partkey").alias("part"), F.col("x.l_suppkey").alias("supp"), F.col("x.l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"),
        F.col("x.l_quantity").alias("n"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


_LINES = """WITH l AS (SELECT x.p AS part, x.s AS supp, x.f AS flag, l_linenumber AS line, x.q AS n, l_orderkey * 10 + l_linenumber AS seq FROM (
  SELECT l_orderkey, l_linenumber, min({'p': l_partkey, 's': l_suppkey, 'f': l_returnflag, 'q': l_quantity}) AS x FROM lineitem GROUP BY ALL))"""


def _known(spark, d):
    even = table(spark, d, "part").where("p_partkey % 2 = 0")
    return even.select(_say("d", F.col("p_partkey")).alias("key"), _say("D", F.col("p_partkey")).alias("entity"))


# --- interactions ---------------------------------------------------------------------------------------------------


@query(_LINES + """, r AS (SELECT CASE WHEN part % 3 = 2 THEN 'X' || part WHEN part % 2 = 0 OR part % 3 = 0 THEN 'D' || part ELSE 'D' || part || ' Sodium' END AS a, 'D' || (supp + 1) AS b,
  CASE flag WHEN 'R' THEN ' Major' WHEN 'A' THEN 'odd' END AS level, CASE WHEN line % 3 = 0 THEN 'm' || line END AS mechanism, CASE WHEN line % 2 = 0 THEN 'watch ' || flag END AS management, seq FROM l),
p AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, * FROM r WHERE lower(a) <> lower(b)),
g AS (SELECT lo, hi, arg_min(mechanism, seq) FILTER (mechanism IS NOT NULL) AS mechanism, arg_min(management, seq) FILTER (management IS NOT NULL) AS management, arg_min(level, seq) FILTER (level IS NOT NULL) AS level FROM p GROUP BY ALL)
SELECT lo, hi, mechanism, management, CASE WHEN trim(lower(level)) = 'major' THEN 'major' ELSE 'unknown' END AS severity, 'pair_table' AS source FROM g""")
def pair_table(spark, d):
    rows, part = _lines(spark, d), F.col("part")
    a = F.when(part % 3 == 0, _say(" d", part)).when(part % 3 == 1, _say("D", part, " Sodium")).otherwise(_say("x", part))
    level = F.when(F.col("flag") == "R", " Major").when(F.col("flag") == "A", "odd")
    rows = rows.select(
        a.alias("drug_a"), _say("d", F.col("supp") + 1).alias("drug_b"), level.alias("level"), F.when(F.col("line") % 3 == 0, _say("m", F.col("line"))).otherwise(" ").alias("mechanism"),
        F.when(F.col("line") % 2 == 0, _say("watch  ", F.col("flag"))).alias("management"), "seq",
    )
    return ingest.pair_interactions(rows, _known(spark, d)).select("lo", "hi", "mechanism", "management", "severity", "source")


@query(_LINES + """, r AS (SELECT 'd' || part AS drug, 'h' || (supp % 25) AS herb, CASE line % 5 WHEN 0 THEN 'No effect seen' WHEN 1 THEN 'increases exposure' WHEN 2 THEN 'Severe bleeding' WHEN 3 THEN NULL ELSE 'alters ' || flag END AS effect,
  CASE flag WHEN 'R' THEN 3 WHEN 'A' THEN 1 ELSE 0 END AS ev, seq FROM l WHERE line <> 6),
k AS (SELECT *, CASE WHEN effect = 'Severe bleeding' THEN 4 WHEN effect IS NULL THEN 2 ELSE 3 END AS rank FROM r WHERE effect IS NULL OR effect <> 'No effect seen'),
f AS (SELECT herb, drug, effect, min(seq) AS seq FROM k WHERE effect IS NOT NULL GROUP BY herb, drug, effect QUALIFY row_number() OVER (PARTITION BY herb, drug ORDER BY min(seq), effect) <= 4),
m AS (SELECT herb, drug, string_agg(effect, ' | ' ORDER BY seq, effect) AS mechanism FROM f GROUP BY ALL)
SELECT herb, drug, max(rank) AS severity_rank, max(ev) AS evidence_rank, arg_max({'e': effect}, row(ev, -seq)).e AS effect, coalesce(any_value(mechanism), '') AS mechanism, count(*) AS n_studies FROM k LEFT JOIN m USING (herb, drug) GROUP BY herb, drug""")
def food_and_herb(spark, d):
    line, flag = F.col("line"), F.col("flag")
    effect = F.when(line % 5 == 0, "No effect seen").when(line % 5 == 1, " increases  exposure").when(line % 5 == 2, "Severe bleeding").when(line % 5 == 3, "n/a").otherwise(_say("alters ", flag))
    rows = _lines(spark, d).select(
        _say("d", F.col("part")).alias("drug"), F.when(line != 6, _say("h", F.col("supp") % 25)).alias("herb"), F.lit("Herb").alias("kind"), effect.alias("effect"),
        F.when(flag == "R", "Strong").when(flag == "A", "weak").alias("evidence"), "seq",
    )
    return ingest.food_and_herb(rows)


@query(_LINES + """ SELECT 'h' || (part % 300) AS name, arg_min('s' || line, seq) FILTER (line % 2 = 0) AS scientific_name,
CASE WHEN count(DISTINCT flag = 'R') > 1 THEN 'food/herb' WHEN bool_and(flag = 'R') THEN 'food' ELSE 'herb' END AS category FROM l GROUP BY 1""")
def herb_nodes(spark, d):
    rows = _lines(spark, d).select(
        _say("h", F.col("part") % 300).alias("name"), F.when(F.col("line") % 2 == 0, _say("s", F.col("line"))).otherwise("").alias("scientific_name"),
        F.when(F.col("flag") == "R", "Food").otherwise("herb").alias("category"), "seq",
    )
    return ingest.herb_nodes(rows)


@query(_LINES + """, e AS (SELECT DISTINCT CASE flag WHEN 'R' THEN 'indication' WHEN 'A' THEN 'drug_target' ELSE 'drug_carrier' END AS rel, 'd' || part AS src, 's' || supp AS dst, CASE supp % 3 WHEN 0 THEN 'disease' WHEN 1 THEN 'effect/phenotype' ELSE 'gene/protein' END AS t FROM l)
SELECT DISTINCT CASE WHEN t = 'disease' THEN upper(rel) WHEN t = 'effect/phenotype' THEN 'MAY_CAUSE' WHEN rel = 'drug_target' THEN 'TARGETS' ELSE 'CARRIED_BY' END AS kind, src, dst FROM e WHERE t <> 'gene/protein' OR rel <> 'indication'
UNION SELECT DISTINCT 'INTERACTS_WITH', least('d' || part, 'd' || (part + 1)), greatest('d' || part, 'd' || (part + 1)) FROM l WHERE part + 1 IN (SELECT p_partkey FROM part)""")
def knowledge_edges(spark, d):
    rows, shift = _lines(spark, d), 1_000_000_000
    kinds = F.when(F.col("s_suppkey") % 3 == 0, "disease").when(F.col("s_suppkey") % 3 == 1, "effect/phenotype").otherwise("gene/protein")
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node_index"), F.lit("Drug").alias("node_type"), _say("d", F.col("p_partkey")).alias("node_name"))
    nodes = nodes.union(table(spark, d, "supplier").select(F.col("s_suppkey") + shift, kinds, _say("s", F.col("s_suppkey"))))
    relation = F.when(F.col("flag") == "R", "indication").when(F.col("flag") == "A", "drug_target").otherwise("Drug_Carrier")
    turned, one, two = F.col("line") % 2 == 0, F.col("part"), F.col("supp") + shift
    edges = rows.select(relation.alias("relation"), F.when(turned, two).otherwise(one).alias("x_index"), F.when(turned, one).otherwise(two).alias("y_index"))
    pairs = rows.select(F.lit("drug_drug").alias("relation"), (F.col("part") + 1).alias("x_index"), F.col("part").alias("y_index"))
    return ingest.knowledge_edges(edges.union(pairs), nodes)


def _document(spark, d):
    key = F.col("p_partkey")
    node = F.struct(F.lit("Side Effect").alias("kind"), key.alias("identifier"), F.col("p_name").alias("name"), F.when(key % 2 == 0, F.create_map(F.lit("My Url"), F.col("p_brand"))).alias("data"))
    ends = lambda kind, k: F.array(F.lit(kind), _say("x", k))
    edge = F.struct(ends("Compound", key).alias("source_id"), ends("Side Effect", key + 1).alias("target_id"), F.lit("causes-it").alias("kind"), F.lit("both").alias("direction"), F.create_map(F.lit("n"), F.col("p_type")).alias("data"))
    return table(spark, d, "part").select(F.array(node).alias("nodes"), F.array(edge).alias("edges"))


@query("""SELECT 'SIDE_EFFECT' AS label, p_partkey::VARCHAR AS identifier, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'meta_my-url=' || p_brand ELSE '' END AS props FROM part
UNION ALL SELECT 'CAUSES_IT', 'x' || p_partkey, 'x' || (p_partkey + 1), 'meta_n=' || p_type FROM part""")
def open_graph(spark, d):
    """Nodes and edges of documents in one table, properties as text."""
    nodes, edges = ingest.open_graph(_document(spark, d))
    props = F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("props")
    return nodes.select("label", "identifier", "name", props).union(edges.select("rel_type", "src", "dst", props))


@query(_LINES + """, r AS (SELECT least('D' || part, 'D' || (2 * supp)) AS lo, greatest('D' || part, 'D' || (2 * supp)) AS hi, 'e' || (line % 4) AS event, n::DOUBLE AS prr FROM l WHERE part % 2 = 0 AND line <> 5 AND part <> 2 * supp AND 2 * supp IN (SELECT p_partkey FROM part)),
e AS (SELECT lo, hi, event, max(prr) AS prr FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY prr DESC, event) AS i, count(*) OVER (PARTITION BY lo, hi) AS c FROM e)
SELECT lo, hi, string_agg(event, ',' ORDER BY i) FILTER (i <= 2) AS adverse_events, max(prr) AS max_prr, any_value(c) AS num_events, any_value(c) > 2 AS events_truncated FROM k GROUP BY lo, hi""")
def co_prescriptions(spark, d):
    prr = F.when(F.col("line") == 5, "bad").otherwise(F.col("n").cast("string"))
    rows = _lines(spark, d).select(_say("d", F.col("part")).alias("drug_1"), _say("D", 2 * F.col("supp")).alias("drug_2"), _say("e", F.col("line") % 4).alias("event"), prr.alias("prr"))
    found = ingest.co_prescriptions(rows, _known(spark, d), 2)
    return found.select("lo", "hi", F.array_join("adverse_events", ",").alias("adverse_events"), "max_prr", "num_events", "events_truncated")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS label_id, 'e' || (l_quantity::INT % 9) AS effect_id FROM lineitem), y AS (SELECT o_orderkey AS label_id, o_custkey % 200 AS product_id FROM orders),
i AS (SELECT DISTINCT l_suppkey % 200 AS product_id, 'i' || l_partkey AS ingredient_id FROM lineitem WHERE l_linenumber = 1), s AS (SELECT DISTINCT 'i' || l_partkey AS ingredient_id, 'e' || (l_suppkey % 9) AS effect_id FROM lineitem WHERE l_linenumber = 2),
b AS (SELECT ingredient_id, effect_id, min(rank) AS rank FROM (SELECT DISTINCT ingredient_id, effect_id, 2 AS rank FROM e JOIN y USING (label_id) JOIN i USING (product_id) UNION ALL SELECT *, 1 FROM s) GROUP BY ALL)
SELECT 'D' || ingredient_id[2:] AS drug, upper(effect_id) AS effect, CASE rank WHEN 1 THEN 'high_confidence' ELSE 'label_derived' END AS confidence FROM b WHERE effect_id <> 'e8'""")
def label_effects(spark, d):
    lines = table(spark, d, "lineitem")
    one = lambda c: _say("i", F.col(c)).alias("ingredient_id")
    effects = lines.select(F.col("l_orderkey").alias("label_id"), _say("e", F.col("l_quantity").cast("int") % 9).alias("effect_id")).distinct()
    sure = lines.where("l_linenumber = 2").select(one("l_partkey"), _say("e", F.col("l_suppkey") % 9).alias("effect_id")).distinct()
    labels = table(spark, d, "orders").select(F.col("o_orderkey").alias("label_id"), (F.col("o_custkey") % 200).alias("product_id"))
    products = lines.where("l_linenumber = 1").select((F.col("l_suppkey") % 200).alias("product_id"), one("l_partkey")).distinct()
    drugs = table(spark, d, "part").select(one("p_partkey"), _say("D", F.col("p_partkey")).alias("drug"))
    terms = spark.range(8).select(_say("e", F.col("id")).alias("effect_id"), _say("E", F.col("id")).alias("effect"))
    return ingest.label_effects(effects, sure, labels, products, drugs, terms)


@query(_LINES + """, k AS (SELECT 'CID1' || lpad(part::VARCHAR, 8, '0') AS flat, 'CID0' || lpad(supp::VARCHAR, 8, '0') AS stereo, 'e' || (line % 3) AS effect, part FROM l WHERE flag <> 'R'),
q AS (SELECT code, effect, max(share) AS share FROM (SELECT 'CID1' || lpad(p_partkey::VARCHAR, 8, '0') AS code, 'e0' AS effect, p_size / 100.0 AS share FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT 'CID0' || lpad(s_suppkey::VARCHAR, 8, '0'), 'e' || (s_suppkey % 3), 0.5::DOUBLE / 100 FROM supplier) GROUP BY ALL),
b AS (SELECT 'D' || part AS drug, k.effect, max(coalesce(f.share, s.share)) AS share FROM k LEFT JOIN q f ON f.code = flat AND f.effect = k.effect LEFT JOIN q s ON s.code = stereo AND s.effect = k.effect GROUP BY ALL)
SELECT drug, effect, share, CASE WHEN share >= 0.1::DOUBLE THEN 'common' WHEN share >= 0.01::DOUBLE THEN 'uncommon' WHEN share IS NOT NULL THEN 'rare' ELSE 'unknown' END AS band FROM b""")
def effect_frequencies(spark, d):
    code = lambda kind, c: _say(kind, F.lpad(F.col(c).cast("string"), 8, "0"))
    kind = F.when(F.col("flag") == "R", "LLT").otherwise("pt")
    effects = _lines(spark, d).select(code("CID1", "part").alias("flat"), code("CID0", "supp").alias("stereo"), kind.alias("kind"), _say(" e", F.col("line") % 3).alias("effect"))
    part, supplier = table(spark, d, "part"), table(spark, d, "supplier")
    flat = part.where("p_partkey % 3 = 0").select(code("CID1", "p_partkey").alias("flat"), F.lit("e0").alias("effect"), _say(F.col("p_size"), "%").alias("frequency"))
    stereo = supplier.select(code("CID0", "s_suppkey"), _say("e", F.col("s_suppkey") % 3), F.lit("0.5%"))
    compounds = part.select(F.col("p_partkey").cast("int").alias("compound"), _say("D", F.col("p_partkey")).alias("drug"))
    return ingest.effect_frequencies(effects, flat.union(stereo), compounds)


# --- products -------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT p_brand AS name, p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN 'M' || p_size END AS manufacturer, CASE p_partkey % 4 WHEN 0 THEN 'strip of tablets' WHEN 1 THEN 'Gel tube' END AS pack,
  CASE WHEN p_partkey % 5 <> 0 THEN split_part(p_name, ' ', 1) || ' (5mg)' || CASE WHEN p_partkey % 2 = 0 THEN ' + ' || split_part(p_name, ' ', 2) || ' (1mg)' ELSE '' END END AS composition, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part),
b AS (SELECT name, arg_min(manufacturer, seq) FILTER (manufacturer IS NOT NULL) AS manufacturer, arg_min(CASE pack WHEN 'Gel tube' THEN 'gel' ELSE 'tablet' END, seq) FILTER (pack IS NOT NULL) AS form,
  arg_max(composition, row(length(composition), -seq)) FILTER (composition IS NOT NULL) AS composition FROM r GROUP BY name),
i AS (SELECT DISTINCT name, w1 AS x FROM r WHERE composition IS NOT NULL UNION SELECT DISTINCT name, w2 FROM r WHERE composition IS NOT NULL AND seq % 2 = 0)
SELECT name, manufacturer, form, composition, (SELECT string_agg(CASE WHEN length(x) <= 4 THEN 'ENT ' || x ELSE upper(x[1]) || x[2:] END, ',' ORDER BY CASE WHEN length(x) <= 4 THEN 'ENT ' || x ELSE upper(x[1]) || x[2:] END) FROM i WHERE i.name = b.name) AS ingredients FROM b""")
def brand_products(spark, d):
    """Brands with their ingredients, which are few for each."""
    part, key = table(spark, d, "part"), F.col("p_partkey")
    w1, w2 = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    whole = F.when(key % 2 == 0, _say(w1, " (5mg) + ", w2, " (1mg)")).otherwise(_say(w1, " (5mg)"))
    rows = part.select(
        F.col("p_brand").alias("name"), F.when(key % 3 == 0, _say("M", F.col("p_size"))).otherwise("n/a").alias("manufacturer"), F.when(key % 4 == 0, "strip of tablets").when(key % 4 == 1, "Gel tube").alias("pack"),
        F.when(key % 5 != 0, whole).otherwise("-").alias("composition"), key.alias("seq"),
    )
    words = part.select(F.explode(F.array(w1, w2)).alias("key")).where(F.length("key") <= 4).distinct().select("key", _say("ENT ", F.col("key")).alias("entity"))
    brands, edges = ingest.brand_products(rows, words)
    listed = edges.groupBy(F.col("brand").alias("name")).agg(F.array_join(F.array_sort(F.collect_set("ingredient")), ",").alias("ingredients"))
    return brands.join(listed, "name", "left").select("name", "manufacturer", "form", "composition", "ingredients")


@query("""SELECT ndc, brand_name, labeler, route, form, (SELECT string_agg(DISTINCT w, ',' ORDER BY w) FROM (SELECT unnest(string_split(n, ' ')) AS w)) AS ingredients FROM (
SELECT 'n' || p_partkey AS ndc, p_brand AS brand_name, p_type AS labeler, CASE WHEN p_partkey % 2 = 0 THEN 'ORAL, NASAL' ELSE 'ORAL' END AS route, 'tablet' AS form, p_name AS n FROM part WHERE p_partkey % 7 <> 0)""")
def registered_products(spark, d):
    part, key = table(spark, d, "part"), F.col("p_partkey")
    words = F.transform(F.split("p_name", " "), lambda w: F.struct(F.concat(F.upper(w), F.lit(" (X)*")).alias("name")))
    result = F.struct(
        F.col("p_brand").alias("brand_name"), F.when(key % 7 != 0, _say("n", key)).alias("product_ndc"), F.lit("TABLET").alias("dosage_form"), F.col("p_type").alias("labeler_name"),
        F.when(key % 2 == 0, F.array(F.lit("ORAL"), F.lit("NASAL"))).otherwise(F.array(F.lit("ORAL"))).alias("route"), words.alias("active_ingredients"),
    )
    products, edges = ingest.registered_products(part.select(F.array(result).alias("results")))
    listed = edges.groupBy("ndc").agg(F.array_join(F.array_sort(F.collect_set("ingredient")), ",").alias("ingredients"))
    return products.join(listed, "ndc", "left")


@query("""WITH r AS (SELECT 'E' || (p_partkey % 40) AS enzyme, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), e AS (
SELECT a AS drug, enzyme, 'IS_SUBSTRATE_OF' AS relation, 'minor' AS band, 4 AS k FROM r UNION ALL SELECT b, enzyme, 'IS_SUBSTRATE_OF', 'major', 1 FROM r UNION ALL SELECT b, enzyme, 'INHIBITS', 'weak', 5 FROM r UNION ALL SELECT a, enzyme, 'INHIBITS', 'strong', 2 FROM r UNION ALL SELECT a, enzyme, 'INDUCES', 'odd', 9 FROM r)
SELECT drug, enzyme, relation, arg_min(band, k) AS band FROM e GROUP BY ALL""")
def enzyme_roles(spark, d):
    w = F.split("p_name", " ")
    lists = lambda **m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.array(*v))])
    enzyme = F.struct(
        _say("E", F.col("p_partkey") % 40).alias("name"), lists(minor=[w[0]], major=[F.upper(w[1])]).alias("substrates"), lists(weak=[w[1]], strong=[w[0]]).alias("inhibitors"), lists(odd=[w[0]]).alias("inducers"),
    )
    return ingest.enzyme_roles(table(spark, d, "part").select(F.array(enzyme).alias("enzymes")))


@query("""SELECT 't' || (s_suppkey % 50) AS target, n_nationkey AS gene_id, min('Nation ' || n_nationkey) AS matched_alias FROM supplier JOIN nation ON n_nationkey IN (s_nationkey, (s_nationkey + 1) % 25) GROUP BY ALL""")
def gene_bridge(spark, d):
    alias = lambda k: _say("Nation ", k)
    targets = table(spark, d, "supplier").select(_say("t", F.col("s_suppkey") % 50).alias("target"), F.array(alias(F.col("s_nationkey")), alias((F.col("s_nationkey") + 1) % 25)).alias("aliases"))
    genes = table(spark, d, "nation").select(_say("NATION-", F.col("n_nationkey")).alias("gene"), F.col("n_nationkey").alias("gene_id"))
    return ingest.gene_bridge(targets, genes)


# --- rules ----------------------------------------------------------------------------------------------------------

_TERMS = """WITH g AS (SELECT p_partkey, lower(p_name) AS drug, lower(p_type) AS class FROM part),
h AS (SELECT p_partkey AS herb, CASE p_partkey % 5 WHEN 0 THEN 'drugs such as ' || p_name || ' and more' WHEN 1 THEN 'any ' || p_type || ' medicine' WHEN 2 THEN 'Immuno drugs' WHEN 3 THEN 'Colour Words' ELSE upper(p_name) || 's' END AS term FROM part),
t AS (SELECT DISTINCT term, trim(regexp_replace(lower(term), '[^a-z0-9]+', ' ', 'g')) AS key FROM h), d AS (SELECT DISTINCT drug, class FROM g)"""


@query(_TERMS + """ SELECT DISTINCT herb, drug, 'major' AS severity FROM h JOIN t USING (term) JOIN d ON (length(drug) >= 5 AND contains(' ' || key || ' ', ' ' || drug || ' ')) OR contains(' ' || key || ' ', ' ' || class || ' ')""")
def herb_rules(spark, d):
    herbs = _herb_terms(spark, d).withColumn("severity", F.lit("major"))
    return ingest.herb_rules(herbs, table(spark, d, "part").select(F.lower("p_name").alias("drug"), F.col("p_type").alias("class")).distinct())


def _herb_terms(spark, d):
    k = F.col("p_partkey") % 5
    term = F.when(k == 0, _say("drugs such as ", F.col("p_name"), " and more")).when(k == 1, _say("any ", F.col("p_type"), " medicine")).when(k == 2, "Immuno drugs").when(k == 3, "Colour Words").otherwise(_say(F.upper("p_name"), "s"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("herb"), term.alias("term"))


@query(_TERMS + """, f AS (SELECT DISTINCT term, drug FROM t, d WHERE (length(drug) >= 5 AND contains(' ' || key || ' ', ' ' || drug || ' ')) OR (key = 'colour words' AND (contains(class, 'ECO') OR contains(class, 'mall') OR contains(class, 'tand')))
  OR (contains(key, 'immuno') AND ends_with(drug, 'olt')) OR (contains(key, 'medicine') AND ends_with(drug, 'et')) OR (contains(key, 'medicine') AND drug IN ('blue ring', 'red bolt')) OR (key = 'immuno drugs' AND drug = 'new rod'))
SELECT term, drug FROM f UNION SELECT term, 'listed only' FROM t WHERE key = 'immuno drugs'""")
def herb_rule_terms(spark, d):
    """What the terms of herbs stand for, by names, class fragments, endings of names, lists, and drugs stated for a term."""
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    drugs = table(spark, d, "part").select(F.lower("p_name").alias("drug"), F.col("p_type").alias("class")).distinct()
    return rules.term_drugs(
        _herb_terms(spark, d), drugs, make([("Colour words", "mall"), ("colour words", "TAND"), ("colour words", ""), ("unused term", "promo")], "term string, fragment string"),
        make([("immuno", "olt"), ("medicine", "et")], "marker string, ending string"), make([("medicine", "Blue ring"), ("medicine", "red bolt")], "marker string, name string"),
        make([("Immuno drugs", "new rod"), ("immuno drugs", "listed only"), ("other", "x")], "term string, drug string"),
    )


@query(GRAPH + """, named AS (SELECT patient, g.drug, g.name AS ingredient, g.class FROM baskets JOIN drugs g USING (drug)),
same AS (SELECT patient, ingredient FROM named GROUP BY ALL HAVING count(*) > 1), c AS (SELECT DISTINCT patient, class, ingredient FROM named WHERE class <> '')
SELECT patient, class, count(*) AS n FROM c LEFT JOIN (SELECT *, 1 AS known FROM same) s USING (patient, ingredient) GROUP BY ALL HAVING count(*) > 1 AND count(known) < count(*)""")
def duplicate_class_unflagged(spark, d):
    """Repeated classes of a patient, but for those whose ingredients are all reported as repeated ingredients."""
    named = _named(spark, d)
    same = safety.duplicates(named).where("kind = 'ingredient'").select("patient", F.col("what").alias("ingredient"))
    return safety.duplicate_classes(named, same)


@query("""WITH t AS (SELECT p_partkey AS seq, [lower(split_part(p_name, ' ', 1)), lower(p_type)] AS x, [lower(split_part(p_name, ' ', 2))] AS y, CASE WHEN p_partkey % 2 = 0 THEN 'r' || p_size END AS risk, 'do ' || p_brand AS recommendation FROM part),
p AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, seq, risk, recommendation FROM (SELECT seq, risk, recommendation, unnest(x) AS a, y[1] AS b FROM t) WHERE a <> b)
SELECT lo, hi, arg_min(risk, seq) FILTER (risk IS NOT NULL) AS risk, arg_min(recommendation, seq) AS recommendation FROM p GROUP BY ALL""")
def criteria_pairs(spark, d):
    """Pairs of a document's lists; the document is made of all parts in order, as a file of criteria is one document."""
    w, key = F.split("p_name", " "), F.col("p_partkey")
    row = F.struct(key, F.array(F.upper(w[0]), F.col("p_type")).alias("drug_names_1"), F.array(w[1]).alias("drug_names_2"), F.when(key % 2 == 0, _say("r", F.col("p_size"))).alias("risk"), _say("do ", F.col("p_brand")).alias("recommendation"))
    return ingest.criteria_pairs(table(spark, d, "part").agg(F.array_sort(F.collect_list(row)).alias("table5")))


@query("""SELECT l_partkey, l_suppkey, max(l_orderkey) AS seq, arg_max(n, l_orderkey) AS n FROM (SELECT l_partkey, l_suppkey, l_orderkey, max(l_quantity) AS n FROM lineitem GROUP BY ALL) GROUP BY l_partkey, l_suppkey""")
def last_rows(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey", F.col("l_orderkey").alias("seq")).agg(F.max("l_quantity").alias("n"))
    return ingest.last_rows(rows, ["l_partkey", "l_suppkey"], F.col("seq"))


@query("""WITH g AS (SELECT p_partkey, ['Metformin', 'rosuvastatin', 'plain', 'Verapamil', 'amlodipine', 'senna'][1 + p_partkey % 6] || CASE WHEN p_partkey % 12 >= 6 THEN ' ' || p_partkey ELSE '' END AS drug, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE '' END AS class FROM part),
b AS (SELECT drug, count(DISTINCT p_brand) AS n FROM part JOIN g USING (p_partkey) GROUP BY drug)
SELECT p_partkey, drug, CASE WHEN class <> '' THEN class WHEN p_partkey % 12 >= 6 THEN NULL ELSE ['biguanide', 'statin', NULL, 'ccb', 'ccb', 'laxative'][1 + p_partkey % 6] END AS class, n AS n_brands FROM g JOIN b USING (drug)""")
def class_backfill(spark, d):
    part, key = table(spark, d, "part"), F.col("p_partkey")
    names = F.array(*map(F.lit, ("Metformin", "rosuvastatin", "plain", "Verapamil", "amlodipine", "senna")))
    drug = F.concat(F.element_at(names, (key % 6 + 1).cast("int")), F.when(key % 12 >= 6, _say(" ", key)).otherwise(""))
    rows = part.select("p_partkey", drug.alias("drug"), F.when(key % 5 == 0, F.col("p_type")).otherwise("").alias("class"))
    return ingest.class_backfill(rows, part.select(F.col("p_brand").alias("brand"), drug.alias("drug"))).select("p_partkey", "drug", "class", "n_brands")


# --- files ----------------------------------------------------------------------------------------------------------


def _place(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT p_partkey::VARCHAR AS id, p_name || ', "' || p_brand || '"' AS name, p_type AS kind, NULL AS note FROM part""")
def delimited_files(spark, d):
    """Parts written as quoted, delimited text and read by the aliases of its header."""
    part, path = table(spark, d, "part"), _place(spark, "files-delimited")
    part.select(F.col("p_partkey").alias("Part ID"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("NAME"), F.col("p_type").alias("Class_Name")).write.options(header=True, sep=";", quote='"', escape='"').csv(path)
    rows = files.read_delimited(spark, path, sep=";")
    return files.with_header(rows, {"id": ("part_id",), "name": (), "kind": ("class name",), "note": ("remark",)}, ("id", "name"))


@query("""SELECT 'CID' || p_partkey AS code, p_type AS kind, p_name AS effect FROM part WHERE p_partkey % 3 <> 0""")
def positional_files(spark, d):
    """Gzipped text without a header, by position; rows that are too short go."""
    part, path = table(spark, d, "part"), _place(spark, "files-positional")
    line = F.when(F.col("p_partkey") % 3 != 0, F.concat_ws("\t", _say("CID", F.col("p_partkey")), F.lit("x"), F.col("p_type"), F.col("p_name"))).otherwise(F.concat_ws("\t", _say("CID", F.col("p_partkey")), F.lit("x")))
    part.select(line.alias("value")).write.option("compression", "gzip").text(path)
    return files.read_positional(spark, path, {0: "code", 2: "kind", 3: "effect"})


@query("""SELECT p_partkey AS id, 'strong' AS heading, unnest(string_split(p_name, ' ')) AS item FROM part UNION ALL SELECT p_partkey, 'weak', p_brand FROM part WHERE p_size % 2 = 0""")
def wide_tables(spark, d):
    wide = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit(" , ")).alias("strong"), F.when(F.col("p_size") % 2 == 0, _say(F.col("p_brand"), " ,")).alias("weak"))
    return files.unpivoted(wide, "id")


@query("""SELECT split_part(p_name, ' ', 1) AS drug, CASE WHEN p_size % 2 = 0 THEN 'Known Risk' ELSE 'Possible Risk' END AS risk FROM part""")
def matched_lines(spark, d):
    page = F.concat_ws("\n", F.lit("Title"), _say(F.split("p_name", " ")[0], "   ", F.when(F.col("p_size") % 2 == 0, "Known Risk").otherwise("Possible Risk")), F.col("p_brand"))
    return files.matched_lines(table(spark, d, "part").select(page.alias("text")), "text", r"^(\w+) +((?:Known|Possible) Risk)$", ("drug", "risk"))


@query("""SELECT 'k' || s_suppkey AS key, s_name AS generic, s_nationkey::VARCHAR AS dose FROM supplier""")
def mapping_files(spark, d):
    """JSON objects of objects, a file for each nation, as rows."""
    inner = F.map_from_entries(F.collect_list(F.struct(_say("k", F.col("s_suppkey")), F.struct(F.col("s_name").alias("generic"), F.col("s_nationkey").cast("string").alias("dose")))))
    path = _place(spark, "files-mapping")
    rows = table(spark, d, "supplier").repartition(25, "s_nationkey").groupBy("s_nationkey").agg(F.to_json(inner).alias("value"))
    rows.write.partitionBy("s_nationkey").text(path)
    return files.read_mapping(spark, f"{path}/*", "generic string, dose string")


@query("""SELECT p_partkey, 'major' AS bucket, unnest(string_split(p_name, ' ')) AS word FROM part UNION ALL SELECT p_partkey, 'minor', unnest([lower(p_brand), lower(p_type)]) FROM part""")
def bucketed_lists(spark, d):
    buckets = F.create_map(F.lit("major"), F.split("p_name", " "), F.lit("minor"), F.array(F.lower("p_brand"), F.lower("p_type")))
    return files.bucketed(table(spark, d, "part"), F.col("p_partkey"), buckets).select(F.col("key").alias("p_partkey"), "bucket", F.col("name").alias("word"))


@query("""SELECT p_partkey, [p_name || ' | ' || p_brand, p_name, p_brand, ''][1 + p_partkey % 4] AS locator, CASE WHEN length(p_name) > 9 THEN rtrim(left(p_name, 6)) || '...' ELSE p_name END AS short,
[p_name || ' ' || p_type, p_name, p_name || ' ' || p_type, p_type][1 + p_partkey % 4] AS evidence, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey::INT END AS compound FROM part""")
def text_rules(spark, d):
    """Locators, evidence without repeats, cut texts, numbers of compound codes."""
    k, name, brand = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_brand")
    one, two = F.when(k < 2, name).otherwise(" "), F.when((k == 0) | (k == 2), brand)
    code = F.when(F.col("p_partkey") % 3 == 0, "CID0x").otherwise(_say("CID0", F.col("p_partkey")))
    said = T.evidence_text(F.when(k != 3, _say(" ", name)), F.when(k == 1, F.upper(name)).otherwise(F.col("p_type")), F.lit(""))
    return table(spark, d, "part").select("p_partkey", T.locator(one, two).alias("locator"), T.truncated(name, 9).alias("short"), said.alias("evidence"), T.compound_id(code).alias("compound"))
