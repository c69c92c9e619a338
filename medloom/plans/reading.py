"""Medicines read from label texts, entries made one, names resolved and severities repaired as queries, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from medloom.functions import pharmacology as P
from medloom.functions import text as T
from medloom.operators import medicines as D
from medloom.operators import resolve as R
from medloom.operators import severity as V
from medloom.plans import standin as N
from medloom.plans.queries import query
from medloom.plans.standin import GRAPH, table

# --- label texts ----------------------------------------------------------------------------------------------------


def _squeeze(x):
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _name(x):
    """`ingredient_name` in SQL."""
    x = rf"trim({_squeeze(x)}, ' :-,')"
    x = rf"trim({_squeeze(rf"regexp_replace({x}, '(?is)^.*?\bequivalent to\b', '')")}, ' :-,')"
    x = f"regexp_replace(regexp_replace({x}, '{D.STANDARD}', '', 'g'), '{D.PLAIN_FORM}', '', 'g')"
    return f"trim({_squeeze(x)}, ' :-,')"


_LABELS = r"""WITH w AS (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part),
labels AS (SELECT p_partkey, CASE p_partkey % 5
  WHEN 0 THEN upper(p_name) || ' ' || p_size || chr(10) || 'Each film-coated tablet contains: ' || w1 || ' IP ' || p_size || ' mg + base equivalent to ' || w2 || ' tablets 5mg. Keep cool.'
  WHEN 1 THEN 'Composition' || chr(10) || ' - ' || p_brand || '  Forte -' || chr(10) || w1 || ' IP 250 mg per tablet' || chr(10) || w2 || ' syrup 10 ml, contains sugar' || chr(10) || p_brand || ' Forte 5 mg tablet'
  WHEN 2 THEN 'Storage: cool' || chr(10) || 'ab' || chr(10) || p_name || ' tablets'
  WHEN 4 THEN p_name || chr(10) || 'Each ml contains ' || w1 || ', ' || w2 || ' 2.5 ML' END AS t FROM w)"""


def _labels(spark, d):
    part = table(spark, d, "part")
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    name, brand, size, k = F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string"), F.col("p_partkey") % 5
    w1, w2 = F.split(name, " ")[0], F.split(name, " ")[1]
    label = (
        F.when(k == 0, say(F.upper(name), " ", size, "\nEach film-coated tablet contains: ", w1, " IP ", size, " mg + base equivalent to ", w2, " tablets 5mg. Keep cool."))
        .when(k == 1, say("Composition\n - ", brand, "  Forte -\n", w1, " IP 250 mg per tablet\n", w2, " syrup 10 ml, contains sugar\n", brand, " Forte 5 mg tablet"))
        .when(k == 2, say("Storage: cool\nab\n", name, " tablets")).when(k == 4, say(name, "\nEach ml contains ", w1, ", ", w2, " 2.5 ML"))
    )
    return part.select("p_partkey", label.alias("t"))


@query(_LABELS + rf""", l AS (SELECT *, list_transform(string_split(t, chr(10)), lambda x: {_squeeze('x')}) AS lines FROM labels WHERE t IS NOT NULL),
b AS (SELECT *, coalesce(list_filter(list_transform(lines, lambda x: trim(x, ' -:')), lambda x: length(x) >= 3 AND NOT regexp_matches(x, '{D.NO_BRAND}'))[1], '') AS brand_name FROM l),
s AS (SELECT *, list_filter(list_transform(list_filter(list_transform(string_split_regex(regexp_extract(t, '{D.COMPOSITION}', 1), '\s*\+\s*|,\s*'), lambda c: trim(c)), lambda c: c <> ''),
    lambda c: {{'name': {_name(f"regexp_replace(c, '(?s){D.DOSE}.*$', '')")}, 'dose': regexp_extract(c, '{D.DOSE}', 1) || regexp_extract(c, '{D.DOSE}', 2)}}), lambda i: i.name <> '') AS said,
  list_filter(list_transform(list_filter(lines, lambda x: x <> '' AND NOT starts_with(lower(x), lower(brand_name)) AND regexp_matches(lower(x), ' ip | bp | usp |contains|tablet|capsule') AND regexp_matches(x, '{D.LINE}')),
    lambda x: {{'name': {_name(f"regexp_extract(x, '{D.LINE}', 1)")}, 'dose': regexp_extract(x, '{D.LINE}', 2) || regexp_extract(x, '{D.LINE}', 3)}}), lambda i: i.name <> '') AS lined FROM b),
i AS (SELECT *, CASE WHEN len(said) > 0 THEN said ELSE lined END AS ing FROM s)
SELECT p_partkey, brand_name, array_to_string(list_transform(ing, lambda x: x.name), ' + ') AS generic_name, array_to_string(list_transform(ing, lambda x: x.name || '|' || x.dose), ';') AS ingredients,
lower(regexp_extract(t, '{D.FORM}', 1)) AS dosage_form, CASE WHEN brand_name <> '' THEN 0.72 ELSE 0.66 END::DOUBLE AS confidence FROM i WHERE len(ing) > 0""")
def extracted_medicines(spark, d):
    found = D.extracted(_labels(spark, d), "t", ["p_partkey"])
    listed = F.array_join(F.transform("ingredients", lambda i: F.concat_ws("|", i["name"], i["dose"])), ";")
    return found.select("p_partkey", "brand_name", "generic_name", listed.alias("ingredients"), "dosage_form", "confidence")


@query(r"""WITH r AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, p_name, p_brand FROM part),
c AS (SELECT p_partkey, trim(regexp_replace(CASE p_partkey % 4 WHEN 0 THEN w1 || ' (a, b)  ' || w2 WHEN 1 THEN p_name || ' (' || p_brand || ')(x,)' WHEN 2 THEN 'S-' || w1 || '/' || w2 || ' / -' ELSE ' - ' END, '\s+', ' ', 'g')) AS cell FROM r),
b AS (SELECT *, trim(regexp_replace(cell, '\([a-z, ]+\)', '', 'g'), ' ,;') AS bare FROM c),
e AS (SELECT p_partkey, cell, list_transform(list_concat([bare, regexp_replace(bare, '\([^)]*\)', '', 'g')], regexp_extract_all(bare, '\(([^)]{2,})\)', 1), CASE WHEN contains(bare, '/') THEN string_split(bare, '/') ELSE [] END,
  [CASE WHEN regexp_matches(lower(bare), '^[sr]-.') THEN substr(bare, 3) END]), lambda n: trim(regexp_replace(n, '\s+', ' ', 'g'))) AS names FROM b)
SELECT p_partkey, CASE WHEN cell = '-' THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter(names, lambda n: n IS NOT NULL AND n <> '' AND n <> '-'))), ';') END AS names FROM e""")
def candidate_names(spark, d):
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    name, k = F.col("p_name"), F.col("p_partkey") % 4
    w1, w2 = F.split(name, " ")[0], F.split(name, " ")[1]
    cell = F.when(k == 0, say(w1, " (a, b)  ", w2)).when(k == 1, say(name, " (", F.col("p_brand"), ")(x,)")).when(k == 2, say("S-", w1, "/", w2, " / -")).otherwise(" - ")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(D.candidate_names(cell)), ";").alias("names"))


_PACKAGING = ", ".join(f"'{w}'" for w in D.PACKAGING)


def _quality(x):
    """`brand_quality` in SQL."""
    low, tokens = _squeeze(f"lower(coalesce({x}, ''))"), f"regexp_extract_all({_squeeze(f"lower(coalesce({x}, ''))")}, '[a-z0-9]+')"
    telling = f"len(list_filter({tokens}, lambda t: t NOT IN ({_PACKAGING}) AND NOT regexp_matches(t, '^[0-9]+$')))"
    return f"""CASE WHEN {low} = '' THEN -5 WHEN regexp_matches({low}, '{D.PACKAGING_ONLY}') THEN -8 ELSE CASE WHEN regexp_matches({low}, '[a-z]') THEN 3 ELSE 0 END
    + CASE WHEN regexp_matches({low}, '[0-9]') THEN 1 ELSE 0 END + 2 * {telling} - len(list_filter({tokens}, lambda t: t IN ({_PACKAGING}))) - CASE WHEN {telling} = 0 THEN 4 ELSE 0 END END"""


@query(f"""SELECT p_partkey, ({_quality("brand")})::INT AS quality FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '10 Tablets of ' || p_name WHEN 1 THEN upper(p_name) || ' ' || p_size || ' strip'
WHEN 2 THEN ' ' WHEN 3 THEN 'x10  pack ' || p_size WHEN 4 THEN '!' || p_size END AS brand FROM part)""")
def brand_scores(spark, d):
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    brand = (
        F.when(k == 0, F.concat(F.lit("10 Tablets of "), "p_name")).when(k == 1, F.concat(F.upper("p_name"), F.lit(" "), size, F.lit(" strip"))).when(k == 2, " ")
        .when(k == 3, F.concat(F.lit("x10  pack "), size)).otherwise(F.concat(F.lit("!"), size))
    )
    return table(spark, d, "part").select("p_partkey", D.brand_quality(brand).cast("int").alias("quality"))


@query(rf"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', ' ', 'g'), '{D.TERM}'),
lambda x: NOT regexp_matches(x, '[0-9]') AND len(string_split_regex(x, '\s+')) <= 4))), ';') AS terms FROM conversations""")
def medical_terms(spark, d):
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", " ")
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(D.medical_terms(plain)), ";").alias("terms"))


# --- entries --------------------------------------------------------------------------------------------------------

_ENTRIES = """WITH w AS (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part),
entries AS (SELECT l_orderkey AS doc, l_linenumber AS entry, CASE l_linenumber % 4 WHEN 0 THEN '10 tablets' WHEN 1 THEN p_brand WHEN 3 THEN p_brand || ' Forte' END AS brand_name,
  CASE p_size % 3 WHEN 1 THEN upper(w1) WHEN 2 THEN w1 || ' ' || w2 END AS generic_name, CASE l_linenumber % 2 WHEN 0 THEN 'Tablet' END AS dosage_form, l_discount * 8 AS confidence,
  list_concat([{'name': w1, 'dose': (l_linenumber % 2 + 1) || ' MG'}, {'name': ' base', 'dose': (l_linenumber % 2 + 1) || ' mg'}], CASE WHEN p_size % 2 = 0 THEN [{'name': upper(w1), 'dose': (l_linenumber % 2 + 1) || 'mg'}, {'name': 'salt', 'dose': '5 mg'}] ELSE [] END) AS ingredients
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, max(l_discount) AS l_discount FROM lineitem GROUP BY ALL) JOIN w ON p_partkey = l_partkey),
known AS (SELECT DISTINCT lower(w1) AS key, upper(w1) AS entity, 'exact' AS match_type FROM w WHERE length(w1) <= 4 UNION ALL SELECT DISTINCT lower(p_name), min(p_brand), 'brand' FROM w WHERE length(w1) = 5 GROUP BY 1)"""


def _entries(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.max("l_discount").alias("l_discount"))
    rows = lines.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    w1, w2, line, size = F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.col("l_linenumber"), F.col("p_size")
    item = lambda name, dose: F.struct(name.alias("name"), dose.alias("dose"))
    unit = lambda u: F.concat((line % 2 + 1).cast("string"), F.lit(u))
    more = F.array(item(F.upper(w1), unit("mg")), item(F.lit("salt"), F.lit("5 mg")))
    two = F.array(item(w1, unit(" MG")), item(F.lit(" base"), unit(" mg")))
    return rows.select(
        F.col("l_orderkey").alias("doc"), line.alias("entry"),
        F.when(line % 4 == 0, "10 tablets").when(line % 4 == 1, F.col("p_brand")).when(line % 4 == 3, F.concat("p_brand", F.lit(" Forte"))).alias("brand_name"),
        F.when(size % 3 == 1, F.upper(w1)).when(size % 3 == 2, F.concat_ws(" ", w1, w2)).alias("generic_name"),
        F.when(line % 2 == 0, "Tablet").alias("dosage_form"), (F.col("l_discount") * 8).alias("confidence"),
        F.when(size % 2 == 0, F.concat(two, more)).otherwise(two).alias("ingredients"),
    )


def _known(spark, d):
    part, w1 = table(spark, d, "part"), F.split("p_name", " ")[0]
    short = part.where(F.length(w1) <= 4).select(F.lower(w1).alias("key"), F.upper(w1).alias("entity"), F.lit("exact").alias("match_type")).distinct()
    return short.unionByName(part.where(F.length(w1) == 5).groupBy(F.lower("p_name").alias("key")).agg(F.min("p_brand").alias("entity"), F.lit("brand").alias("match_type")))


_ENRICHED = _ENTRIES + rf""", i AS (SELECT doc, entry, trim(x.name) AS raw, trim(x.dose) AS dose, pos FROM (SELECT doc, entry, unnest(ingredients) AS x, generate_subscripts(ingredients, 1) AS pos FROM entries)),
j AS (SELECT i.*, k.entity IS NOT NULL AS met, coalesce(k.entity, raw) AS name FROM i LEFT JOIN known k ON k.key = trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g'))),
f AS (SELECT * FROM j a WHERE met OR NOT EXISTS (SELECT 1 FROM j b WHERE b.doc = a.doc AND b.entry = a.entry AND b.met AND b.dose <> '' AND lower(b.dose) = lower(a.dose))),
u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc, entry, {_squeeze('lower(name)')}, replace({_squeeze('lower(dose)')}, ' ', '') ORDER BY pos) = 1),
l AS (SELECT doc, entry, list({{'name': name, 'dose': dose}} ORDER BY pos) AS ing, bool_and(met) AS every, array_to_string(list(name ORDER BY pos), ' + ') AS joined FROM u GROUP BY ALL),
g AS (SELECT e.*, ing, every, (SELECT string_agg(name, ' + ' ORDER BY pos) FROM (SELECT name, min(pos) AS pos FROM u WHERE u.doc = e.doc AND u.entry = e.entry GROUP BY name)) AS joined2, k.entity, k.match_type AS kind
  FROM entries e LEFT JOIN l USING (doc, entry) LEFT JOIN known k ON k.key = trim(regexp_replace(lower(coalesce(generic_name, '')), '[^a-z0-9]+', ' ', 'g'))),
enriched AS (SELECT doc, entry, brand_name, CASE WHEN entity IS NOT NULL THEN entity WHEN ing IS NOT NULL THEN joined2 ELSE trim(coalesce(generic_name, '')) END AS generic_name, coalesce(ing, []) AS ingredients, dosage_form,
  greatest(0.0, least(1.0, confidence)) AS confidence, entity IS NOT NULL OR coalesce(every, false) AS graph_match,
  CASE WHEN entity IS NOT NULL THEN kind WHEN every THEN 'ingredient_resolved' WHEN ing IS NOT NULL THEN 'ingredient_partial' ELSE 'not_found' END AS match_type FROM g)"""
_LISTED = "array_to_string(list_transform(ingredients, lambda x: x.name || '|' || x.dose), ';')"


@query(_ENRICHED + f" SELECT doc, entry, generic_name, {_LISTED} AS ingredients, confidence, graph_match, match_type FROM enriched")
def unmatched_by_dose(spark, d):
    """Entries of orders with their ingredients looked up; unknown ones of a dose that a known one has are left out."""
    entries = _entries(spark, d).withColumn("id", F.struct("doc", "entry"))
    found = D.enriched(entries, "id", _known(spark, d))
    return found.select("doc", "entry", "generic_name", _listed(), "confidence", "graph_match", "match_type")


def _listed():
    return F.array_join(F.transform("ingredients", lambda i: F.concat_ws("|", i["name"], i["dose"])), ";").alias("ingredients")


_WORTH = "CASE match_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.MATCH_WORTH.items()) + " ELSE 0 END"


@query(_ENRICHED + rf""", m AS (SELECT *, list_sort(list_distinct(list_transform(ingredients, lambda x: {_squeeze('lower(x.name)')} || '|' || replace({_squeeze('lower(x.dose)')}, ' ', '')))) AS sig, ({_quality('brand_name')}) AS quality FROM enriched),
p AS (SELECT *, CASE WHEN trim(generic_name) <> '' THEN {_squeeze('lower(generic_name)')} WHEN len(sig) > 0 THEN array_to_string(sig, '+') ELSE lower(coalesce(brand_name, '')) END AS anchor, coalesce(lower(dosage_form), '') AS form,
  row(graph_match::INT, {_WORTH}, len(sig), (trim(generic_name) <> '')::INT, quality, confidence, length(trim(coalesce(brand_name, ''))), -entry) AS pref FROM m)
SELECT doc, min(entry) AS entry, arg_max(coalesce(brand_name, ''), row(quality, pref)) AS brand_name, arg_max(generic_name, pref) AS generic_name, arg_max({_LISTED}, row(len(ingredients), pref)) AS ingredients,
max(confidence) AS confidence, bool_or(graph_match) AS graph_match, arg_max(match_type, pref) AS match_type, count(*) AS readings FROM p GROUP BY doc, anchor, array_to_string(sig, '+'), form""")
def merged_entries(spark, d):
    """Entries of an order that say the same, as one: the preferred reading with the most telling brand."""
    entries = _entries(spark, d).withColumn("id", F.struct("doc", "entry"))
    found = D.enriched(N.dealt(spark, d, entries, "id"), "id", _known(spark, d)).withColumn("brand_name", F.coalesce("brand_name", F.lit("")))
    found = D.deduped(N.dealt(spark, d, found, "doc"), "doc")
    return found.select("doc", "entry", "brand_name", "generic_name", _listed(), "confidence", "graph_match", "match_type", "readings")


@query(_ENTRIES + f""", k AS (SELECT *, CASE WHEN trim(coalesce(brand_name, '')) <> '' THEN 'b:' || lower(brand_name) ELSE 'g:' || lower(coalesce(generic_name, '')) END AS k FROM entries),
i AS (SELECT doc, k, x, lower(x.name) AS n, lower(x.dose) AS d, entry, pos FROM (SELECT doc, k, entry, unnest(ingredients) AS x, generate_subscripts(ingredients, 1) AS pos FROM k) QUALIFY row_number() OVER (PARTITION BY doc, k, n, d ORDER BY entry, pos) = 1),
l AS (SELECT doc, k, string_agg(x.name || '|' || x.dose, ';' ORDER BY entry, pos) AS ingredients FROM i GROUP BY ALL)
SELECT doc, min(entry) AS entry, arg_min(brand_name, entry) FILTER (brand_name <> '') AS brand_name, arg_min(generic_name, entry) FILTER (generic_name <> '') AS generic_name, any_value(l.ingredients) AS ingredients,
arg_min(dosage_form, entry) FILTER (dosage_form <> '') AS dosage_form, max(confidence) AS confidence FROM k JOIN l USING (doc, k) GROUP BY doc, k""")
def united_entries(spark, d):
    """Entries of an order with the same brand (or generic name) as one, blanks filled and ingredients united."""
    return D.merged(_entries(spark, d), "doc", parts=N.parts(spark, d)).select("doc", "entry", "brand_name", "generic_name", _listed(), "dosage_form", "confidence")


# --- names ----------------------------------------------------------------------------------------------------------


@query(r"""WITH c AS (SELECT c_custkey AS id, 'customer ' || lpad(c_custkey::VARCHAR, 9, '0') AS key, c_name AS entity FROM customer), many AS (SELECT count(*) AS n FROM customer),
r AS (SELECT p_partkey, p_partkey % n AS id, CASE p_partkey % 6 WHEN 0 THEN upper(entity) WHEN 1 THEN 'Alias  ' || (p_partkey % n) WHEN 2 THEN p_name || ' ' || p_size || 'mg Tablet' WHEN 3 THEN 'Custmer#' || lpad((p_partkey % n)::VARCHAR, 9, '0') WHEN 4 THEN 'zzz' || translate(p_partkey::VARCHAR, '0123456789', 'abcdefghij') ELSE ' ' END AS raw
  FROM part, many JOIN c ON c.id = part.p_partkey % many.n),
n AS (SELECT DISTINCT p_name || ' ' || p_size || ' tablet' AS name FROM part), inside AS (SELECT p_name || ' ' || p_size || ' tablet' AS name, min(entity) AS entity FROM part, many JOIN c ON c.id = p_partkey % n GROUP BY 1),
w AS (SELECT name, string_split(name, ' ') AS words FROM n), s AS (SELECT count(*) AS many, avg(len(words)) AS length FROM w), post AS (SELECT name, unnest(words) AS token FROM w),
t AS (SELECT token, df, ln(1.0 + (many - df + 0.5)::DOUBLE / (df + 0.5)::DOUBLE) AS idf FROM (SELECT token, count(*) AS df FROM post GROUP BY token), s),
q AS (SELECT DISTINCT raw AS query, unnest([p_name || ' ' || p_size || ' mg tablet', p_name || ' ' || p_size || ' mg', p_name || ' ' || p_size || 'mg', p_name || ' ' || p_size, p_name, p_size || ' ' || p_name]) AS question FROM r JOIN part USING (p_partkey) WHERE p_partkey % 6 = 2),
k AS (SELECT query, question, token, df, idf FROM (SELECT query, question, unnest(string_split(question, ' ')) AS token FROM q) JOIN t USING (token)),
good AS (SELECT DISTINCT query, question FROM k, s WHERE df <= greatest(20.0, 0.05 * many)),
cand AS (SELECT DISTINCT query, question, name FROM k JOIN post USING (token), s WHERE df <= greatest(20.0, 0.05 * many)),
sc AS (SELECT query, name, question, sum(idf / (1.0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(words) / length))) AS score FROM cand JOIN k USING (query, question) JOIN w USING (name), s WHERE list_contains(words, token) GROUP BY ALL),
b AS (SELECT query, name, round(max(score), 6) AS score, min(CASE WHEN contains(' ' || name || ' ', ' ' || question || ' ') THEN 0 WHEN len(list_filter(string_split(question, ' '), lambda x: NOT list_contains(string_split(name, ' '), x))) = 0 THEN 1 ELSE 2 END) AS tier FROM sc GROUP BY query, name HAVING round(max(score), 6) > 1
  QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(max(score), 6) DESC, tier, name) = 1)
SELECT p_partkey, raw, CASE p_partkey % 6 WHEN 2 THEN inside.entity WHEN 4 THEN CASE WHEN p_partkey % 12 = 4 THEN 'Z' || p_partkey END WHEN 5 THEN NULL ELSE c.entity END AS entity,
CASE p_partkey % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'synonym' WHEN 2 THEN 'brand' WHEN 3 THEN 'fuzzy' WHEN 4 THEN CASE WHEN p_partkey % 12 = 4 THEN 'suggested' ELSE 'none' END ELSE 'none' END AS match_type,
CASE p_partkey % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.98 WHEN 2 THEN round(least(0.93, 0.55 + b.score / 20), 4) WHEN 3 THEN round(least(0.82, 0.35 + 5.0 * (1 - 1 / 18.0) / 10), 4) WHEN 4 THEN CASE WHEN p_partkey % 12 = 4 THEN 0.8 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS confidence
FROM r JOIN c USING (id) LEFT JOIN b ON b.query = raw LEFT JOIN inside ON inside.name = b.name""")
def drug_cascade(spark, d):
    """Names of five kinds and blanks, through all tiers."""
    customer, part = table(spark, d, "customer"), table(spark, d, "part")
    many, key = customer.count(), F.col("p_partkey")
    drugs = customer.select(T.lookup_key(F.col("c_name")).alias("key"), F.col("c_name").alias("entity"))
    synonyms = customer.select(F.concat(F.lit("alias "), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("entity"))
    rows = part.withColumn("id", key % many).join(customer.select(F.col("c_custkey").alias("id"), "c_name").hint("merge"), "id")
    k, size = key % 6, F.col("p_size").cast("string")
    odd = F.concat(F.lit("zzz"), F.translate(key.cast("string"), "0123456789", "abcdefghij"))
    raw = (
        F.when(k == 0, F.upper("c_name")).when(k == 1, F.concat(F.lit("Alias  "), F.col("id").cast("string"))).when(k == 2, F.concat("p_name", F.lit(" "), size, F.lit("mg Tablet")))
        .when(k == 3, F.replace("c_name", F.lit("tom"), F.lit("tm"))).when(k == 4, odd).otherwise(" ")
    )
    brands = rows.select(F.concat("p_name", F.lit(" "), size, F.lit(" tablet")).alias("brand"), F.col("c_name").alias("entity"))
    suggested = part.where(key % 12 == 4).select(odd.alias("key"), F.concat(F.lit("Z"), key.cast("string")).alias("entity"))
    found = R.drug_cascade(rows.select("p_partkey", raw.alias("raw")), "raw", drugs, synonyms, brands, suggested)
    return found.select("p_partkey", "raw", "entity", "match_type", "confidence")


# --- severities -----------------------------------------------------------------------------------------------------

_NAMES = ("warfarin", "alprazolam", "Aspirin", "amlodipine", "Metformin", "omeprazole", "erlotinib", "plain", "other", "Heparin", "losartan", "insulin", "codeine")
_CLASSES = ("Opioid agonist", "DPP-4 blocker", "none", "thiazide like", "antiplatelet")


def _sql_group(group, end):
    names, words = P.GROUPS[group]
    test = f"{end}.name IN ({', '.join(repr(n) for n in names)})"
    return f"({test} OR regexp_matches({end}.class, '{'|'.join(sorted({w.replace('-', ' ') for w in words}))}'))" if words else f"({test})"


_BOTH = " ".join(f"WHEN {_sql_group(g, 'x')} AND {_sql_group(g, 'y')} THEN '{{{i}}}'" for i, (g, _, _) in enumerate(P.TOGETHER))
_RULE = f"CASE WHEN x.name IN ({', '.join(repr(n) for n in P.NTI)}) OR y.name IN ({', '.join(repr(n) for n in P.NTI)}) OR x.nti OR y.nti THEN '{{n}}' {_BOTH} WHEN ({_sql_group('ppi', 'x')} AND {_sql_group('gastric', 'y')}) OR ({_sql_group('ppi', 'y')} AND {_sql_group('gastric', 'x')}) THEN '{{p}}' END"
_SEVERITY_OF = _RULE.replace("{n}", "major").replace("{p}", "minor")
_REASON_OF = _RULE.replace("{n}", "narrow_therapeutic_index").replace("{p}", "ppi_with_gastric_ph_sensitive_drug")
for _i, (_g, _s, _r) in enumerate(P.TOGETHER):
    _SEVERITY_OF, _REASON_OF = _SEVERITY_OF.replace(f"{{{_i}}}", _s), _REASON_OF.replace(f"{{{_i}}}", _r)


@query(GRAPH + f""", d2 AS (SELECT drug, lower([{', '.join(repr(n) for n in _NAMES)}][1 + drug % {len(_NAMES)}]) AS name, trim(regexp_replace(lower([{', '.join(repr(c) for c in _CLASSES)}][1 + (drug // 3) % {len(_CLASSES)}]), '[^a-z0-9]+', ' ', 'g')) AS class, drug % 50 = 0 AS nti FROM drugs),
e AS (SELECT lo, hi, seq, CASE WHEN seq % 4 = 0 THEN 'unknown' ELSE severity END AS severity, CASE source WHEN '1-URGENT' THEN CASE WHEN (lo + hi) % 3 = 0 THEN 'good' ELSE 'second' END WHEN '2-HIGH' THEN CASE WHEN hi % 4 = 0 THEN 'listed' ELSE 'second' END ELSE 'second' END AS source, seq % 40 = 1 AS flagged FROM edges),
good AS (SELECT lo, hi, arg_max(severity, rank) AS s FROM e JOIN sevrank USING (severity) WHERE source = 'good' GROUP BY ALL), listed AS (SELECT DISTINCT lo, hi FROM e WHERE source = 'listed'),
ev AS (SELECT DISTINCT lo, hi, CASE (lo + hi) % 15 WHEN 0 THEN ['Fatal STROKE', 'rash', 'death'] WHEN 5 THEN ['rash', 'mild bleeding'] ELSE ['rash', 'itch'] END AS events FROM e WHERE (lo + hi) % 5 = 0),
j AS (SELECT e.*, g.s AS good, l.lo IS NOT NULL AS is_listed, events, {_SEVERITY_OF} AS rs, {_REASON_OF} AS rr FROM e LEFT JOIN good g USING (lo, hi) LEFT JOIN listed l USING (lo, hi) LEFT JOIN ev USING (lo, hi) JOIN d2 x ON x.drug = e.lo JOIN d2 y ON y.drug = e.hi),
m AS (SELECT *, CASE WHEN source <> 'second' OR severity <> 'unknown' THEN 'original' WHEN good IS NOT NULL THEN 'matched_trusted' WHEN is_listed OR flagged THEN 'matched_listed' WHEN events IS NOT NULL THEN 'shared_events' WHEN rs IS NOT NULL THEN 'pharmacology_rule' ELSE 'default_low_confidence' END AS method FROM j)
SELECT lo, hi, seq, source, severity AS original_severity, method, CASE method WHEN 'original' THEN severity WHEN 'matched_trusted' THEN good WHEN 'matched_listed' THEN 'major' WHEN 'shared_events' THEN CASE (lo + hi) % 15 WHEN 0 THEN 'major' WHEN 5 THEN 'moderate' ELSE 'minor' END WHEN 'pharmacology_rule' THEN rs ELSE 'minor' END AS severity,
CASE method WHEN 'original' THEN NULL WHEN 'matched_trusted' THEN good WHEN 'matched_listed' THEN 'flagged_pair' WHEN 'shared_events' THEN CASE (lo + hi) % 15 WHEN 0 THEN 'death|stroke' WHEN 5 THEN 'bleeding' ELSE 'rash|itch' END WHEN 'pharmacology_rule' THEN rr ELSE 'no_stronger_support' END AS evidence,
CASE method WHEN 'original' THEN NULL WHEN 'matched_trusted' THEN 'high' WHEN 'matched_listed' THEN 'high' WHEN 'shared_events' THEN CASE WHEN (lo + hi) % 15 IN (0, 5) THEN 'medium' ELSE 'low' END ELSE 'low' END AS sure,
method IN ('pharmacology_rule', 'default_low_confidence') OR (method = 'shared_events' AND (lo + hi) % 15 NOT IN (0, 5)) AS review_needed FROM m""")
def severity_repair_b(spark, d):
    """Unknown severities of the second source, through all tiers, with names and classes that meet every rule."""
    pick = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), (at % len(words) + 1).cast("int"))
    drug = F.col("drug")
    drugs = N.drugs(spark, d).select("drug", pick(_NAMES, drug).alias("name"), pick(_CLASSES, F.floor(drug / 3)).alias("class"), (drug % 50 == 0).alias("nti"))
    both, source = F.col("lo") + F.col("hi"), F.col("source")
    kind = F.when((source == "1-URGENT") & (both % 3 == 0), "good").when((source == "2-HIGH") & (F.col("hi") % 4 == 0), "listed").otherwise("second")
    edges = N.direct_edges(spark, d).select("lo", "hi", "seq", F.when(F.col("seq") % 4 == 0, "unknown").otherwise(F.col("severity")).alias("severity"), kind.alias("source"), (F.col("seq") % 40 == 1).alias("flagged"))
    words = F.when(both % 15 == 0, F.array(F.lit("Fatal STROKE"), F.lit("rash"), F.lit("death"))).when(both % 15 == 5, F.array(F.lit("rash"), F.lit("mild bleeding"))).otherwise(F.array(F.lit("rash"), F.lit("itch")))
    events = edges.where(both % 5 == 0).select("lo", "hi", words.alias("events")).distinct()
    return V.repaired_source(edges, drugs, events, "second", "good", "listed").drop("flagged")
