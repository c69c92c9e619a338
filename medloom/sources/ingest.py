"""One job for each dataset: from the columns that its files have to node and edge rows, set by set.

A job first cleans and resolves names (known names to entities, by key, then without salts), then aggregates to one row an
edge, in an order given by `seq`; who wins between loads is the upsert's choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medloom.functions import scoring as S
from medloom.functions import text as T
from medloom.operators import merge as M
from medloom.operators import resolve as R
from medloom.operators.rules import naming
from medloom.sources.files import bucketed

# MedDRA's word for a preferred term, and the rows that one task looks for distinct ones among.
PREFERRED, ROWS = "PT", 200_000


def _resolved(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    return R.two_tier(rows.withColumn(column, T.clean(F.col(column))), column, known).drop(column).withColumnRenamed("entity", column)


def _ordered(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs as (lo, hi) without self pairs and without rows that lack a name."""
    df = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.lower(a) != F.lower(b)))
    return df.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)}).drop(a, b)


def pair_interactions(rows: DataFrame, known: DataFrame) -> DataFrame:
    """drug_a, drug_b, level, mechanism, management, seq -> lo, hi, severity, mechanism, management, source: first values win."""
    rows = rows.withColumns({c: T.clean(F.col(c)) for c in ("level", "mechanism", "management")})
    pairs = _ordered(_resolved(_resolved(rows, "drug_a", known), "drug_b", known), "drug_a", "drug_b")
    first = M.first_values(pairs, ["lo", "hi"], ["level", "mechanism", "management"], F.col("seq"))
    return first.withColumn("severity", S.severity_or_unknown(F.col("level"))).drop("level").withColumn("source", F.lit("pair_table"))


def food_and_herb(rows: DataFrame) -> DataFrame:
    """drug, herb, kind, effect, evidence, seq -> one row a (herb, drug): worst severity, best evidence, four mechanisms at most.

    Rows whose effect says that there is none go.
    """
    rows = rows.withColumns({c: T.clean(F.col(c), no_value=True) for c in ("drug", "herb", "kind", "effect", "evidence")})
    rows = rows.where("drug is not null and herb is not null").where(~F.coalesce(F.lower("effect").startswith("no effect"), F.lit(False)))
    effect = F.lower(F.coalesce("effect", F.lit("")))
    severity = S.first_rule(
        (effect.rlike("contraindicat|severe|serious"), F.lit("major")), (effect.rlike("increas|decreas|alter"), F.lit("moderate")), default="minor"
    )
    rank = F.col("evidence_rank")
    rows = rows.withColumns({"rank": S.ranked(severity, S.SEVERITY_RANK, 1), "evidence_rank": S.ranked(F.col("evidence"), S.EVIDENCE_RANK, 0)})
    # one pass: each effect of a pair first, its place among the pair's effects (none last), then the pair
    effects = rows.groupBy("herb", "drug", "effect").agg(
        F.min("seq").alias("seq"), F.max("rank").alias("rank"), F.max(F.struct(rank, -F.col("seq"))).alias("best"), F.count("*").alias("n")
    )
    at = F.row_number().over(W.partitionBy("herb", "drug").orderBy(F.col("effect").isNull(), "seq", "effect"))
    four = F.array_sort(F.collect_list(F.when((F.col("at") <= 4) & F.col("effect").isNotNull(), F.struct("at", "effect"))))
    return effects.withColumn("at", at).groupBy("herb", "drug").agg(
        F.max("rank").alias("severity_rank"), F.max("best.evidence_rank").alias("evidence_rank"), F.max_by("effect", "best").alias("effect"),
        F.array_join(F.transform(four, lambda m: m["effect"]), " | ").alias("mechanism"), F.sum("n").alias("n_studies"),
    )


def herb_nodes(rows: DataFrame) -> DataFrame:
    """name, scientific_name, category, seq -> herbs: first values; food and herb together are `food/herb`."""
    first = M.first_values(rows, ["name"], ["scientific_name"], F.col("seq"))
    kinds = rows.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set(F.lower("category"))), "/").alias("category"))
    return first.join(kinds, "name")


def knowledge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """relation, x_index, y_index and nodes (node_index, node_type, node_name) -> typed edges, the drug first.

    What an edge becomes depends on its relation and the types of its ends, in either direction.
    """
    end = lambda c: nodes.select(F.col("node_index").alias(f"{c}_index"), F.lower("node_type").alias(f"{c}_type"), F.col("node_name").alias(c))
    df = edges.join(end("x"), "x_index").join(end("y"), "y_index")
    turn = (F.col("y_type") == "drug") & (F.col("x_type") != "drug")
    df = df.select(
        F.lower("relation").alias("relation"), F.when(turn, F.col("y")).otherwise(F.col("x")).alias("src"), F.when(turn, F.col("x")).otherwise(F.col("y")).alias("dst"),
        F.when(turn, F.col("y_type")).otherwise(F.col("x_type")).alias("src_type"), F.when(turn, F.col("x_type")).otherwise(F.col("y_type")).alias("dst_type"),
    )
    both = (F.col("src_type") == "drug") & (F.col("dst_type") == "drug")
    kind = S.first_rule(
        (both, F.lit("INTERACTS_WITH")), (F.col("dst_type") == "disease", F.upper("relation")), (F.col("dst_type") == "effect/phenotype", F.lit("MAY_CAUSE")),
        (F.col("relation").contains("target"), F.lit("TARGETS")), (F.col("relation").contains("enzyme"), F.lit("METABOLIZED_BY")),
        (F.col("relation").contains("transporter"), F.lit("TRANSPORTED_BY")), (F.col("relation").contains("carrier"), F.lit("CARRIED_BY")),
    )
    df = df.where("src_type = 'drug' and src <> dst").withColumn("kind", T.relation_name(kind)).where("kind is not null")
    pair = F.col("kind") == "INTERACTS_WITH"
    return df.select("kind", F.when(pair, F.least("src", "dst")).otherwise(F.col("src")).alias("src"), F.when(pair, F.greatest("src", "dst")).otherwise(F.col("dst")).alias("dst")).distinct()


def open_graph(document: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A document of nodes{kind, identifier, name, data} and edges{source_id, target_id, kind, direction, data} as tables.

    Kinds become labels and relation names; data become properties with the prefix `meta_`.
    """
    prefixed = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: F.concat(F.lit("meta_"), T.slug(k)))
    nodes = document.select(F.inline("nodes")).select(
        T.relation_name(F.col("kind")).alias("label"), F.col("identifier").cast("string").alias("identifier"), "name", prefixed(F.col("data")).alias("props"))
    edges = document.select(F.inline("edges")).select(
        F.element_at("source_id", 2).alias("src"), F.element_at("target_id", 2).alias("dst"), T.relation_name(F.col("kind")).alias("rel_type"), "direction",
        prefixed(F.col("data")).alias("props"))
    return nodes, edges


def co_prescriptions(rows: DataFrame, known: DataFrame, most: int = 50) -> DataFrame:
    """drug_1, drug_2, event, prr -> lo, hi, adverse_events (by highest PRR), max_prr, num_events, events_truncated; known drugs only."""
    names = known.groupBy("key").agg(F.min("entity").alias("entity"))
    one = lambda c: names.select(F.col("key").alias(f"k_{c}"), F.col("entity").alias(f"e_{c}"))
    df = rows.withColumns({"k_a": T.lookup_key(F.col("drug_1")), "k_b": T.lookup_key(F.col("drug_2")), "event": T.clean(F.col("event")), "prr": F.col("prr").try_cast("double")})
    df = df.join(one("a"), "k_a").join(one("b"), "k_b").where("event is not null and prr is not null")
    ranked = M.ranked_list(_ordered(df.select("e_a", "e_b", "event", "prr"), "e_a", "e_b"), ["lo", "hi"], "event", "prr", most)
    return ranked.select("lo", "hi", F.col("values").alias("adverse_events"), F.col("top_score").alias("max_prr"), F.col("many").alias("num_events"), F.col("truncated").alias("events_truncated"))


def label_effects(effects: DataFrame, sure: DataFrame, labels: DataFrame, products: DataFrame, drugs: DataFrame, terms: DataFrame) -> DataFrame:
    """Effects of labels (label_id, effect_id) over label -> product -> ingredients, with the sure ones (ingredient_id,
    effect_id): one row a (drug, effect), `high_confidence` before `label_derived`."""
    # labels of a product share its ingredients, so an effect is carried once for each product
    by_product = effects.join(labels, "label_id").select("product_id", "effect_id").distinct()
    by_label = by_product.join(products, "product_id").select("ingredient_id", "effect_id", F.lit(2).alias("rank"))
    every = by_label.unionByName(sure.select("ingredient_id", "effect_id", F.lit(1).alias("rank")))
    best = every.groupBy("ingredient_id", "effect_id").agg(F.min("rank").alias("rank"))
    named = best.join(drugs, "ingredient_id").join(terms, "effect_id")
    return named.select("drug", "effect", F.when(F.col("rank") == 1, "high_confidence").otherwise("label_derived").alias("confidence"))


def effect_frequencies(effects: DataFrame, frequencies: DataFrame, compounds: DataFrame) -> DataFrame:
    """flat, stereo, kind, effect and flat, effect, frequency -> drug, effect, share, band: by the flat id, else the stereo id."""
    kept = effects.where(F.upper("kind") == PREFERRED).withColumn("effect", T.clean(F.col("effect")))
    share = F.max(F.regexp_replace("frequency", "%", "").try_cast("double") / F.when(F.col("frequency").endswith("%"), 100.0).otherwise(1.0))
    known = frequencies.groupBy(F.col("flat").alias("code"), T.clean(F.col("effect")).alias("effect")).agg(share.alias("share"))
    by = lambda c: known.select(F.col("code").alias(c), "effect", F.col("share").alias(f"by_{c}"))
    df = kept.join(by("flat"), ["flat", "effect"], "left").join(by("stereo"), ["stereo", "effect"], "left")
    df = df.withColumns({"share": F.coalesce("by_flat", "by_stereo"), "compound": T.compound_id(F.col("flat"))}).join(compounds, "compound")
    best = df.groupBy("drug", "effect").agg(F.max("share").alias("share"))
    return best.withColumn("band", S.frequency_band(F.col("share")))


def brand_products(rows: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """name, manufacturer, pack, composition, seq -> brands and their (brand, ingredient) edges.

    First manufacturer and form, longest composition, all ingredients; overrides (key, entity) rename ingredients.
    """
    df = rows.withColumns({c: T.clean(F.col(c), no_value=True) for c in ("name", "manufacturer", "pack", "composition")}).where("name is not null")
    df = df.withColumn("form", T.dosage_form(F.col("name"), F.col("pack")))
    longest = F.max_by("composition", F.struct(F.length("composition"), -F.col("seq"))).alias("composition")
    brands = M.first_values(df, ["name"], ["manufacturer", "form"], F.col("seq")).join(df.groupBy("name").agg(longest), "name", "left")
    parts = df.select(F.col("name").alias("brand"), F.explode(T.composition(F.lower("composition"))).alias("ingredient")).distinct()
    return brands, R.two_tier(parts, "ingredient", overrides).select("brand", F.col("entity").alias("ingredient")).distinct()


def registered_products(document: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A registry's results[] -> products (ndc, brand_name, labeler, route, form) and their (ndc, ingredient) edges."""
    rows = document.select(F.inline("results")).where("product_ndc is not null")
    products = rows.select(
        F.col("product_ndc").alias("ndc"), "brand_name", F.col("labeler_name").alias("labeler"), F.array_join("route", ", ").alias("route"), F.lower("dosage_form").alias("form"))
    names = F.transform("active_ingredients", lambda i: F.trim(F.regexp_replace(F.lower(i["name"]), r"\([^)]*\)|[*]", "")))
    edges = rows.select(F.col("product_ndc").alias("ndc"), F.explode(F.array_distinct(names)).alias("ingredient")).where("ingredient <> ''")
    return products.dropDuplicates(["ndc"]), edges.distinct()


def enzyme_roles(document: DataFrame) -> DataFrame:
    """enzymes[] with maps of substrates, inhibitors and inducers -> drug, enzyme, relation, band; first of equal keys."""
    rows = document.select(F.inline("enzymes"))
    roles = {"IS_SUBSTRATE_OF": "substrates", "INHIBITS": "inhibitors", "INDUCES": "inducers"}
    parts = [bucketed(rows, F.col("name"), F.col(c)).withColumn("relation", F.lit(r)) for r, c in roles.items()]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rank = F.coalesce(F.array_position(F.array(*[F.lit(b) for b in ("major", "strong", "moderate", "minor", "weak")]), F.col("bucket")), F.lit(9))
    best = every.groupBy(F.lower("name").alias("drug"), F.col("key").alias("enzyme"), "relation").agg(F.min_by("bucket", F.struct(rank, "bucket")).alias("band"))
    return best


def gene_bridge(targets: DataFrame, genes: DataFrame) -> DataFrame:
    """Curated targets (target, aliases) to genes (gene, gene_id) by alias; keyed on both, so two targets may share a gene."""
    alias = targets.select("target", F.explode("aliases").alias("alias")).withColumn("key", T.lookup_key(F.col("alias")))
    found = alias.join(genes.withColumn("key", T.lookup_key(F.col("gene"))), "key")
    return found.groupBy("target", "gene_id").agg(F.min("alias").alias("matched_alias"))


def herb_rules(herbs: DataFrame, drugs: DataFrame) -> DataFrame:
    """herb, term, severity against drugs (drug, class): by the whole name inside the term, else by the class inside it."""
    keyed = herbs.withColumn("t", T.lookup_key(F.col("term")))
    known = drugs.select("drug", T.lookup_key(F.col("drug")).alias("n"), T.lookup_key(F.col("class")).alias("c"))
    by_name = naming(keyed, "t", known.select("n"), "n").join(known, "n").select("t", "drug")
    by_class = naming(keyed, "t", known.select("c"), "c", least=1).join(known, "c").select("t", "drug")
    met = by_name.union(by_class).distinct()
    # dealt by how many rows there are, so that what finds the distinct ones does not grow with the herbs of a file
    each = keyed.groupBy("t").agg(F.count("*").alias("herbs")).join(met.groupBy("t").agg(F.count("*").alias("drugs")), "t")
    rows = each.agg(F.sum(F.col("herbs") * F.col("drugs"))).first()[0] or 0
    return keyed.join(met, "t").select("herb", "drug", "severity").repartition(1 + rows // ROWS, "herb", "drug").distinct()


def criteria_pairs(document: DataFrame) -> DataFrame:
    """table5[] of drug_names_1 x drug_names_2 -> lo, hi, risk, recommendation; the first row of a pair counts."""
    rows = document.select(F.posexplode("table5").alias("seq", "r")).select("seq", "r.*")
    pairs = rows.select("seq", "risk", "recommendation", F.explode("drug_names_1").alias("a"), "drug_names_2")
    pairs = pairs.select("seq", "risk", "recommendation", F.lower("a").alias("a"), F.explode("drug_names_2").alias("b")).withColumn("b", F.lower("b"))
    pairs = _ordered(pairs, "a", "b")
    return M.first_values(pairs, ["lo", "hi"], ["risk", "recommendation"], F.col("seq"))


def last_rows(rows: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """One row a key, the last by seq."""
    order = W.partitionBy(*keys).orderBy(seq.desc())
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def class_backfill(drugs: DataFrame, brands: DataFrame) -> DataFrame:
    """drug, class and (brand, drug): empty classes filled from the name's ending, with how many brands hold the drug."""
    counts = brands.groupBy("drug").agg(F.countDistinct("brand").alias("n_brands"))
    filled = F.coalesce(F.when(F.col("class") != "", F.col("class")), T.class_by_suffix(F.col("drug")))
    return drugs.withColumn("class", filled).join(counts, "drug", "left").fillna(0, ["n_brands"])
