"""Names to entities through tiers: the first tier that knows a name decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medloom.functions import text
from medloom.operators import fulltext
from medloom.operators.fuzzy import fuzzy_keys, prefix_pairs
from medloom.sources.shared import stored

# What a match of each tier is worth.
CONFIDENCE = {"exact": 1.0, "synonym": 0.98, "brand": 0.93, "stripped": 0.9, "fuzzy": 0.82, "none": 0.0}


def cascade(names: DataFrame, name: str, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """Names with `entity` and `match_type`; a tier is (key, entity) and serves only names that earlier ones left open.

    Of several entities under a key the smallest is taken; names that no tier knows are returned with `none`.
    """
    todo, done = names.withColumn("key", text.lookup_key(F.col(name))), []
    for kind, table in tiers:
        one = table.groupBy("key").agg(F.min("entity").alias("entity"))
        # names compress so well that millions of them are taken for few bytes: they are merged, not sent whole through the driver
        met = todo.join(one.hint("merge"), "key", "left")
        done.append(met.where("entity is not null").withColumn("match_type", F.lit(kind)))
        todo = met.where("entity is null").drop("entity")
    done.append(todo.withColumns({"entity": F.lit(None).cast("string"), "match_type": F.lit("none")}))
    every = reduce(DataFrame.unionByName, done)
    worth = F.create_map(*[F.lit(x) for item in CONFIDENCE.items() for x in item])
    return every.withColumn("confidence", F.coalesce(F.element_at(worth, F.col("match_type")), F.lit(0.5)))


# A brand counts from this score, and what scores make of a confidence: base, divisor, most.
BRAND_GATE, BRAND_SCORE, FUZZY_SCORE, SUGGESTED = 1.0, (0.55, 20.0, 0.93), (0.35, 10.0, 0.82), 0.80
#: Equal keys have this score in the fuzzy tier; it falls in proportion to the edits.
FUZZY_FULL = 5.0


def _by_score(score: Column, rule: tuple[float, float, float]) -> Column:
    base, divisor, most = rule
    return F.round(F.least(F.lit(most), base + score / divisor), 4)


def drug_cascade(names: DataFrame, name: str, drugs: DataFrame, synonyms: DataFrame, brands: DataFrame, suggested: DataFrame | None = None) -> DataFrame:
    """Names with entity, match_type, confidence: a drug's own name, a synonym, the best brand by relevance search, the closest
    name of a drug, a suggestion from outside; what a tier decides does not reach the next one.

    drugs, synonyms, suggested: key, entity; brands: brand, entity (each brand's ingredients, of which the smallest known one counts).
    Brands need a score above BRAND_GATE; confidences of brands and close names grow with their scores. Blank and unknown
    names are returned with `none`.
    """
    done = cascade(names, name, [("exact", drugs), ("synonym", synonyms)])
    todo = stored(done.where("entity is null and key <> ''").select("key", F.col(name).alias("_raw")).distinct(), "cascade-open")

    known = drugs.select("entity").distinct()
    inside = brands.join(known.hint("merge"), "entity", "left_semi").groupBy("brand").agg(F.min("entity").alias("entity"))
    index = fulltext.build(brands.select("brand"), "brand")
    top = fulltext.search(index, todo.select("_raw"), "_raw", most=1, gate=BRAND_GATE).join(inside.withColumnRenamed("brand", "name").hint("merge"), "name")
    by_brand = todo.join(top.hint("merge"), "_raw").groupBy("key").agg(F.max(F.struct("score", "entity")).alias("b")).select("key", F.col("b.entity").alias("e1"), _by_score(F.col("b.score"), BRAND_SCORE).alias("c1"))
    by_brand = stored(by_brand, "cascade-brands")

    rest = todo.join(by_brand.hint("merge"), "key", "left_anti").select("key").distinct()
    pairs = fuzzy_keys(rest, drugs.select("key"))
    close = FUZZY_FULL * (1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")))
    best = pairs.groupBy("a").agg(F.min(F.struct((-close).alias("away"), "b")).alias("first"))
    best = best.select(F.col("a").alias("key"), F.col("first.b").alias("to"), (-F.col("first.away")).alias("score"))
    one = drugs.groupBy(F.col("key").alias("to")).agg(F.min("entity").alias("e2"))
    by_name = best.join(one.hint("merge"), "to").select("key", "e2", _by_score(F.col("score"), FUZZY_SCORE).alias("c2"))

    rows = done.join(by_brand.hint("merge"), "key", "left").join(by_name.hint("merge"), "key", "left")
    if suggested is not None:
        rows = rows.join(suggested.groupBy("key").agg(F.min("entity").alias("e3")).hint("merge"), "key", "left")
    else:
        rows = rows.withColumn("e3", F.lit(None).cast("string"))
    late = F.when(F.col("e1").isNotNull(), "brand").when(F.col("e2").isNotNull(), "fuzzy").when(F.col("e3").isNotNull(), "suggested").otherwise("none")
    sure = F.coalesce("c1", "c2", F.when(F.col("e3").isNotNull(), SUGGESTED).otherwise(0.0))
    known_already = F.col("entity").isNotNull()
    out = {"match_type": F.when(known_already, F.col("match_type")).otherwise(late), "confidence": F.when(known_already, F.col("confidence")).otherwise(sure), "entity": F.coalesce("entity", "e1", "e2", "e3")}
    return rows.withColumns(out).drop("key", "e1", "c1", "e2", "c2", "e3")


def two_tier(rows: DataFrame, name: str, table: DataFrame) -> DataFrame:
    """Rows with `entity`: by the exact key, else by the key without salts, else the name in title case."""
    one = table.groupBy("key").agg(F.min("entity").alias("entity"))
    exact = one.select(F.col("key").alias("k1"), F.col("entity").alias("e1"))
    bare = one.select(F.col("key").alias("k2"), F.col("entity").alias("e2"))
    df = rows.withColumns({"k1": text.lookup_key(F.col(name)), "k2": text.without_words(F.col(name))})
    df = df.join(exact, "k1", "left").join(bare, "k2", "left")
    return df.withColumn("entity", F.coalesce("e1", "e2", text.smart_title(F.col(name)))).drop("k1", "k2", "e1", "e2")


def search(queries: DataFrame, query: str, names: DataFrame, name: str, most: int = 5) -> DataFrame:
    """Ranked candidates for each query: exact variants first, then by the share of the query's tokens that a name has.

    Queries and names meet on tokens (an inverted index), never pair by pair.
    """
    tokens = lambda c: F.explode(F.array_distinct(F.filter(F.split(text.brand_text(c), " "), lambda w: w != "")))
    wanted = queries.select(query, F.size(F.array_distinct(F.split(text.brand_text(F.col(query)), " "))).alias("n"), tokens(F.col(query)).alias("token"))
    index = names.select(name).distinct().select(name, tokens(F.col(name)).alias("token"))
    hits = wanted.join(index, "token").groupBy(query, name, "n").agg(F.count("*").alias("hits"))
    exact = F.arrays_overlap(text.brand_variants(F.col(query)), text.brand_variants(F.col(name)))
    scored = hits.select(query, name, exact.alias("exact"), F.round(F.col("hits") / F.col("n"), 4).alias("score"))
    order = W.partitionBy(query).orderBy(F.col("exact").desc(), F.col("score").desc(), F.col(name))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def family_generic(brands: DataFrame, brand: str, known: DataFrame) -> DataFrame:
    """Brands with the generic of known brands (brand_key, generic) of which one begins with the other, where it is the only one."""
    keyed = brands.select(brand, text.lookup_key(F.col(brand)).alias("_key")).distinct()
    pairs = prefix_pairs(keyed.select("_key"), known.select("brand_key")).toDF("_key", "_known")
    hits = keyed.join(pairs, "_key").join(known.select(F.col("brand_key").alias("_known"), "generic").distinct(), "_known")
    one = hits.groupBy(brand).agg(F.min("generic").alias("generic"), F.countDistinct("generic").alias("n")).where("n = 1")
    return brands.join(one.select(brand, "generic"), brand, "left")


def plausible(raw: Column, resolved: Column) -> Column:
    """Whether a resolved name shares a token of three letters or more with what was read."""
    words = lambda c: F.filter(F.split(text.lookup_key(c), " "), lambda w: F.length(w) >= 3)
    return F.arrays_overlap(words(raw), words(resolved))


# What a match of each herb tier is worth.
HERB_CONFIDENCE = {"exact": 1.0, "regional": 0.97, "scientific": 0.9, "fuzzy": 0.72, "none": 0.0}


def herb_cascade(names: DataFrame, name: str, herbs: DataFrame, regional: list[str]) -> DataFrame:
    """Names with `entity`, `match_type`, `confidence`: the herb's own name, a regional name, a part of a scientific name
    that begins a word, or a name with the same first four letters; of several herbs the smallest.

    `herbs`: entity, scientific and the regional columns. All tiers are joins on keys; the scientific one meets on a
    query's first word. Names that no tier knows are returned with `none`.
    """
    key = text.lookup_key
    own = herbs.select(key(F.col("entity")).alias("key"), "entity")
    local = herbs.select(F.explode(F.array(*regional)).alias("raw"), "entity").select(key(F.col("raw")).alias("key"), "entity")
    done = cascade(names, name, [("exact", own), ("regional", local)]).drop("confidence")
    todo = done.where("entity is null").drop("entity", "match_type")
    keys = todo.select("key").distinct().where("key <> ''")
    words = herbs.select(key(F.col("scientific")).alias("science"), "entity").withColumn("first", F.explode(F.array_distinct(F.split("science", " "))))
    begun = keys.withColumn("first", F.split("key", " ")[0]).join(words, "first")
    science = begun.where(F.concat(F.lit(" "), "science").contains(F.concat(F.lit(" "), "key"))).groupBy("key").agg(F.min("entity").alias("by_science"))
    heads = own.where(F.length("key") >= 4).groupBy(F.substring("key", 1, 4).alias("head")).agg(F.min("entity").alias("by_head"))
    late = todo.join(science, "key", "left").withColumn("head", F.when(F.length("key") >= 4, F.substring("key", 1, 4))).join(heads, "head", "left")
    kind = F.when(F.col("by_science").isNotNull(), "scientific").when(F.col("by_head").isNotNull(), "fuzzy").otherwise("none")
    late = late.withColumns({"match_type": kind, "entity": F.coalesce("by_science", "by_head")}).drop("by_science", "by_head", "head")
    worth = F.create_map(*[F.lit(x) for item in HERB_CONFIDENCE.items() for x in item])
    every = done.where("entity is not null").unionByName(late)
    return every.withColumn("confidence", F.element_at(worth, F.col("match_type"))).drop("key")


def combo_members(rows: DataFrame, raw: str, known: DataFrame) -> DataFrame:
    """Rows with `members`: the sorted distinct entities of a combination's parts (split at + / and comma); a part that the
    table (key, entity) does not know stands for itself, in its cleaned form."""
    parts = rows.select(raw).distinct().select(raw, F.explode(F.split(raw, "[+/,]")).alias("part")).select(raw, text.lookup_key(F.col("part")).alias("key"))
    one = known.groupBy("key").agg(F.min("entity").alias("entity"))
    found = parts.where("key <> ''").join(one, "key", "left").groupBy(raw).agg(F.array_sort(F.collect_set(F.coalesce("entity", "key"))).alias("members"))
    return rows.join(found, raw, "left").withColumn("members", F.coalesce("members", F.array().cast("array<string>")))
