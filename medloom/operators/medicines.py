"""Medicines from label text by ordered rules, and entries of several readings made one.

An entry is a row with brand_name, generic_name, ingredients (array of name, dose), dosage_form, confidence; after enrichment
also graph_match and match_type. Every rule is a column expression; tables meet on keys only. Groups of entries share a document,
so they are as small as what can be read on one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.functions import text

# Lines that are no brand, the composition sentence, a dose, an ingredient line and its marks, dosage forms,
# pharmacopoeias and forms that are no part of a name, words of packaging, and what a match type is worth.
NO_BRAND = r"(?i)^(composition|each .* contains|dosage|directions|warning|storage|schedule|manufactured|marketed)\b"
COMPOSITION = r"(?i)Each\s+(?:film[-\s]?coated\s+)?(?:tablet|capsule|ml)\s+contains?:?\s*(.+?)(?:\.|$)"
DOSE = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(mg|mcg|g|ml|iu)\b"
LINE = r"(?i)([0-9A-Za-z_][0-9A-Za-z_\s/+().-]+?)\s+([0-9]+(?:\.[0-9]+)?)\s*(mg|mcg|g|ml|IU)"
MARKS = (" ip ", " bp ", " usp ", "contains", "tablet", "capsule")
FORM = r"(?i)\b(tablet|capsule|syrup|suspension|injection|cream|ointment|gel|drops|spray|patch|sachet)\b"
STANDARD, PLAIN_FORM = r"(?i)\b(?:IP|BP|USP)\b", r"(?i)\b(?:tablets?|capsules?|syrup|suspension)\b"
PACKAGING = (
    "tablet", "tablets", "tab", "tabs", "capsule", "capsules", "cap", "caps", "strip", "strips", "pack", "packs", "blister", "blisters",
    "bottle", "bottles", "sachet", "sachets",
)
PACKAGING_ONLY = r"^(?:[0-9]+\s*)?(?:tablets?|tabs?|capsules?|caps?|strips?|packs?|blisters?|bottles?|sachets?)\b"
MATCH_WORTH = {
    "exact": 6, "synonym": 5, "brand": 5, "rxnorm_api": 4, "ingredient_resolved": 4, "fuzzy": 3, "resolve_drug": 3, "resolve_herb": 3, "ingredient_partial": 1,
}
#: Marks of a table's notes, and terms: capitalised words of three letters or more in a row.
FOOTNOTE, TERM = r"\([a-z, ]+\)", r"(\b[A-Z][a-zA-Z0-9.+/-]{2,}(?:\s+[A-Z][a-zA-Z0-9.+/-]{2,})*\b)"
INGREDIENTS = "array<struct<name:string,dose:string>>"


def _key(c: Column) -> Column:
    return F.lower(text.squeeze(F.coalesce(c, F.lit(""))))


def _dose_key(c: Column) -> Column:
    return F.replace(_key(c), F.lit(" "), F.lit(""))


# --- one text -------------------------------------------------------------------------------------------------------


def brand_line(t: Column) -> Column:
    """The first line of three letters or more that is no heading, squeezed; empty without one."""
    lines = F.transform(F.split(F.coalesce(t, F.lit("")), r"\R"), lambda x: F.btrim(text.squeeze(x), F.lit(" -:")))
    return F.coalesce(F.get(F.filter(lines, lambda x: (F.length(x) >= 3) & ~x.rlike(NO_BRAND)), F.lit(0)), F.lit(""))


def ingredient_name(raw: Column) -> Column:
    """What stands after the first `equivalent to`, without pharmacopoeias and forms."""
    trim = lambda c: F.btrim(text.squeeze(c), F.lit(" :-,"))
    after = F.regexp_replace(trim(raw), r"(?is)^.*?\bequivalent to\b", "")
    return trim(F.regexp_replace(F.regexp_replace(trim(after), STANDARD, ""), PLAIN_FORM, ""))


def stated(t: Column) -> Column:
    """The ingredients of the composition sentence, split at + and comma."""
    chunks = F.split(F.regexp_extract(F.coalesce(t, F.lit("")), COMPOSITION, 1), r"\s*\+\s*|,\s*")

    def one(chunk: Column) -> Column:
        amount, unit = F.regexp_extract(chunk, DOSE, 1), F.regexp_extract(chunk, DOSE, 2)
        before = F.regexp_replace(chunk, rf"(?s){DOSE}.*$", "")
        return F.struct(ingredient_name(before).alias("name"), F.concat(amount, unit).alias("dose"))

    return F.filter(F.transform(F.filter(F.transform(chunks, lambda c: F.trim(c)), lambda c: c != ""), one), lambda i: i["name"] != "")


def by_lines(t: Column, brand: Column) -> Column:
    """An ingredient for each line, other than the brand's, that bears a mark and a name with a dose."""
    lines = F.transform(F.split(F.coalesce(t, F.lit("")), r"\R"), lambda x: text.squeeze(x))
    marked = lambda x: F.array(*[F.lower(x).contains(m) for m in MARKS])
    eligible = F.filter(lines, lambda x: (x != "") & ~F.lower(x).startswith(F.lower(brand)) & F.exists(marked(x), lambda m: m) & x.rlike(LINE))
    one = lambda x: F.struct(ingredient_name(F.regexp_extract(x, LINE, 1)).alias("name"), F.concat(F.regexp_extract(x, LINE, 2), F.regexp_extract(x, LINE, 3)).alias("dose"))
    return F.filter(F.transform(eligible, one), lambda i: i["name"] != "")


def extracted(rows: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The kept columns with brand_name, generic_name, ingredients, dosage_form and confidence, for texts that name an ingredient.

    The composition sentence decides; lines are read only where it gives nothing. A brand of no letters makes every line the
    brand's own, so nothing is read by lines then. Null texts give no row.
    """
    t = F.col(text_col)
    df = rows.select(*keep, t.alias("_t"), brand_line(t).alias("brand_name"), stated(t).alias("_s"))
    df = df.withColumn("ingredients", F.when(F.size("_s") > 0, F.col("_s")).otherwise(by_lines(F.col("_t"), F.col("brand_name")))).where(F.size("ingredients") > 0)
    generic = F.array_join(F.transform("ingredients", lambda i: i["name"]), " + ")
    return df.select(
        *keep, "brand_name", generic.alias("generic_name"), "ingredients", F.lower(F.regexp_extract("_t", FORM, 1)).alias("dosage_form"),
        F.when(F.col("brand_name") != "", 0.72).otherwise(0.66).alias("confidence"),
    )


def candidate_names(raw: Column) -> Column:
    """Names to look up for a table's cell: without footnote marks, without and within parentheses, at slashes, without S- or R-."""
    cell = text.clean(raw)
    bare = F.btrim(F.regexp_replace(cell, FOOTNOTE, ""), F.lit(" ,;"))
    inner = F.regexp_extract_all(bare, F.lit(r"\(([^)]{2,})\)"), F.lit(1))
    parts = F.when(bare.contains("/"), F.split(bare, "/")).otherwise(F.array().cast("array<string>"))
    hand = F.when(F.lower(bare).rlike("^[sr]-.") , F.substring(bare, F.lit(3), F.length(bare)))
    every = F.concat(F.array(bare, F.regexp_replace(bare, r"\([^)]*\)", "")), inner, parts, F.array(hand))
    names = F.filter(F.transform(every, lambda n: text.clean(n)), lambda n: n.isNotNull() & (n != "-"))
    return F.when(F.coalesce(cell, F.lit("-")) == "-", F.array().cast("array<string>")).otherwise(F.array_distinct(names))


def medical_terms(t: Column, most: int = 4) -> Column:
    """The distinct terms of at most `most` words without a digit, in order."""
    found = F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(TERM), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike("[0-9]") & (F.size(F.split(x, r"\s+")) <= most)))


def brand_quality(brand: Column) -> Column:
    """How much a brand says: letters, digits and words count for it, words of packaging against it."""
    low = _key(brand)
    tokens = F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1))
    packing = lambda w: w.isin(*PACKAGING)
    telling = F.size(F.filter(tokens, lambda w: ~packing(w) & ~w.rlike("^[0-9]+$")))
    score = F.when(low.rlike("[a-z]"), 3).otherwise(0) + F.when(low.rlike("[0-9]"), 1).otherwise(0) + 2 * telling
    score = score - F.size(F.filter(tokens, packing)) - F.when(telling == 0, 4).otherwise(0)
    return F.when(low == "", -5).when(low.rlike(PACKAGING_ONLY), -8).otherwise(score)


# --- entries --------------------------------------------------------------------------------------------------------


def enriched(entries: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Entries with their ingredients looked up (known: key, entity, match_type), generic_name, graph_match and match_type.

    Known ingredients take the entity's name. An unknown one goes if a known one of the same entry has its dose (the same
    line read twice); of equal names and doses the first stays. The generic name is looked up itself first, else it is what
    the ingredients give. Of several entities for a key the smallest counts.
    """
    one = known.groupBy("key").agg(F.min(F.struct("entity", "match_type")).alias("hit"))
    flat = entries.select(key, F.posexplode("ingredients").alias("at", "i")).where(F.trim(F.coalesce("i.name", F.lit(""))) != "")
    flat = flat.withColumn("key", text.lookup_key(F.col("i.name"))).join(one, "key", "left")
    name, dose = F.coalesce("hit.entity", F.trim("i.name")), F.trim(F.coalesce("i.dose", F.lit("")))
    # nk and dk, by which ingredients are compared, are made once an ingredient
    item = F.struct(
        "at", name.alias("name"), dose.alias("dose"), F.col("hit").isNotNull().alias("met"), F.coalesce("hit.match_type", F.lit("not_found")).alias("match_type"),
        _key(name).alias("nk"), _dose_key(dose).alias("dk"),
    )
    lists = flat.select(key, item.alias("item")).groupBy(key).agg(F.array_sort(F.collect_list("item")).alias("all"))
    taken = F.transform(F.filter("all", lambda x: x["met"] & (x["dose"] != "")), lambda x: F.lower(x["dose"]))
    left = F.filter("all", lambda x: x["met"] | ~F.array_contains(taken, F.lower(x["dose"])))
    lists = lists.select(key, left.alias("all"))
    same = lambda x, y: (x["nk"] == y["nk"]) & (x["dk"] == y["dk"])
    first = F.filter("all", lambda x: ~F.exists("all", lambda y: (y["at"] < x["at"]) & same(x, y)))
    lists = lists.select(key, first.alias("_found"))

    none = F.array().cast("array<struct<at:int,name:string,dose:string,met:boolean,match_type:string,nk:string,dk:string>>")
    rows = entries.join(lists, key, "left").withColumn("_found", F.coalesce("_found", none))
    asked = rows.withColumn("key", text.lookup_key(F.coalesce("generic_name", F.lit(""))))
    rows = asked.join(one.withColumnRenamed("hit", "_g"), "key", "left").drop("key")
    every = F.forall("_found", lambda x: x["met"])
    some = F.size("_found") > 0
    names = F.array_join(F.array_distinct(F.transform("_found", lambda x: x["name"])), " + ")
    generic = F.when(F.col("_g").isNotNull(), F.col("_g.entity")).when(some, names).otherwise(F.trim(F.coalesce("generic_name", F.lit(""))))
    kind = F.when(F.col("_g").isNotNull(), F.col("_g.match_type")).when(some & every, "ingredient_resolved").when(some, "ingredient_partial").otherwise("not_found")
    out = {
        "generic_name": generic, "graph_match": F.col("_g").isNotNull() | (some & every), "match_type": kind,
        "ingredients": F.transform("_found", lambda x: F.struct(x["name"].alias("name"), x["dose"].alias("dose"))),
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)))),
    }
    return rows.withColumns(out).drop("_found", "_g")


def signature(ingredients: Column) -> Column:
    """The sorted distinct (name, dose) keys of ingredients as one text."""
    some = F.filter(F.transform(ingredients, lambda i: F.concat(_key(i["name"]), F.lit("|"), _dose_key(i["dose"]))), lambda s: s != "|")
    return F.array_join(F.array_sort(F.array_distinct(some)), "+")


def preference(entry: str, mark: Column, quality: Column) -> Column:
    """What makes one of several equal entries, of a signature and a brand's quality, the preferred one; of equal ones the first."""
    worth = F.create_map(*[F.lit(x) for item in MATCH_WORTH.items() for x in item])
    many = F.size(F.filter(F.split(mark, r"\+"), lambda s: s != ""))
    return F.struct(
        F.coalesce(F.col("graph_match"), F.lit(False)).cast("int").alias("p0"), F.coalesce(F.element_at(worth, _key(F.col("match_type"))), F.lit(0)).alias("p1"), many.alias("p2"),
        (_key(F.col("generic_name")) != "").cast("int").alias("p3"), quality.alias("p4"),
        F.coalesce("confidence", F.lit(0.0)).alias("p5"), F.length(F.trim(F.coalesce("brand_name", F.lit("")))).alias("p6"), (-F.col(entry)).alias("p7"),
    )


def deduped(entries: DataFrame, doc: str, entry: str = "entry") -> DataFrame:
    """One entry for each document and signature (generic name, ingredients, form): the preferred one, with the most telling
    brand, the highest confidence and the longest list of ingredients of all of them; `entry` is the smallest number."""
    own = entries.withColumns({"_m": signature(F.col("ingredients")), "_q": brand_quality(F.col("brand_name")), "_n": _key(F.col("generic_name"))})
    mark, name = F.col("_m"), F.col("_n")
    anchor = F.when(name != "", name).when(mark != "", mark).otherwise(_key(F.col("brand_name")))
    own = own.withColumns({"_a": anchor, "_f": _key(F.col("dosage_form")), "_p": preference(entry, mark, F.col("_q"))})
    take = lambda c: F.max_by(F.col(c), F.col("_p")).alias(c)
    brand = F.max_by("brand_name", F.struct("_q", "_p"))
    size = F.max_by("ingredients", F.struct(F.size("ingredients"), "_p"))
    best = own.groupBy(doc, "_a", "_m", "_f").agg(
        F.min(entry).alias(entry), brand.alias("brand_name"), take("generic_name"), size.alias("ingredients"), take("dosage_form"),
        F.max("confidence").alias("confidence"), F.max("graph_match").alias("graph_match"), take("match_type"), F.count("*").alias("readings"),
    )
    return best.drop("_a", "_m", "_f")


def merged(entries: DataFrame, doc: str, entry: str = "entry", parts: int | None = None) -> DataFrame:
    """One entry for each document and brand (or generic name where there is no brand): the first value of each column that is
    not blank, the highest confidence, and all distinct ingredients in order of first mention. `parts`: how many parts the groups
    are dealt to, for all steps."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    by = F.when(blank("brand_name") != "", F.concat(F.lit("b:"), F.lower(blank("brand_name")))).otherwise(F.concat(F.lit("g:"), F.lower(blank("generic_name"))))
    first = lambda c: F.min_by(c, F.when(blank(c) != "", F.col(entry))).alias(c)
    # a struct is never null itself, so groups without a document meet by plain equality
    groups = entries.withColumn("_g", F.struct(F.col(doc).alias("doc"), by.alias("k")))
    groups = groups.repartition(parts, "_g") if parts else groups
    heads = groups.groupBy("_g").agg(F.first(doc).alias(doc), F.min(entry).alias(entry), first("brand_name"), first("generic_name"), first("dosage_form"), F.max("confidence").alias("confidence"))
    items = groups.select("_g", entry, F.posexplode("ingredients").alias("at", "i"))
    pair = F.lower(F.coalesce("i.name", F.lit(""))), F.lower(F.coalesce("i.dose", F.lit("")))
    items = items.withColumns({"_n": pair[0], "_d": pair[1]}).where("_n <> '' or _d <> ''")
    items = items.groupBy("_g", "_n", "_d").agg(F.min(F.struct(entry, "at", "i")).alias("x"))
    lists = items.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["i"]).alias("ingredients"))
    rows = heads.join(lists, "_g", "left")
    return rows.select(doc, entry, "brand_name", "generic_name", F.coalesce("ingredients", F.array().cast(INGREDIENTS)).alias("ingredients"), "dosage_form", "confidence")
