"""Text rules as column expressions: cleaning, lookup keys, brand variants, references, extraction.

No pattern looks around, so that other engines can run the same rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from medloom.functions.scoring import first_rule

# Tokens that mean "no value", salts and forms that a lookup ignores, dosage forms and units of strength,
# suffixes and names that give a drug's class, and blocks of scripts.
NO_VALUE = ("na", "n/a", "none", "null", "nan", "-")
#: Of pair tables, of side-effect tables and of criteria; a lookup takes the first unless told otherwise.
SALTS = ("hydrochloride", "hcl", "sodium", "potassium", "succinate", "tartrate", "phosphate", "acetate", "maleate", "sulfate", "calcium", "magnesium")
SALTS_OF_EFFECTS = (
    "hydrochloride", "hcl", "sodium", "potassium", "calcium", "magnesium", "succinate", "tartrate", "phosphate", "acetate", "maleate", "sulfate",
    "citrate", "acid",
)
SALTS_OF_CRITERIA = (
    "hydrochloride", "hcl", "sodium", "potassium", "succinate", "tartrate", "phosphate", "medoxomil", "dipropionate", "acetate", "maleate", "sulfate",
)
FORMS = ("tablet", "tablets", "capsule", "capsules", "syrup", "suspension", "drops", "drop", "injection", "cream", "ointment", "gel")
DOSAGE_WORDS = (
    "tablet", "capsule", "syrup", "solution", "suspension", "cream", "gel", "ointment", "patch", "injection", "pack", "kit",
    "oral", "topical", "nasal", "rectal", "mg", "mcg", "ml", "iu", "meq", "%",
)
CLASS_SUFFIXES = {
    "statin": "statin", "ppi": "prazole", "ace inhibitor": "pril", "arb": "sartan", "beta blocker": "olol", "ccb": "dipine",
    "dpp-4 inhibitor": "gliptin", "sglt2 inhibitor": "gliflozin",
}
CLASS_MEMBERS = (
    ("biguanide", ("metformin",)), ("sulfonylurea", ("glimepiride", "gliclazide", "glipizide", "glyburide", "glibenclamide")),
    ("antiplatelet", ("aspirin", "clopidogrel", "prasugrel", "ticagrelor", "cilostazol", "dipyridamole")),
    ("anticoagulant", ("warfarin", "dabigatran", "rivaroxaban", "apixaban", "edoxaban", "betrixaban")),
    ("loop diuretic", ("furosemide", "torsemide", "bumetanide")),
    ("diuretic", ("hydrochlorothiazide", "chlorthalidone", "indapamide", "amiloride", "triamterene", "spironolactone")),
    ("ccb", ("diltiazem", "verapamil")), ("h2 blocker", ("cimetidine", "famotidine", "nizatidine", "ranitidine")),
    ("thyroid", ("levothyroxine", "liothyronine")), ("bronchodilator", ("theophylline", "tiotropium", "ipratropium", "albuterol", "levalbuterol")),
    ("cox-2 inhibitor", ("celecoxib", "etoricoxib")), ("bph", ("tamsulosin", "silodosin", "alfuzosin")),
    ("5-alpha reductase inhibitor", ("finasteride", "dutasteride")), ("laxative", ("lactulose", "bisacodyl", "psyllium", "polyethylene glycol", "senna")),
)
SCRIPTS = {"ta": r"[\x{0B80}-\x{0BFF}]", "te": r"[\x{0C00}-\x{0C7F}]", "kn": r"[\x{0C80}-\x{0CFF}]", "hi": r"[\x{0900}-\x{097F}]"}


def _blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is computed once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def clean(text: Column, no_value: bool = False) -> Column:
    """NUL and no-break spaces as spaces, white space collapsed, empty as null; no_value: tokens such as `n/a` too."""
    plain = squeeze(F.translate(text, "\x00 ", "  "))
    return _once(plain, lambda p: F.when((p != "") & ~F.lower(p).isin(list(NO_VALUE)), p)) if no_value else _blank_to_null(plain)


def lookup_key(text: Column) -> Column:
    """Lower case, everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def without_words(text: Column, words: tuple[str, ...] = SALTS) -> Column:
    """A lookup key without some words (salts by default); a name made of such words only stays whole."""
    bare = F.array_join(F.filter(F.split(lookup_key(text), " "), lambda w: ~w.isin(list(words))), " ")
    return F.when(bare == "", lookup_key(text)).otherwise(bare)


def smart_title(text: Column) -> Column:
    """Words that are all lower case get a capital; others stay."""
    word = lambda w: F.when(w == F.lower(w), F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))).otherwise(w)
    return F.array_join(F.transform(F.split(text, " "), word), " ")


def brand_text(text: Column) -> Column:
    """Brand text with camel case and runs of letters and digits taken apart, lower case, signs as spaces."""
    apart = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    apart = F.regexp_replace(F.lower(apart), "([a-z])([0-9])", "$1 $2")
    return lookup_key(F.regexp_replace(apart, "([0-9])([a-z])", "$1 $2"))


def brand_variants(text: Column) -> Column:
    """Distinct search variants of a brand in order: as it is, without forms, units joined, without units, words only,
    words then strengths, strengths then words. The text should be short, a name."""
    tokens = lambda t: F.filter(F.split(t, " "), lambda w: w != "")

    def with_forms(plain: Column) -> Column:
        no_forms = F.array_join(F.filter(tokens(plain), lambda w: ~w.isin(list(FORMS))), " ")
        return _once(no_forms, lambda bare: with_units(F.array(plain, bare), bare))

    def with_units(found: Column, bare: Column) -> Column:
        compact = F.replace(F.replace(bare, F.lit(" mg"), F.lit("mg")), F.lit(" mcg"), F.lit("mcg"))
        no_units = lambda c: squeeze(F.regexp_replace(c, "([0-9]) ?(mg|mcg|ml|gm|g|iu)( |$)", "$1 "))
        return _once(compact, lambda c: _once(no_units(c), lambda n: in_order(F.concat(found, F.array(c, n)), n)))

    def in_order(found: Column, no_units: Column) -> Column:
        words = F.array_join(F.filter(tokens(no_units), lambda w: ~w.rlike("[0-9]")), " ")
        strengths = F.array_join(F.filter(tokens(no_units), lambda w: w.rlike("[0-9]")), " ")
        joined = lambda a, b: F.when((a != "") & (b != ""), F.concat_ws(" ", a, b))
        return _once(words, lambda w: _once(strengths, lambda s: F.concat(found, F.array(w, joined(w, s), joined(s, w)))))

    every = _once(brand_text(text), with_forms)
    return F.array_distinct(F.filter(every, lambda v: F.coalesce(v, F.lit("")) != ""))


def split_keys(text: Column) -> Column:
    """Distinct trimmed parts of a list separated by commas or semicolons, in order."""
    parts = F.transform(F.split(text, "[;,]"), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def reference_url(reference: Column) -> Column:
    """A link for a reference: its URL, else its DOI, else its PubMed id, else a PubMed search."""
    text = F.trim(reference)
    url = F.rtrim(F.regexp_extract(text, r"(https?://[^ ]+)", 1), F.lit(").,;"))
    doi = F.rtrim(F.regexp_extract(text, r"(10\.[0-9]{4,9}/[^ ]+)", 1), F.lit(").,;"))
    pmid = F.regexp_extract(text, r"(?i)pmid:? *([0-9]+)", 1)
    search = F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/?term="), F.url_encode(text))
    return first_rule(
        (F.coalesce(text, F.lit("")) == "", None), (url != "", url), (doi != "", F.concat(F.lit("https://doi.org/"), doi)),
        (pmid != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))), (F.lit(True), search),
    )


def dosage_form(*texts: Column) -> Column:
    """The first dosage form named, in the order of FORMS, in the first text that names one."""
    found = [F.when(F.lower(t).contains(form), form) for t in texts for form in ("tablet", "capsule", "syrup", "suspension", "drops", "injection", "cream", "ointment", "gel")]
    return F.coalesce(*found)


def class_by_suffix(name: Column) -> Column:
    """A drug class from the whole name where its family is listed, else from the ending of the name."""
    key = lookup_key(name)
    exact = [(key.isin(*names), F.lit(kind)) for kind, names in CLASS_MEMBERS]
    return first_rule(*exact, *[(key.endswith(end), F.lit(kind)) for kind, end in CLASS_SUFFIXES.items()])


def script_language(text: Column) -> Column:
    """A language by the first script found; `en` where there is none."""
    return first_rule(*[(text.rlike(block), F.lit(lang)) for lang, block in SCRIPTS.items()], default="en")


def doses(text: Column) -> Column:
    """Amounts with a unit, lower-cased and without spaces, distinct, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+(?:\.[0-9]+)? ?(?:mg|mcg|ml|g|iu))(?:[^a-z0-9]|$)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda d: F.replace(d, F.lit(" "), F.lit(""))))


def composition(text: Column) -> Column:
    """Ingredient names of a composition joined by `+`, without what stands in parentheses."""
    parts = F.split(text, r"\s*\+\s*")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: squeeze(F.regexp_replace(p, r"\([^)]*\)", " "))), lambda p: p != ""))


def evidence_text(*parts: Column) -> Column:
    """Non-blank parts joined by spaces, each once regardless of case."""
    some = F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: F.coalesce(p, F.lit("")) != "")
    first = lambda p, i: ~F.exists(F.slice(some, F.lit(1), i), lambda q: F.lower(q) == F.lower(p))
    return F.array_join(F.filter(some, first), " ")


def locator(*parts: Column) -> Column:
    """Non-blank parts joined by ` | `."""
    return F.concat_ws(" | ", *[_blank_to_null(F.trim(p)) for p in parts])


def truncated(text: Column, most: int = 1000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def relation_name(text: Column) -> Column:
    """A relation type: upper case, signs as underscores."""
    return F.trim(F.regexp_replace(F.upper(F.trim(text)), "[^A-Z0-9]+", "_"), F.lit("_"))


def compound_id(code: Column) -> Column:
    """The number in a compound code of a prefix of four characters; null where there is none."""
    return F.substring(code, 5, 20).try_cast("int")


def key_words(key: Column) -> Column:
    """The distinct words of a lookup key."""
    return F.array_distinct(F.filter(F.split(key, " "), lambda w: w != ""))


def key_overlap(x: Column, y: Column) -> Column:
    """Jaccard similarity of the word sets of two lookup keys; 0 where both are empty."""
    union = F.size(F.array_union(key_words(x), key_words(y)))
    return F.when(union > 0, F.size(F.array_intersect(key_words(x), key_words(y))) / union).otherwise(0.0)


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the token sets of two texts; 0 where both are empty."""
    return key_overlap(lookup_key(a), lookup_key(b))


def close_keys(x: Column, y: Column, ratio: float) -> Column:
    """Whether two keys differ by few edits for the length of the longer one."""
    return 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)) >= ratio


def fuzzy_match(a: Column, b: Column, ratio: float = 0.9, overlap: float = 0.6) -> Column:
    """Whether two names may be one: equal keys, close by edit distance, overlapping tokens with the same start, or one
    contained in the other."""
    x, y = lookup_key(a), lookup_key(b)
    tokens = (key_overlap(x, y) >= overlap) & (F.substring(x, 1, 4) == F.substring(y, 1, 4))
    inside = (F.least(F.length(x), F.length(y)) >= 5) & (x.contains(y) | y.contains(x))
    return (x == y) | close_keys(x, y, ratio) | tokens | inside


def json_object(raw: Column, schema: str) -> Column:
    """The outermost JSON object of a text as a struct; null where there is none or it cannot be read."""
    return F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")), schema)


def safe_alias(raw: Column, canonical: Column, kind: Column) -> Column:
    """A cleaned alias if it names a substance alone: no slash, digit or dosage word; ingredients (IN, PIN) always count,
    brands (BN) only if they hold the canonical name; else null."""
    name, main = clean(raw), lookup_key(canonical)
    plain = ~name.contains("/") & ~name.rlike("[0-9]") & ~name.rlike(rf"(?i)\b({'|'.join(DOSAGE_WORDS)})\b")
    fits = kind.isin("IN", "PIN") | ((kind == "BN") & lookup_key(name).contains(main))
    return F.when(plain & (lookup_key(name) != "") & (main != "") & fits, name)


def flat_names(nested: Column) -> Column:
    """The distinct non-blank names of nested lists, cleaned and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten(nested), lambda x: clean(x)), lambda x: x.isNotNull())))
