"""Rule bitmask ledger: every quality rule is evaluated once, policies and ablations are bit operations.

The ledger holds, for each document, its measurements and a mask with one bit for each failed rule. A policy is a
named, versioned set of rules; applying it is one AND. Ablations group the masks first, so what they shuffle is at most
one row for each distinct mask and task, however many documents there are.

Cases: a null text counts as a text without words (all measurements 0, so it fails `few_words`); a null id stays null;
an empty table gives an empty ledger; repeated rows are measured independently; columns of the input are kept only
where asked for with `keep`, under their own names; a clash with the ledger's, or a leading underscore, raises an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.llm.common import SPACE, SPACES

# The counted symbols, and the capital letters of ASCII.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
LONG = "long"


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails` holds; `bit` is its place in the mask and never changes between versions."""

    bit: int
    name: str
    fails: str


#: The conditions are SQL over the measurements, in whole numbers, so that any engine decides them alike.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbol_share", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "shouting", "2 * n_capitals > word_chars"),
)

#: Versioned policies: a document stays if it fails none of the named rules.
POLICIES = {
    "base@1": ("few_words", "repeated_windows"),
    "prose@1": tuple(rule.name for rule in RULES),
}


def policy_mask(policy: str) -> int:
    """The bits of a policy's rules."""
    bits = {rule.name: rule.bit for rule in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def _blank(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(SPACES))) == 0


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words: words that lie in a window of five that occurs at least twice in the text.

    Only texts with such a window are sorted: the (hash, place) pairs bring equal windows together, the places that have
    an equal neighbour are put back in text order, and each adds the words up to the next one, five at most.
    """
    places = F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)
    hashed = F.transform("_words", lambda w: F.xxhash64(w))
    df = df.withColumn("_hashed", hashed)
    windows = F.transform(places, lambda i: F.xxhash64(*[F.get("_hashed", i + k) for k in range(WINDOW)]))
    df = df.withColumn("_windows", F.when(F.col("n_words") >= WINDOW, windows))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.array_sort(F.transform("_windows", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn("_pairs", F.when(repeats, pairs))

    def twin(pair: Column, at: Column) -> Column:
        before = (at > 0) & (F.get("_pairs", at - 1)["g"] == pair["g"])
        return before | F.coalesce(F.get("_pairs", at + 1)["g"] == pair["g"], F.lit(False))

    df = df.withColumn("_places", F.array_sort(F.transform(F.filter("_pairs", twin), lambda pair: pair["i"])))
    adds = F.transform(
        "_places", lambda p, i: F.least(F.coalesce(F.get("_places", i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))
    )
    total = F.aggregate(adds, F.lit(0).cast(LONG), lambda acc, x: acc + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast(LONG)))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The measurements of each document, over its whole text."""
    names = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")
    if clash := {"doc_id", "fail_mask", *names} & set(keep) or {c for c in keep if c.startswith("_")}:
        raise ValueError(f"columns clash with the operator's: {sorted(clash)}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias("_text"))
    df = df.withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: ~_blank(line)))
    without = lambda chars: F.length(F.translate("_text", chars, ""))
    df = df.withColumns({
        "n_words": F.size("_words").cast(LONG),
        "word_chars": without(SPACES).cast(LONG),
        "n_symbols": (F.length("_text") - without(SYMBOLS)).cast(LONG),
        "n_capitals": (F.length("_text") - without(CAPITALS)).cast(LONG),
        "n_lines": F.size("_lines").cast(LONG),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast(LONG),
    })
    # The generator keeps a later filter on a measure from being pushed down, which would copy the nested arrays into it.
    return _repeat_words(df).select("doc_id", *keep, F.inline(F.array(F.struct(*names))))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Measurements and `fail_mask` (long) of each document."""
    bits = [F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)) for rule in RULES]
    mask = reduce(lambda a, b: a.bitwiseOR(b), bits).cast(LONG)
    return measured(docs, id_col, text_col, keep).withColumn("fail_mask", mask)


def passes(policy: str, mask: str = "fail_mask") -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col(mask).bitwiseAND(F.lit(policy_mask(policy))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that would stay without it."""
    keeps = policy_mask(policy)
    masks = rows.groupBy(F.col("fail_mask").bitwiseAND(F.lit(keeps)).alias("m")).agg(F.count("*").alias("n"))
    bits = {rule.name: 1 << rule.bit for rule in RULES}
    named = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(bits[n]).alias("bit")) for n in POLICIES[policy]])
    each = masks.select("m", "n", F.explode(named).alias("r")).select("m", "n", "r.rule", "r.bit")
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast(LONG)
    return each.groupBy("rule").agg(
        total(F.col("m").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(F.col("m") == F.col("bit")).alias("failed_alone"),
        total(F.col("m").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"),
    )
