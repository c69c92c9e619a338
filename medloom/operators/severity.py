"""Unknown severities of direct edges, inferred through tiers: what a tier does not decide goes to the next."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.functions import pharmacology
from medloom.functions.scoring import SEVERITY_RANK, first_rule, ranked

# Words in adverse events that make a shared event major or moderate.
MAJOR_WORDS = (
    "death", "cardiac arrest", "respiratory failure", "anaphylactic", "anaphylaxis", "hepatic failure", "liver failure", "renal failure",
    "kidney failure", "seizure", "hemorrhage", "haemorrhage", "stroke",
)
MODERATE_WORDS = (
    "hospitalization", "hospitalisation", "arrhythmia", "hypotension", "hyperkalemia", "hyperkalaemia", "hypoglycemia", "hypoglycaemia", "bleeding",
)


@dataclass(frozen=True)
class Tier:
    """A severity expression (null: not decided) and the method that it stands for."""

    method: str
    severity: Column


def words_in(events: Column, words: tuple[str, ...]) -> Column:
    """The words that occur in any of some events, regardless of case."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.exists(events, lambda e: F.lower(e).contains(w)))


def event_tier(events: Column) -> Tier:
    """By shared adverse events: major words, then moderate ones, else minor; not decided without events."""
    severity = first_rule(
        (F.size(words_in(events, MAJOR_WORDS)) > 0, F.lit("major")), (F.size(words_in(events, MODERATE_WORDS)) > 0, F.lit("moderate")),
        default="minor",
    )
    return Tier("shared_events", F.when(F.size(events) > 0, severity))


def rule_tier(nti: Column, same_risk: Column) -> Tier:
    """A narrow therapeutic index on either side is major, and so are two drugs of the same class of risk."""
    return Tier("pharmacology_rule", F.when(nti | same_risk, "major"))


def inferred(edges: DataFrame, tiers: list[Tier], default: str) -> DataFrame:
    """Edges with severities filled in, `method` (original, a tier's, or default) and what the severity was before."""
    unknown = F.coalesce(F.lower("severity"), F.lit("unknown")) == "unknown"
    severity = F.coalesce(*[t.severity for t in tiers], F.lit(default))
    method = first_rule(*[(t.severity.isNotNull(), F.lit(t.method)) for t in tiers], default="default")
    return edges.withColumns({
        "original_severity": F.col("severity"),
        "method": F.when(unknown, method).otherwise("original"),
        "severity": F.when(unknown, severity).otherwise(F.lower("severity")),
        "review_needed": unknown & (method == "default"),
    })


def unknown_counts(edges: DataFrame) -> DataFrame:
    """Edges and unknown severities by source."""
    unknown = F.coalesce(F.lower("severity"), F.lit("unknown")) == "unknown"
    return edges.groupBy("source").agg(F.count("*").alias("edges"), F.count_if(unknown).alias("unknown"))


# How sure each way of a repair is.
SURE = {"matched_trusted": "high", "matched_listed": "high", "pharmacology_rule": "low", "default_low_confidence": "low"}


def repaired_source(edges: DataFrame, drugs: DataFrame, events: DataFrame, source: str, trusted: str, listed: str, default: str = "minor") -> DataFrame:
    """Edges (lo, hi, severity, source, flagged) with the unknown severities of one source filled in, through tiers: the severity of an
    edge of the trusted source, major for a pair that is flagged or listed, words of shared events, rules on names and classes, default.

    drugs: drug, name, class, nti; events: lo, hi, events. New columns: method, evidence (a text), sure, review_needed, and
    original_severity. Other sources' edges stay, with method `original`. Support of a pair is reduced to one row before it is joined.
    """
    known = ranked(F.col("severity"), SEVERITY_RANK, 1)
    good = edges.where(F.col("source") == trusted).groupBy("lo", "hi").agg(F.max_by(F.lower("severity"), known).alias("_trusted"))
    named = edges.where(F.col("source") == listed).select("lo", "hi").distinct().withColumn("_listed", F.lit(True))
    shared = events.groupBy("lo", "hi").agg(F.max("events").alias("_events"))
    facts = lambda end: drugs.groupBy(F.col("drug").alias(end)).agg(F.min(F.struct("name", "class", "nti")).alias(f"_{end}"))
    unknown = (F.col("source") == source) & (F.coalesce(F.lower("severity"), F.lit("unknown")) == "unknown")
    rows = edges.join(good, ["lo", "hi"], "left").join(named, ["lo", "hi"], "left").join(shared, ["lo", "hi"], "left").join(facts("lo"), "lo", "left").join(facts("hi"), "hi", "left")
    major, moderate = words_in(F.col("_events"), MAJOR_WORDS), words_in(F.col("_events"), MODERATE_WORDS)
    has = F.size(F.coalesce("_events", F.array().cast("array<string>"))) > 0
    rule = pharmacology.pair_rule(*[(F.col(f"_{e}.name"), F.col(f"_{e}.class"), F.col(f"_{e}.nti")) for e in ("lo", "hi")])
    join = lambda words: F.array_join(F.slice(words, 1, 5), "|")
    step = lambda severity, method, evidence, review: F.struct(severity.alias("severity"), F.lit(method).alias("method"), evidence.alias("evidence"), F.lit(review).alias("review"))
    found = (
        F.when(F.col("_trusted").isNotNull(), step(F.col("_trusted"), "matched_trusted", F.col("_trusted"), False))
        .when(F.coalesce("_listed", F.lit(False)) | F.coalesce("flagged", F.lit(False)), step(F.lit("major"), "matched_listed", F.lit("flagged_pair"), False))
        .when(has & (F.size(major) > 0), step(F.lit("major"), "shared_events", join(major), False))
        .when(has & (F.size(moderate) > 0), step(F.lit("moderate"), "shared_events", join(moderate), False))
        .when(has, step(F.lit("minor"), "shared_events", join(F.col("_events")), True))
        .when(rule.isNotNull(), step(rule["severity"], "pharmacology_rule", rule["reason"], True))
        .otherwise(step(F.lit(default), "default_low_confidence", F.lit("no_stronger_support"), True))
    )
    rows = rows.withColumn("_f", F.when(unknown, found))
    sure = F.create_map(*[F.lit(x) for item in SURE.items() for x in item])
    by_events = F.when(F.col("_f.review"), "low").otherwise("medium")
    return rows.select(
        *[c for c in edges.columns if c != "severity"], F.col("severity").alias("original_severity"), F.coalesce("_f.severity", F.lower("severity")).alias("severity"),
        F.coalesce("_f.method", F.lit("original")).alias("method"), F.col("_f.evidence").alias("evidence"),
        F.when(F.col("_f").isNotNull(), F.coalesce(F.element_at(sure, F.col("_f.method")), by_events)).alias("sure"), F.coalesce("_f.review", F.lit(False)).alias("review_needed"),
    )
