"""Citations: built from source dimensions, classified, deduplicated, summarised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.functions import text
from medloom.functions.scoring import first_rule

# Link kinds that name one publication, and scopes from the strongest to the weakest.
EXACT_LINKS = ("raw_url", "doi", "pmid")
SCOPES = (
    "guideline_table", "exact_reference", "literature_mention", "dataset_record", "dataset_source", "curated_with_backing",
    "local_curated_rule", "internal_rule", "graph_verification", "source_only",
)


def evidence_scope(c: dict[str, Column]) -> Column:
    """The scope of a citation by precedence; c has columns provenance, link_kind, reference, table, locator, backing."""
    given = lambda name: F.coalesce(c[name], F.lit("")) != ""
    kind = F.lower(F.trim(F.coalesce(c["provenance"], F.lit(""))))
    return first_rule(
        ((kind == "clinical_guideline") | given("table"), F.lit("guideline_table")),
        (F.coalesce(c["link_kind"], F.lit("")).isin(*EXACT_LINKS), F.lit("exact_reference")),
        (given("reference"), F.lit("literature_mention")),
        ((kind == "external_dataset") & given("locator"), F.lit("dataset_record")),
        (kind == "external_dataset", F.lit("dataset_source")),
        (given("backing"), F.lit("curated_with_backing")),
        (kind == "local_curated_layer", F.lit("local_curated_rule")),
        (kind == "derived_internal_rule", F.lit("internal_rule")),
        (kind == "internal_graph_verification", F.lit("graph_verification")),
        default="source_only",
    )


def cited(findings: DataFrame, sources: DataFrame, key: str = "source") -> DataFrame:
    """Findings with their source's title and provenance, and a link for their reference; unknown sources keep their key."""
    known = sources.select(F.col("source_key"), "title", "provenance")
    df = findings.withColumn("source_key", text.lookup_key(F.col(key))).join(known, "source_key", "left")
    return df.withColumns({"title": F.coalesce("title", F.col(key)), "url": text.reference_url(F.col("reference"))})


def deduplicated(citations: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """One citation for each combination of keys (null equals null): the first by seq."""
    rest = [c for c in citations.columns if c not in keys]
    best = citations.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("best"))
    return best.select(*keys, *[f"best.{c}" for c in rest])


def scope_profile(citations: DataFrame, keys: list[str], scope: str, most: int = 2) -> DataFrame:
    """Per key the strongest scopes, joined by ` + `."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SCOPES]), F.col(scope))
    ranked = F.array_sort(F.collect_set(F.struct(rank.alias("rank"), F.col(scope).alias("scope"))))
    top = F.transform(F.slice(ranked, 1, most), lambda s: s["scope"])
    return citations.groupBy(*keys).agg(F.array_join(top, " + ").alias("scopes"), F.countDistinct(scope).alias("n_scopes"))


def best_study(studies: DataFrame, keys: list[str], score: list[Column], seq: Column) -> DataFrame:
    """Per key the number of studies and the best one by a tuple of scores."""
    rest = [c for c in studies.columns if c not in keys]
    order = F.struct(*[s.alias(f"s{i}") for i, s in enumerate(score)], (-seq).alias("seq"))
    best = studies.groupBy(*keys).agg(F.count("*").alias("n_studies"), F.max_by(F.struct(*rest), order).alias("best"))
    return best.select(*keys, "n_studies", *[f"best.{c}" for c in rest])
