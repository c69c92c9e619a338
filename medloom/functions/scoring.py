"""Scores, bands and confidences as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks of severities, of the sources of direct edges, and of how a severity came about; weights of
# inhibitor strengths and substrate fractions.
SEVERITY_RANK = {"critical": 5, "major": 4, "moderate": 3, "minor": 2, "unknown": 1}
STRENGTH = {"strong": 3, "moderate": 2, "weak": 1}
FRACTION = {"major": 3, "moderate": 2, "minor": 1}
EVIDENCE_RANK = {"established": 4, "strong": 3, "moderate": 2, "weak": 1}
OLD_AGE, AGE_FACTOR, NTI_FACTOR = 70, 1.2, 1.5


def ranked(value: Column, ranks: dict[str, int], default: int) -> Column:
    """The rank of a word; anything else, null included, has the default."""
    pairs = [F.lit(x) for item in ranks.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(F.trim(value))), F.lit(default))


def severity_or_unknown(value: Column) -> Column:
    """A severity in lower case; what is no severity is `unknown`."""
    word = F.lower(F.trim(value))
    return F.when(word.isin(list(SEVERITY_RANK)), word).otherwise(F.lit("unknown"))


def scaled(score: Column, nti: Column | None, age: Column, cap: float) -> Column:
    """A score raised for a narrow therapeutic index and for old age, and capped; two decimals."""
    if nti is not None:
        score = score * F.when(nti, F.lit(NTI_FACTOR)).otherwise(F.lit(1.0))
    score = score * F.when(age >= OLD_AGE, F.lit(AGE_FACTOR)).otherwise(F.lit(1.0))
    return F.round(F.least(score, F.lit(cap)), 2)


def inhibition_score(strength: Column, fraction: Column, nti: Column, age: Column) -> Column:
    """Strength times fraction, scaled, at most 15."""
    base = (ranked(strength, STRENGTH, 1) * ranked(fraction, FRACTION, 1)).cast("double")
    return scaled(base, nti, age, 15.0)


def induction_score(nti: Column, age: Column) -> Column:
    """4, scaled, at most 10."""
    return scaled(F.lit(4.0), nti, age, 10.0)


#: Base scores of the effects that two drugs share or cascade into.
EFFECT_SCORE = {"qt": 8.0, "electrolyte": 7.0, "cns": 6.0}


def effect_score(effect: str, age: Column) -> Column:
    return scaled(F.lit(EFFECT_SCORE[effect]), None, age, 10.0)


def path_confidence(*hops: Column) -> Column:
    """Nine tenths of the weakest hop; three decimals."""
    return F.round(F.least(*hops) * 0.9, 3)


def burden_band(total: Column) -> Column:
    """Anticholinergic burden: 0 low, 1 and 2 moderate, from 3 high."""
    return F.when(total >= 3, "high").when(total >= 1, "moderate").otherwise("low")


def score_severity(score: Column) -> Column:
    """The display severity of a score; a score of 0 or none is for the doctor to review."""
    return F.when(score >= 8, "critical").when(score >= 5, "major").when(score > 0, "moderate").otherwise("doctor_review")


def evaluation_severity(score: Column) -> Column:
    """The severity that evaluations give a score, on purpose another map than score_severity."""
    return F.when(score >= 8, "major").when(score >= 5, "moderate").otherwise("minor")


def display_severity(severity: Column, score: Column) -> Column:
    """A known severity as it is, else the one of the score; `unknown` shows as doctor_review unless scored."""
    word = F.lower(F.trim(severity))
    return F.when(word.isin("critical", "major", "moderate", "minor"), word).otherwise(score_severity(score))


def frequency_band(share: Column) -> Column:
    return F.when(share >= 0.1, "common").when(share >= 0.01, "uncommon").when(share.isNotNull(), "rare").otherwise("unknown")


def source_confidence(sources: Column, guideline: Column) -> Column:
    """Several sources 1.0, a guideline 0.98, one source 0.95."""
    return F.when(sources > 1, 1.0).when(guideline, 0.98).otherwise(0.95)


def verified_confidence(confidence: Column, hops: Column) -> Column:
    """A claim's confidence is at most 0.75; both hops in the graph raise it by a tenth, one lowers it by a fifth."""
    capped = F.least(confidence, F.lit(0.75))
    return F.round(F.when(hops == 2, F.least(capped * 1.1, F.lit(1.0))).when(hops == 1, capped * 0.8).otherwise(capped), 4)


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.7, "medium").otherwise("low")


def complexity(drugs: Column, herbs: Column, unresolved: Column) -> Column:
    return F.when((drugs >= 8) | (unresolved > 0), "high").when((drugs >= 4) | (herbs > 0), "medium").otherwise("low")


def finding_priority(rank: Column, metabolic: Column) -> Column:
    """Ten times the severity rank, and two more for a metabolic pathway."""
    return rank * 10 + F.when(metabolic, 2).otherwise(0)


def first_rule(*rules: tuple[Column, str], default: str | None = None) -> Column:
    """The value of the first rule that holds."""
    start = F.when(*rules[0])
    return reduce(lambda acc, rule: acc.when(*rule), rules[1:], start).otherwise(F.lit(default))


def vital_alerts(systolic: Column, sugar: Column, creatinine: Column) -> Column:
    """The vitals that are too high, in a fixed order; missing ones are not."""
    high = F.array(
        F.when(systolic > 140, "blood_pressure"), F.when(sugar > 126, "blood_sugar"), F.when(creatinine > 1.3, "creatinine")
    )
    return F.array_compact(high)
