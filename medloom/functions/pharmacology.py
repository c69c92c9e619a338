"""Groups of drugs by name or class, and what two of them together mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medloom.functions import text

# Names of a narrow therapeutic index, and of each group its names and the words of a class that belong to it.
NTI = ("warfarin", "digoxin", "lithium", "phenytoin", "theophylline", "carbamazepine", "cyclosporine", "tacrolimus")
GROUPS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "cns": (
        (
            "alprazolam", "clonazepam", "diazepam", "lorazepam", "midazolam", "zolpidem", "zopiclone", "eszopiclone", "quetiapine", "olanzapine",
            "risperidone", "haloperidol", "chlorpromazine", "morphine", "codeine", "tramadol", "fentanyl", "oxycodone", "hydromorphone", "methadone",
            "buprenorphine",
        ),
        ("opioid", "benzodiazepine", "sedative", "hypnotic", "barbiturate", "antipsychotic", "anxiolytic"),
    ),
    "antithrombotic": (
        (
            "warfarin", "heparin", "enoxaparin", "apixaban", "rivaroxaban", "dabigatran", "edoxaban", "fondaparinux", "aspirin", "clopidogrel",
            "prasugrel", "ticagrelor", "dipyridamole", "cilostazol",
        ),
        ("anticoagulant", "antiplatelet"),
    ),
    "antihypertensive": (
        (
            "amlodipine", "telmisartan", "losartan", "valsartan", "ramipril", "lisinopril", "enalapril", "metoprolol", "atenolol", "bisoprolol",
            "nifedipine", "verapamil", "diltiazem", "hydrochlorothiazide", "chlorthalidone", "spironolactone", "furosemide", "torasemide", "clonidine",
            "doxazosin",
        ),
        (
            "antihypertensive", "ace inhibitor", "angiotensin converting enzyme inhibitor", "angiotensin receptor blocker", "arb", "beta blocker",
            "calcium channel blocker", "ccb", "thiazide", "diuretic", "vasodilator", "alpha blocker",
        ),
    ),
    "antidiabetic": (
        (
            "metformin", "glimepiride", "glipizide", "gliclazide", "pioglitazone", "rosiglitazone", "acarbose", "voglibose", "repaglinide", "nateglinide",
            "sitagliptin", "vildagliptin", "linagliptin", "dapagliflozin", "empagliflozin", "canagliflozin", "insulin",
        ),
        (
            "antidiabetic", "biguanide", "sulfonylurea", "insulin", "dpp 4", "dpp-4", "glp 1", "glp-1", "sglt2", "thiazolidinedione", "meglitinide",
            "alpha glucosidase",
        ),
    ),
    "ppi": (("pantoprazole", "omeprazole", "esomeprazole", "rabeprazole", "lansoprazole", "dexlansoprazole"), ("ppi", "proton pump inhibitor")),
    "gastric": (("atazanavir", "rilpivirine", "erlotinib", "gefitinib", "dasatinib", "ketoconazole", "itraconazole", "posaconazole", "cefuroxime"), ()),
}
# Severity and reason of two drugs of the same group, in the order in which groups are tried.
TOGETHER = (
    ("cns", "major", "dual_cns_depressants"), ("antithrombotic", "major", "dual_anticoagulant_or_antiplatelet"),
    ("antihypertensive", "moderate", "dual_antihypertensives"), ("antidiabetic", "moderate", "dual_antidiabetics"),
)


def in_group(group: str, name: Column, kind: Column) -> Column:
    """Whether a drug belongs to a group, by its name or by a word in its class."""
    names, words = GROUPS[group]
    by_name = F.coalesce(text.lookup_key(name), F.lit("")).isin(*names)
    key = F.coalesce(text.lookup_key(kind), F.lit(""))
    plain = sorted({w.replace("-", " ") for w in words})
    return by_name | F.exists(F.array(*[F.lit(w) for w in plain]), lambda w: key.contains(w)) if plain else by_name


def is_nti(name: Column, flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(text.lookup_key(name), F.lit("")).isin(*NTI)


def pair_rule(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """struct(severity, reason) of a pair of drugs, each given as (name, class, narrow index); null where no rule fits."""
    verdict = lambda severity, reason: F.struct(F.lit(severity).alias("severity"), F.lit(reason).alias("reason"))
    inside = lambda group, d: in_group(group, d[0], d[1])
    found = F.when(is_nti(a[0], a[2]) | is_nti(b[0], b[2]), verdict("major", "narrow_therapeutic_index"))
    for group, severity, reason in TOGETHER:
        found = found.when(inside(group, a) & inside(group, b), verdict(severity, reason))
    stomach = (inside("ppi", a) & inside("gastric", b)) | (inside("ppi", b) & inside("gastric", a))
    return found.when(stomach, verdict("minor", "ppi_with_gastric_ph_sensitive_drug"))
