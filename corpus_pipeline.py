"""A training corpus from raw documents: language, near copies, personal data, source mix, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame, which is
written to the shared folder and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.llm import jaccard, langid, mix, pack, pii
from medloom.llm.common import WORD, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without text or letters go."""
    found = langid.predict(docs, langid.fit(docs))
    return found.where("lang_pred <> 'und'").select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar ones: the smallest id's, null ids last; rows without words all stay."""
    # rows are told apart by all of their columns: equal rows are copies of each other anyway
    every = [*docs.columns, *[F.col(c).isNull() for c in docs.columns]]
    keyed = docs.withColumns({f"_row{i}": F.xxhash64(F.lit(i), *every) for i in (1, 2)})
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row1", "_row2")
    groups = jaccard.similar_groups(keyed.select(row.alias("row"), "text"), "row")
    kept = groups.where("component_id = doc_id").select("doc_id._row1", "doc_id._row2").distinct()
    wordy = F.coalesce("text", F.lit("")).rlike(WORD)
    once = keyed.where(wordy).dropDuplicates(["_row1", "_row2"]).join(kept, ["_row1", "_row2"], "left_semi")
    return once.select(docs.columns).unionByName(docs.where(~wordy))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind."""
    rows = pii.redact(pii.find_personal(docs))
    return rows.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights 5, 2, 1: a row for each time that a document is taken."""
    return mix.mixed(docs, weights=(5, 2, 1), most=3).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return pack.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("near_copies", keep_one_of_near_copies),
    ("personal_data", redact_personal_data),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Stages 1, 2 and 4 are beyond SQL (a trained network, exact similarity of all texts, a random mix).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
