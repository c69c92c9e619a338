"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.llm import ann, jaccard, langid, lexical, mix, negatives, pack, passages, pii, quality, shard, urls, warc
from medloom.llm.common import table


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 by the law `rows`; whole rows move, the digests are taken of what arrived."""
    rows = shard.shard_uniform(table(spark, sf_dir, "documents"), shards=24, files=True)
    return rows.select(
        "doc_id",
        shard.text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through legacy archives into WARC files, as read back from them."""
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("record_id")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with source weights 5, 2, 1, repeating, no source beyond 3 times its words: what the mix takes,
    and the shards that the tree dealt each copy to."""
    plan = mix.mix_plan(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, _: n + F.col("size")).alias("taken")
    shards = F.array_join(F.transform("copies", lambda c: c["shard"].cast("string")), ",").alias("shards")
    return plan.select("doc_id", "size", "source_size", "target", taken, shards)


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated paragraphs and passages of all documents: what goes, and which documents keep it."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by a network learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with similar shingle sets, over all documents."""
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and digest of the base spans, and all spans."""
    rows = pii.find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda i: F.size(F.filter(base, lambda s: s["kind"] == i)).cast("long")
    many = {f"n_{k}": count(i) for i, k in enumerate(pii.KINDS)}
    digest = F.sha2(pii.span_text(base).cast("binary"), 256)
    return rows.select("doc_id", *[v.alias(k) for k, v in many.items()], digest.alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all other vectors for every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under policy prose@1."""
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    failed = ~quality.passes("base@1")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & quality.passes("prose@1")).alias("kept"), "fail_mask",
    )


#: Rules on urls, and the names under which hosts are registered: their last two labels are no domain of one owner.
URL_RULES = tuple(map(urls.parse_rule, ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")))
SUFFIXES = ("example.com", "example.net", "example.org")


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages. A page's outcome is the label of the document that the last number of its path names: bad if
    toxic or of low quality."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.regexp_extract(urls.path_of(F.col("url")), r"([0-9]+)[^0-9/]*/?$", 1)
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    outcomes = pages.select("url", F.try_to_number(number, F.lit("9" * 18)).cast("long").alias("doc_id")).join(bad, "doc_id")
    return urls.judged(pages, outcomes, URL_RULES, SUFFIXES)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all documents for every benchmark item."""
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50, among all vectors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


QUERIES = {
    "op1_shard": op1_shard,
    "op2_warc": op2_warc,
    "op3_mix": op3_mix,
    "op4_passages": op4_passages,
    "op5_langid": op5_langid,
    "op6_jaccard": op6_jaccard,
    "op7_pii": op7_pii,
    "op8_ann": op8_ann,
    "op9_pack": op9_pack,
    "op10_quality": op10_quality,
    "op11_urls": op11_urls,
    "op12_search": op12_search,
    "op13_negatives": op13_negatives,
}

_FAIL_BITS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality.RULES)

ORACLES = {
    "op2_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS first, count(*) AS many FROM p WHERE payload_bytes >= 1000 GROUP BY ALL
), r AS (
  SELECT p.*, g.many > 1 AND g.first IS NOT NULL AND (p.page_id IS NULL OR p.page_id < g.first) AS again, g.first
  FROM p LEFT JOIN g USING (payload_digest, payload_bytes)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM r
""",
    "op10_quality": rf"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT *, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3),
           lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) ELSE [] END AS g,
         row_number() OVER () AS row_id
  FROM words
), places AS (
  SELECT row_id, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS pos FROM grams
), twice AS (
  SELECT row_id, pos FROM (SELECT row_id, pos, count(*) OVER (PARTITION BY row_id, gram) AS n FROM places) WHERE n > 1
), repeats AS (
  SELECT row_id, sum(least(5, coalesce(nxt - pos, 5))) AS n
  FROM (SELECT row_id, pos, lead(pos) OVER (PARTITION BY row_id ORDER BY pos) AS nxt FROM twice) GROUP BY row_id
), measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM grams LEFT JOIN repeats r USING (row_id)
), masked AS (
  SELECT *, ({_FAIL_BITS})::BIGINT AS fail_mask FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_mask & {quality.policy_mask("base@1")}) <> 0 AS base_failed,
       (fail_mask & {quality.policy_mask("base@1") | quality.policy_mask("prose@1")}) = 0 AS kept, fail_mask
FROM masked
""",
    "op11_urls": urls.judged_sql(
        """SELECT url, bad FROM (SELECT url, try_cast(regexp_extract(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), ''), '([0-9]+)[^0-9/]*/?$', 1) AS BIGINT) AS doc_id FROM pages)
        JOIN (SELECT doc_id, max(toxic = 1 OR quality = 0) AS bad FROM labels GROUP BY doc_id) USING (doc_id)""", URL_RULES, SUFFIXES,
    ),
    "op12_search": lexical.SEARCH_SQL,
    "op13_negatives": negatives.MINED_SQL,
}
