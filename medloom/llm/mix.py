"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

A source's documents are put in a seeded random order; their words form a line, cut into blocks of `block_words`. A
target of T words takes the line T / size times: whole passes (epochs), then a part of one. So each source owes an
exact number of blocks. A tree over the output shards splits those quotas: at each node the blocks that go to the left
half of its shards are drawn from the multivariate hypergeometric law, until each shard knows how many blocks of each
source it holds. A source's blocks, permuted, are dealt out in disjoint ranges by those counts, and each shard shuffles
what it got.

Scale: the line is a two-level prefix sum (buckets by leading bits of the random key, each about BUCKET_ROWS rows of
one source), so a hot source spreads over as many tasks as it has buckets. The tree works on quotas only: chunks of CHUNK
sources, each chunk in its own task.

Cases: a null source is a source of its own, the last by rank; a null text has no words; a source without words takes
nothing; rows that are equal in id, source and text tie, are numbered by their place in the line and interchangeable; ids
may be null or repeated; an empty table gives no rows; the input's columns are kept, whatever their names but those added,
which raise an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medloom.llm.common import stored, word_count

#: Rows of a bucket; sources of a chunk; bytes of text that a part of an output shard takes.
BUCKET_ROWS, CHUNK, SHARD_BYTES = 1024, 512, 128 << 20
#: Fixed value: a prime multiplier beyond any number of blocks of a source, for permuting their order.
PRIME = 2**31 - 1
ADDED = ("size", "source_size", "target", "copies")


def split_tree(quotas: np.ndarray, caps: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Counts (quota, shard) with both margins exact: shards are halved recursively, each half drawn from what is left."""
    if len(caps) == 1:
        return quotas[:, None]
    half = len(caps) // 2
    left = rng.multivariate_hypergeometric(quotas, int(caps[:half].sum()), method="marginals")
    return np.concatenate([split_tree(left, caps[:half], rng), split_tree(quotas - left, caps[half:], rng)], axis=1)


def targets(sums: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Per source (none, src): rank, source_size and target; what a cap of `most` times the size leaves goes to the rest.

    Sources by cap per weight, ascending: the first whose level (words left per weight left) its cap exceeds fixes the
    level for itself and all after it. One row a source; the windows see nothing else.
    """
    df = sums.groupBy("none", "src").agg(F.sum("words").alias("source_size"))
    rank = F.row_number().over(W.orderBy("none", "src")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    df = df.withColumn("rank", rank).withColumn("weight", weight)
    df = df.withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    whole = W.partitionBy()
    level = (F.sum("source_size").over(whole) - before("cap")) / after
    df = df.withColumn("level", level)
    ratio = F.col("cap") / F.col("weight")
    fits = F.min_by("level", F.when(F.col("level") <= ratio, F.struct(ratio, "rank"))).over(whole)
    target = F.least(F.col("weight") * F.coalesce(fits, F.lit(0.0)), "cap")
    return df.select("none", "src", "rank", "source_size", target.alias("target"))


def _chunk_caps(shards: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        total = int(pdf["quota"].sum())
        caps = np.array([total // shards + (s < total % shards) for s in range(shards)])
        dealt = split_tree(pdf["quota"].to_numpy(np.int64), caps, np.random.default_rng([seed, 0]))
        return pd.DataFrame({"chunk": pdf["chunk"], "caps": list(dealt)})

    return run


def _source_ends(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        rng = np.random.default_rng([seed, 1, int(pdf["chunk"].iloc[0])])
        dealt = split_tree(pdf["quota"].to_numpy(np.int64), np.asarray(pdf["caps"].iloc[0], np.int64), rng)
        return pd.DataFrame({"rank": pdf["rank"], "ends": list(np.cumsum(dealt, 1))})

    return run


def shard_quotas(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """Per source rank the running block counts over the shards (`ends`)."""
    chunked = sources.select(F.floor(F.col("rank") / CHUNK).alias("chunk"), "rank", "quota")
    totals = chunked.groupBy("chunk").agg(F.sum("quota").alias("quota"))
    caps = totals.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_chunk_caps(shards, seed), "chunk long, caps array<long>")
    return chunked.join(caps, "chunk").groupBy("chunk").applyInPandas(_source_ends(seed), "rank int, ends array<long>")


def _line(df: DataFrame, where: list[str], starts: DataFrame) -> DataFrame:
    """Rows with `start`, the words of their source before them, and their source's figures."""
    inside = W.partitionBy(*where).orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, where)
    return df.withColumn("start", F.col("start") + F.col("base"))


def _inside() -> Column:
    """Whether a document lies wholly in the last, partial pass."""
    return F.col("start") + F.col("size") <= F.col("part")


def _edges(df: DataFrame, where: list[str], starts: DataFrame) -> DataFrame:
    """Per source the `filler`: the place in the line, so one of equal rows, of the document beyond the cut that fits the gap before it best, if it helps.

    The document that the cut falls into would leave a gap, or overshoot, by up to its own size.
    """
    ends = _line(df, where, starts).groupBy("none", "src").agg(
        F.max("part").alias("part"), F.max(F.when(_inside(), F.col("start") + F.col("size"))).alias("end")
    )
    gaps = stored(ends.select("none", "src", (F.col("part") - F.coalesce("end", F.lit(0))).alias("gap")), "mix-gaps")
    beyond = _line(df, where, starts.join(gaps, ["none", "src"])).where(~_inside() & (F.col("size") > 0))
    off = F.abs(F.col("size") - F.col("gap"))
    best = beyond.groupBy("none", "src").agg(F.min(F.struct(off.alias("off"), "start", "gap")).alias("best"))
    return best.where("best.off < best.gap").select("none", "src", F.col("best.start").alias("filler"))


def mix_plan(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, shards: int = 32, block_words: int = 65_536, seed: int = 3
) -> DataFrame:
    """Every document with its size, its source's size and target, and `copies`: array of (epoch, shard) in the mix."""
    if clash := set(ADDED) & set(docs.columns):
        raise ValueError(f"columns clash with the operator's: {sorted(clash)}")
    bits = max(0, math.ceil(math.log2(max(1, docs.count()) / BUCKET_ROWS)))
    df = docs.select(
        F.struct(*docs.columns).alias("row"), "doc_id", word_count(F.col("text")).alias("size"),
        F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("src"),
        F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("key"),
    )
    df = df.withColumn("bucket", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long"))
    where = ["none", "src", "bucket"]
    light = stored(df.select(*where, "key", "doc_id", "size"), "mix-lines")  # so that texts are read twice in all
    sums = stored(light.groupBy(*where).agg(F.sum("size").alias("words")), "mix-sums")
    part = F.col("target") - F.col("full") * F.col("source_size")
    blocks = lambda words: F.ceil(words / block_words)
    sources = targets(sums, weights, most).withColumn("full", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)))
    sources = sources.withColumns({"part": part, "a_pass": blocks(F.col("source_size"))})
    sources = stored(sources.withColumn("quota", F.col("full") * F.col("a_pass") + blocks(F.greatest(F.col("part"), F.lit(0.0)))), "mix-sources")
    sources = sources.join(shard_quotas(sources, shards, seed), "rank")
    before = F.sum("words").over(W.partitionBy("none", "src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select(*where, F.coalesce(before, F.lit(0)).alias("base")).join(sources, ["none", "src"])
    edges = _edges(light, where, starts)
    df = _line(df, where, starts.join(edges, ["none", "src"], "left"))
    passes = F.sequence(F.lit(0).cast("long"), F.col("full"))
    taken = lambda e: (e < F.col("full")) | _inside() | F.coalesce((F.col("start") == F.col("filler")) & (F.col("size") > 0), F.lit(False))

    def dealt(e):
        block = e * F.col("a_pass") + F.floor(F.col("start") / block_words)
        place = F.pmod(block * PRIME + F.pmod(F.xxhash64(F.lit(seed), "rank"), F.lit(PRIME)), F.greatest("quota", F.lit(1)))
        return F.struct(e.cast("int").alias("epoch"), F.size(F.filter("ends", lambda end: end <= place)).alias("shard"))

    df = df.withColumn("copies", F.transform(F.filter(passes, taken), dealt))
    return df.select("row.*", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, shards: int = 32, seed: int = 3, **options) -> DataFrame:
    """The mix itself: a row for each copy with its `shard`, shards apart and each in a random order."""
    plan = mix_plan(docs, shards=shards, seed=seed, **options)
    if "shard" in docs.columns:
        raise ValueError("columns clash with the operator's: ['shard']")
    rows = plan.select(F.struct(*docs.columns).alias("row"), F.explode("copies").alias("copy"))
    rows = rows.withColumn("place", F.xxhash64(F.lit(seed), "row.doc_id", "row.source", "row.text", "copy.epoch"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spread = F.pmod("place", F.lit(max(-(-256 // shards), -(-size // (shards * SHARD_BYTES)))))
    rows = rows.repartition("copy.shard", spread).sortWithinPartitions("copy.shard", F.xxhash64(F.lit(seed + 1), "place"))
    return rows.select("row.*", "copy.shard")
