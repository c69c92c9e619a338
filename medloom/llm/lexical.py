"""Ranked lexical search: document-sharded CSR postings with integer impacts, scored a term at a time.

`build` reads the corpus twice: once to count documents and terms (N and L, a row a batch), once to write the index. A task
cuts its documents into shards of at most SHARD_DOCS documents or SHARD_BYTES of text; a longer document is a shard of its
own. A shard is one row: its sorted terms, a row pointer, and for each posting the document's place in the shard and its
impact, all whole numbers. `terms` holds the documents of each term over all shards.

`search` takes the questions in blocks of at most BLOCK_TERMS terms, as a stream, and hands each block to all shards. In a
task, each question adds its terms' weighted impacts to a dense array of the shard's documents and takes the k best with
argpartition; equal scores at the border go by the smaller id, however many share it. A task keeps the k best of a question
over all of its shards, and Spark merges the tasks' lists. No postings are moved after the index is written.

A term is a maximal run of letters or digits of ASCII and of any other characters, only A-Z in lower case. Its weight w is
floor(1000 * ln((2N + 2) / (2 df + 1))); a posting's impact is (10^9 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L; a
document scores the sum of w * impact over a question's terms, repeats included. Weights can be negative.

Cases: a null or empty text has no terms, is in neither N nor the result; a document without an id counts and is returned with a
null id, after equal scores with one; repeated ids are documents of their own; a question without known terms gives no
rows, a repeated question id is a question of its own; an empty corpus gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medloom.llm.common import stored

SHARD_DOCS, SHARD_BYTES, SLICE = 65_536, 16 << 20, 1 << 20
BLOCK_TERMS = 1 << 17
# What is no part of a term, in bytes of UTF-8; all bytes from 0x80 are.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
IS_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
# Fixed values of the score.
SCALE, WEIGHT, PER_TF, PER_M, WHOLE, SHARE = 1_000_000_000, 1000, 1000, 8, 100, 75
INT64 = 2**63 - 1


class Index(NamedTuple):
    """shards: CSR postings, a row a shard; terms: term, df; documents and lengths: N and L."""

    shards: DataFrame
    terms: DataFrame
    documents: int
    lengths: int


# --- documents ------------------------------------------------------------------------------------------------------


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in slices that end between terms, so that a long one is never held as terms all at once."""
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        while end < len(text) and IS_TERM[text[end]] and IS_TERM[text[end - 1]]:
            end += 1
        yield text[at:end]
        at = end


def terms_of(text: str | None) -> Counter[bytes]:
    """A question's terms with their repeats."""
    return Counter(TERM.findall((text or "").encode().lower()))


def _texts(column: pa.Array) -> Iterator[bytes]:
    """A column's texts in UTF-8, null as empty."""
    for x in column.cast(pa.large_binary()):
        yield (x.as_buffer().to_pybytes() if x.is_valid else b"").lower()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term and their terms, a row a batch."""
    for batch in batches:
        documents = terms = 0
        for text in _texts(batch.column(0)):
            own = 0
            for at in range(0, len(text), SLICE):
                inside = IS_TERM[np.frombuffer(text, np.uint8, min(SLICE, len(text) - at), at)]
                own += int(np.count_nonzero(inside[1:] & ~inside[:-1])) + bool(inside[0] and not (at and IS_TERM[text[at - 1]]))
            documents, terms = documents + (own > 0), terms + own
        yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([terms], pa.int64())], names=["documents", "terms"])


# --- shards ---------------------------------------------------------------------------------------------------------


def damping(n: np.ndarray, documents: int, lengths: int) -> np.ndarray:
    """m of documents of n terms: 25 + (75 n N) div L, also where the product is beyond 64 bits."""
    factor = SHARE * documents
    small = n <= INT64 // factor
    out = (np.where(small, n, 0) * factor) // lengths
    for i in np.flatnonzero(~small):
        out[i] = int(n[i]) * factor // lengths
    return WHOLE - SHARE + out


class _Shard:
    """Documents of a shard while it is being gathered."""

    def __init__(self) -> None:
        self.words: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.term: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []
        self.bytes = 0

    def add(self, key: int | None, text: bytes) -> None:
        n, parts = 0, []
        for piece in pieces(text):
            found = TERM.findall(piece)
            n += len(found)
            if found:
                parts.append(np.unique(np.fromiter(map(self.words.__getitem__, found), np.int64, len(found)), return_counts=True))
        if not n:
            return
        if len(parts) > 1:
            term, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            tf = np.zeros(len(term), np.int64)
            np.add.at(tf, back, np.concatenate([p[1] for p in parts]))
        else:
            term, tf = parts[0]
        self.ids.append(key)
        self.lengths.append(n)
        self.term.append(term.astype(np.uint32))
        self.tf.append(tf.astype(np.int64))
        self.bytes += len(text)

    def row(self, documents: int, lengths: int) -> pa.RecordBatch:
        """The shard in CSR form, terms in byte order."""
        many = np.array([len(t) for t in self.term])
        place = np.repeat(np.arange(len(many), dtype=np.int64), many)
        term, tf = np.concatenate(self.term).astype(np.int64), np.concatenate(self.tf)
        words = list(self.words)
        order = sorted(range(len(words)), key=words.__getitem__)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        by = np.argsort(rank[term], kind="stable")
        m = damping(np.array(self.lengths, np.int64), documents, lengths)[place]
        impact = (SCALE * tf) // (PER_TF * tf + PER_M * m)
        pointer = np.concatenate([[0], np.cumsum(np.bincount(rank[term], minlength=len(words)))])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.ids], pa.list_(pa.int64())), pa.array([[words[i] for i in order]], pa.list_(pa.binary())),
                *[pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in ((pointer, "<i8"), (place[by], "<i4"), (impact[by], "<i4"))],
            ],
            names=["ids", "words", "pointer", "places", "impacts"],
        )


SHARD = "ids array<long>, words array<binary>, pointer binary, places binary, impacts binary"


def _sharded(documents: int, lengths: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                if shard.ids and (len(shard.ids) >= SHARD_DOCS or shard.bytes + len(text) > SHARD_BYTES):
                    yield shard.row(documents, lengths)
                    shard = _Shard()
                shard.add(key, text)
        if shard.ids:
            yield shard.row(documents, lengths)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of shards with the number of their postings."""
    for batch in batches:
        for words, pointer in zip(batch.column(0), batch.column(1), strict=True):
            df = np.diff(np.frombuffer(pointer.as_py(), "<i8"))
            yield pa.RecordBatch.from_arrays([words.values.cast(pa.binary()), pa.array(df)], names=["term", "df"])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents, written to the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sums = rows.select("text").mapInArrow(_counted, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, lengths = sums[0] or 0, sums[1] or 0
    shards = stored(rows.mapInArrow(_sharded(documents, lengths), SHARD), "lexical-shards")
    terms = shards.select("words", "pointer").mapInArrow(_frequencies, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return Index(shards, stored(terms, "lexical-terms"), documents, lengths)


# --- questions ------------------------------------------------------------------------------------------------------


class _Block(NamedTuple):
    """Questions of a block: which of the block's terms each has, how often, and the terms' weights."""

    words: list[bytes]
    weights: np.ndarray
    questions: list[tuple[np.ndarray, np.ndarray]]


def best(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by the smaller known id."""
    over = np.flatnonzero(scores > 0)
    if len(over) > k:
        border = np.partition(scores[over], len(over) - k)[len(over) - k]
        above, level = over[scores[over] > border], over[scores[over] == border]
        if len(level) > (need := k - len(above)):
            with_id, without = level[known[level]], level[~known[level]]
            if len(with_id) > need:
                with_id = with_id[np.argpartition(ids[with_id], need - 1)[:need]]
            level = np.concatenate([with_id, without])[:need]
        over = np.concatenate([above, level])
    return over[np.lexsort((ids[over], ~known[over], -scores[over]))]


def _scored(block: _Block, k: int):
    """The k best documents of each question over all shards of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * len(block.questions)
        wanted = pa.array(block.words, pa.binary())
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(0)[i].values
                known = raw.is_valid().to_numpy(zero_copy_only=False)
                ids = raw.fill_null(0).to_numpy(zero_copy_only=False)
                at = pc.index_in(wanted, value_set=batch.column(1)[i].values.cast(pa.binary())).fill_null(-1).to_numpy(zero_copy_only=False)
                pointer, places, impacts = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in ((2, "<i8"), (3, "<i4"), (4, "<i4")))
                for q, (own, repeats) in enumerate(block.questions):
                    here = at[own] >= 0
                    if not here.any():
                        continue
                    scores = np.zeros(len(ids), np.int64)
                    for row, factor in zip(at[own[here]], repeats[here] * block.weights[own[here]], strict=True):
                        some = slice(pointer[row], pointer[row + 1])
                        scores[places[some]] += factor * impacts[some].astype(np.int64)
                    top = best(scores, ids, known, k)
                    found = scores[top], ids[top], known[top]
                    if (before := held[q]) is not None:
                        found = tuple(np.concatenate(x) for x in zip(before, found, strict=True))
                        top = best(*found, k)
                        found = tuple(x[top] for x in found)
                    held[q] = found
        for q, found in enumerate(held):
            if found is not None and len(found[0]):
                score, ids, known = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), q, np.int32)), pa.array(ids, pa.int64(), mask=~known), pa.array(score, pa.int64())],
                    names=["question", "doc_id", "score"],
                )

    return run


def weight(documents: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))), in doubles."""
    return np.floor(WEIGHT * np.log((2.0 * documents + 2.0) / (2.0 * df + 1.0))).astype(np.int64)


def _asked(index: Index, block: list[tuple[int | None, Counter[bytes]]], k: int) -> DataFrame:
    spark = index.shards.sparkSession
    words = sorted({w for _, terms in block for w in terms})
    some = spark.createDataFrame(pa.table({"term": pa.array(words, pa.binary())}))
    known = {bytes(r.term): r.df for r in index.terms.join(F.broadcast(some), "term", "left_semi").collect()}
    words = sorted(known)
    number = {w: i for i, w in enumerate(words)}
    questions = []
    for _, terms in block:
        own = [(number[w], n) for w, n in terms.items() if w in number]
        questions.append((np.array([i for i, _ in own], np.int64), np.array([n for _, n in own], np.int64)))
    weights = weight(index.documents, np.array([known[w] for w in words], np.float64))
    found = index.shards.mapInArrow(_scored(_Block(words, weights, questions), k), "question int, doc_id long, score long")
    order = W.partitionBy("question").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(block)], "question int, item_id long")
    return found.join(F.broadcast(names), "question").select("item_id", "rank", "doc_id", "score")


def search(index: Index, questions: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank from 1, doc_id and score of the k best documents of each question."""
    found: DataFrame | None = None
    block: list[tuple[int | None, Counter[bytes]]] = []
    held = 0

    def asked() -> DataFrame:
        part = stored(_asked(index, block, k), "lexical-found")
        return part if found is None else found.unionByName(part)

    for row in questions.select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        terms = terms_of(row[1])
        if terms and index.documents:
            if block and held + len(terms) > BLOCK_TERMS:
                found, block, held = asked(), [], 0
            block.append((row[0], terms))
            held += len(terms)
    if block:
        found = asked()
    return found if found is not None else questions.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


#: DuckDB SQL for the 10 best documents of each benchmark item.
SEARCH_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS (SELECT d, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT d, sum(tf)::BIGINT AS n FROM tf GROUP BY d), total AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_terms FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (
  SELECT q, item_id, term, count(*) AS many FROM (
    SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL
), weighted AS (
  SELECT q, item_id, term, many * floor(1000 * ln((2.0 * all_docs + 2.0)::DOUBLE / (2.0 * df + 1.0)::DOUBLE))::BIGINT AS w FROM asked JOIN df USING (term), total
), scores AS (
  SELECT q, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_terms))))::BIGINT AS score
  FROM weighted JOIN tf USING (term) JOIN len USING (d), total GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
