"""Hard negatives by inner product, searched exactly through an orthogonal rotation onto principal components.

Vectors become whole numbers (floor(256 x)) and a score is their integer inner product. The second moments of all rows,
summed in Spark, give an orthogonal rotation whose first coordinates hold most of every product. A task turns its rows,
multiplies only STAGES[0] leading coordinates with a block of anchors, and bounds what is missing by the product of the
residual norms plus a slack for rounding. Pairs whose bound lies below what an anchor still needs go at once; the others get
the next coordinates, and those that survive all stages are scored by whole numbers. So discarding saves work and never
changes a result.

Two passes over all rows answer a block of anchors: the first finds each anchor's nearest rows of its own label (its
positives), the second, for each positive, the best rows of other labels with `low` to `high` per cent of its score. A task
keeps its best rows for each anchor (or positive) as a running bound and returns only them; Spark merges the tasks' lists.
Anchors come in blocks of at most BLOCK, as a stream, so what is handed to tasks does not grow with the table; rows are never
moved and no label's rows meet in one task.

Cases: rows without an id or label, without a vector or with a null or non-finite component take no part, nor do vectors of
another length than most, or so long that products would not fit 64 bits (an integer norm of 2**28 or more); a row is not
compared with rows of its own id; equal scores go by the smaller id; of rows with one id the anchor is the smallest (label,
vector), but each row can be found; zero vectors take part; fewer rows than asked for give all; anchors without positives or
fitting negatives give no rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medloom.llm.common import stored

#: Anchors of a block, rows compared at a time, leading coordinates after each stage as shares of all.
BLOCK, ROWS, STAGES = 4096, 512, (0.125, 0.375, 1.0)
#: Rows of which a task adds up second moments before it hands them on.
MOMENTS = 1 << 16
SCALE, MOST, PAIRS = 256, 1 << 56, 1 << 20
NONE = -(2**62)


# --- rows -----------------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(id, label, vec as whole numbers) of the rows that take part, but for their length."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("vec"))
    rows = rows.where("id is not null and label is not null and vec is not null and size(vec) > 0").where(~bad)
    scaled = F.transform("vec", lambda x: F.floor(x.cast("double") * float(SCALE)).cast("double"))
    rows = rows.select("id", "label", scaled.alias("vec"))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    return rows.where(norm < float(MOST)).select("id", "label", F.transform("vec", lambda x: x.cast("long")).alias("vec"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of x_i x_j over batches, a row a batch of MOMENTS rows at least."""
    total, rows = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(0)).astype(np.float64)
        total = x.T @ x if total is None else total + x.T @ x
        rows += batch.num_rows
        if rows >= MOMENTS:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "sum"])
            total, rows = None, 0
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "sum"])


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """An orthogonal matrix (coordinate, component), the components with the largest second moments first."""
    sums = rows.select("vec").mapInArrow(_moments, "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum"))
    flat = np.zeros(dim * dim)  # dim * dim numbers, whatever the number of rows
    for r in sums.toLocalIterator():
        flat[r["at"]] = r["sum"]
    both = flat.reshape(dim, dim)
    values, vectors = np.linalg.eigh((both + both.T) / 2)
    return np.ascontiguousarray(vectors[:, np.argsort(-values)])


# --- pruned products ------------------------------------------------------------------------------------------------


class _Side:
    """Vectors of one side: whole numbers, turned, and the norms of what follows each stage."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, turn: np.ndarray):
        self.ids, self.labels, self.whole = ids, labels, x.astype(np.int64)
        self.turned = x.astype(np.float64) @ turn
        dim = x.shape[1]
        self.cuts = sorted({max(1, min(dim, round(dim * s))) for s in STAGES} | {dim})
        squares = self.turned * self.turned
        self.rest = np.stack([np.sqrt(squares[:, c:].sum(1)) for c in self.cuts], axis=1)
        self.norm = np.sqrt((self.whole.astype(np.float64) ** 2).sum(1))


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of a and rows j of b, PAIRS numbers at a time."""
    out, step = np.empty(len(i), a.dtype), max(1, PAIRS // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        out[at : at + step] = np.einsum("ij,ij->i", a[i[at : at + step]], b[j[at : at + step]])
    return out


def products(a: _Side, b: _Side, needed: np.ndarray, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, product) of the fitting pairs whose product reaches what its row of a needs."""
    dim, first = a.turned.shape[1], a.cuts[0]
    # rounding of a rotated product: far below this share of the norms, and one for sums of whole numbers
    slack = 64 * dim * np.finfo(np.float64).eps
    need = needed.astype(np.float64) - 1.0
    part = a.turned[:, :first] @ b.turned[:, :first].T
    bound = part + np.outer(a.rest[:, 0] + slack * a.norm, b.rest[:, 0]) + np.outer(slack * a.norm, b.norm)
    i, j = np.nonzero((bound >= need[:, None]) & fits)
    part = part[i, j]
    for stage in range(1, len(a.cuts)):
        low, high = a.cuts[stage - 1], a.cuts[stage]
        part = part + _dots(a.turned[:, low:high], b.turned[:, low:high], i, j)
        keep = part + a.rest[i, stage] * b.rest[j, stage] + 2 * slack * a.norm[i] * b.norm[j] >= need[i]
        i, j, part = i[keep], j[keep], part[keep]
    score = _dots(a.whole, b.whole, i, j)
    keep = score >= needed[i]
    return i[keep], j[keep], score[keep]


def _kept(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group: higher scores, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    group = group[order]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    return order[rank < k]


class _Best:
    """The k best rows of each group so far, and the k-th score."""

    def __init__(self, groups: int, k: int):
        self.k, self.bound = k, np.full(groups, NONE, np.int64)
        self.group = self.ids = self.score = np.zeros(0, np.int64)

    def add(self, group: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        group, ids, score = (np.concatenate(x) for x in ((self.group, group), (self.ids, ids), (self.score, score)))
        keep = _kept(group, score, ids, self.k)
        self.group, self.ids, self.score = group[keep], ids[keep], score[keep]
        last = np.flatnonzero(np.diff(self.group, append=-1))
        full = np.diff(last, prepend=-1) == self.k
        self.bound[self.group[last[full]]] = self.score[last[full]]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.group), pa.array(self.ids), pa.array(self.score)], names=["at", "id", "score"])


FOUND = "at long, id long, score long"


def _sides(batches: Iterator[pa.RecordBatch], turn: np.ndarray) -> Iterator[_Side]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield _Side(part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2)), turn)


def _positives(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, turn: np.ndarray, k: int):
    """The k best rows of each anchor's own label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, best = _Side(ids, labels, x, turn), _Best(len(ids), k)
        for b in _sides(batches, turn):
            fits = (a.labels[:, None] == b.labels[None, :]) & (a.ids[:, None] != b.ids[None, :])
            i, j, score = products(a, b, best.bound, fits)
            best.add(i, b.ids[j], score)
        yield best.rows()

    return run


def _negatives(ids, labels, x, turn, owner: np.ndarray, wanted: np.ndarray, k: int, low: int, high: int):
    """The k best rows of other labels for each positive, given by its anchor's place and its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, best = _Side(ids, labels, x, turn), _Best(len(owner), k)
        floor = np.where(wanted < 0, 2**62, -((-low * wanted) // 100))  # low to high per cent of less than 0 is nothing
        for b in _sides(batches, turn):
            needed = np.full(len(ids), 2**62, np.int64)
            np.minimum.at(needed, owner, np.maximum(floor, best.bound))
            fits = (a.labels[:, None] != b.labels[None, :]) & (a.ids[:, None] != b.ids[None, :])
            i, j, score = products(a, b, needed, fits)
            # each survivor with each positive of its anchor; positives are sorted by anchor
            first, end = np.searchsorted(owner, i, "left"), np.searchsorted(owner, i, "right")
            many = end - first
            pair = np.repeat(np.arange(len(i)), many)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + first[pair]
            s, w = score[pair], wanted[at]
            keep = (low * w <= 100 * s) & (100 * s <= high * w) & (s >= best.bound[at])
            best.add(at[keep], b.ids[j[pair[keep]]], s[keep])
        yield best.rows()

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("at").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _mined(rows: DataFrame, block: list, turn: np.ndarray, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    ids, labels = (np.array([r[c] for r in block], np.int64) for c in ("id", "label"))
    x = np.array([r["vec"] for r in block], np.int64)
    near = _merged(rows.mapInArrow(_positives(ids, labels, x, turn, positives), FOUND), positives)
    near = near.orderBy("at", "rank").toPandas()  # at most BLOCK * positives rows
    owner, wanted = near["at"].to_numpy(np.int64), near["score"].to_numpy(np.int64)
    far = _merged(rows.mapInArrow(_negatives(ids, labels, x, turn, owner, wanted, negatives, low, high), FOUND), negatives)
    names = pa.table({"at": np.arange(len(owner)), "anchor_id": ids[owner], "positive_id": near["id"].to_numpy(np.int64), "positive_score": wanted})
    found = far.join(F.broadcast(spark.createDataFrame(names)), "at")
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(
    vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score; anchors: a condition on the id column."""
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = usable(vectors, id_col, vec_col, label)
    common = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    found: DataFrame | None = None
    if common is not None:
        rows = rows.where(F.size("vec") == common["dim"])
        turn = rotation(rows, common["dim"])
        asked = rows.withColumnRenamed("id", id_col).where(anchors).withColumnRenamed(id_col, "id")
        asked = asked.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row")).select("id", "row.*")
        block: list = []
        for row in stored(asked, "negatives-anchors").toLocalIterator():
            block.append(row)
            if len(block) == BLOCK:
                found = _with(found, stored(_mined(rows, block, turn, positives, negatives, low, high), "negatives-found"))
                block = []
        if block:
            found = _with(found, stored(_mined(rows, block, turn, positives, negatives, low, high), "negatives-found"))
    return found if found is not None else vectors.sparkSession.createDataFrame([], schema)


def _with(before: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if before is None else before.unionByName(more)


#: DuckDB SQL for anchors divisible by 50, 5 positives and 3 negatives each.
MINED_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0
), pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN p USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
