"""Approximate nearest neighbours by inner product: cross-polytope hashing with multiprobe tables and exact reranking.

Vectors are laid on the unit sphere (divided by the largest norm of their band, with one coordinate that fills up the
length, so that the nearest by angle are the nearest by inner product), turned by three rounds of random signs and a fast Hadamard
transform, and hashed to the nearest signed axis: the largest coordinate by size and its sign. TABLES independent
turns make as many tables; a query visits in each the `probes` buckets whose axes it is nearest to. Every row is
indexed. A band holds rows whose norms differ by a quarter at most and has buckets of its own, which a query visits with
the same axes, so few long vectors do not push the others together; where all norms are alike there is one band. What a bucket gives is scored exactly, in double precision on the original vectors.

A first pass visits each query's nearest bucket per table and gives a lower bound of its k-th score; the second visits
all probes and hands on what reaches that bound, at most k a query and tile, from the first table that meets it. Buckets
are cut into tiles of TILE rows by counting them first, so a vector that a third of the rows share is spread; a tile
keeps its rows in memory and reads its queries as a stream. A query that found fewer than k although there are more
rows is compared with all rows, tile by tile. With `functions` = 2 a bucket is a pair of axes, for tables of billions.

Cases: vectors that are null, zero, of another length than most, or with null or non-finite components take no part, nor do
rows without an id; equal vectors tie and go by the smaller id; a repeated id stands for each of its rows, a query's for one; with fewer
candidates than k all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medloom.llm.common import stored

TABLES, PROBES, TILE, QUERIES = 12, 18, 2048, 256
SLACK = 1e-6
#: The factor between the norms of a band.
BAND = 1.25
ROW = "t int, bucket int, probe int, band int, id long, vec binary, codes binary"


# --- hashing --------------------------------------------------------------------------------------------------------


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows, without its scale."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x


def turned(x: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """Rows under the pseudo-random rotation of a number; the rows' length is a power of two."""
    rng = np.random.default_rng([seed, turn])
    for _ in range(3):
        x = _hadamard(x * rng.choice([-1.0, 1.0], x.shape[1])) / np.sqrt(x.shape[1])
    return x


def _on_sphere(x: np.ndarray, most: float | np.ndarray) -> np.ndarray:
    """Rows divided by the largest norm (of each row's band) and filled up to length one, padded to a power of two."""
    x = x / np.reshape(most, (-1, 1))
    rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))
    width = 1 << int(x.shape[1]).bit_length()
    return np.concatenate([x, rest[:, None], np.zeros((len(x), width - x.shape[1] - 1))], axis=1)


def axes(x: np.ndarray, t: int, functions: int, probes: int, seed: int) -> np.ndarray:
    """The nearest buckets (row, probe) of table t, nearest first; an axis is 2 * coordinate + (1 if negative)."""
    best = None
    for f in range(functions):
        y = turned(x, t * functions + f, seed)
        signed = np.stack([y, -y], axis=2).reshape(len(y), -1)
        want = min(probes, signed.shape[1])
        at = np.argpartition(-signed, want - 1, axis=1)[:, :want] if want < signed.shape[1] else np.tile(np.arange(want), (len(y), 1))
        score = np.take_along_axis(signed, at, 1)
        if best is None:
            code, total = at, score
        else:
            code = (code[:, :, None] * signed.shape[1] + at[:, None, :]).reshape(len(y), -1)
            total = (total[:, :, None] + score[:, None, :]).reshape(len(y), -1)
        best = np.argsort(-total, axis=1, kind="stable")[:, :probes]
        code, total = np.take_along_axis(code, best, 1), np.take_along_axis(total, best, 1)
    return code.astype(np.int32)


def code_kind(dim: int, functions: int) -> str:
    """The smallest unsigned number that holds a bucket."""
    buckets = (2 << int(dim).bit_length()) ** functions
    return "<u1" if buckets <= 256 else "<u2" if buckets <= 65_536 else "<u4"


def _indexed(dim: int, most: dict[int, float], kind: str, functions: int, probes: int, seed: int, as_query: bool):
    """Rows (id, vec, band) as a row for each table and visited bucket; codes: all visited buckets of all tables.

    most: the largest norm of each band. A query is a direction, the same for all bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = part.column(0).to_numpy()
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(kind)
                band = part.column(2).to_numpy()
                wide = x.astype(np.float64)
                largest = np.linalg.norm(wide, axis=1) if as_query else np.array([most[b] for b in band.tolist()])
                sphere = _on_sphere(wide, largest)
                codes = np.stack([axes(sphere, t, functions, probes, seed) for t in range(TABLES)], axis=1)
                raw = [v.tobytes() for v in x]
                own = [c.tobytes() for c in codes.astype(code_kind(dim, functions))]
                for t in range(TABLES):
                    for p in range(codes.shape[2]):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(ids), t, np.int32)), pa.array(np.ascontiguousarray(codes[:, t, p])),
                             pa.array(np.full(len(ids), p, np.int32)), pa.array(band, pa.int32()), pa.array(ids), pa.array(raw, pa.binary()), pa.array(own, pa.binary())],
                            names=["t", "bucket", "probe", "band", "id", "vec", "codes"],
                        )

    return run


# --- scoring --------------------------------------------------------------------------------------------------------


def _best(points, queries, t: int, k: int, kind: str, code: str) -> list[np.ndarray]:
    """(query, id, score) of the k nearest points of a tile for each query that reach its bound."""
    p_ids, p_vecs, p_codes = points
    q_ids, q_vecs, q_codes, bound = queries
    x, q = (np.frombuffer(b"".join(v), kind).reshape(len(v), -1).astype(np.float64) for v in (p_vecs, q_vecs))
    rough = q @ x.T
    i, j = np.nonzero((rough >= (bound - SLACK * (1 + np.abs(bound)))[:, None]) & (q_ids[:, None] != p_ids[None, :]))
    if t:
        mine = np.frombuffer(b"".join(p_codes), code).reshape(len(p_codes), TABLES)
        seen = np.frombuffer(b"".join(q_codes), code).reshape(len(q_codes), TABLES, -1)
        new = np.ones(len(i), bool)
        for s in range(0, len(i), 65_536):
            a, b = i[s : s + 65_536], j[s : s + 65_536]
            new[s : s + 65_536] = ~(seen[a, :t] == mine[b, :t, None]).any((1, 2))
        i, j = i[new], j[new]
    score = np.empty(len(i))
    for s in range(0, len(i), 65_536):
        score[s : s + 65_536] = (q[i[s : s + 65_536]] * x[j[s : s + 65_536]]).sum(1)
    order = np.lexsort((p_ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
    keep = (rank < k) & (score >= bound[i])
    return [q_ids[i[keep]], p_ids[j[keep]], score[keep]]


def _scored(k: int, kind: str, code: str):
    """A stream sorted by (tile, role): a tile's points first, then the queries that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, points = None, []
        for batch in batches:
            pdf = batch.to_pandas()
            key = pd.factorize(pd.MultiIndex.from_frame(pdf[["t", "bucket", "band", "tile", "role"]]))[0]
            cuts = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(pdf))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = pdf.iloc[a:b]
                now = tuple(part[["t", "bucket", "band", "tile"]].iloc[0])
                if now != tile:
                    tile, points = now, []
                if part["role"].iloc[0] == 0:
                    points.append(part)
                    continue
                if not points:
                    continue
                have = pd.concat(points) if len(points) > 1 else points[0]
                points = [have]
                side = have["id"].to_numpy(), have["vec"].tolist(), have["codes"].tolist()
                for s in range(0, len(part), QUERIES):
                    some = part.iloc[s : s + QUERIES]
                    queries = some["id"].to_numpy(), some["vec"].tolist(), some["codes"].tolist(), some["bound"].to_numpy()
                    out = _best(side, queries, int(now[0]), k, kind, code)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["query_id", "vec_id", "score"])

    return run


def _searched(points: DataFrame, queries: DataFrame, k: int, kind: str, code: str) -> DataFrame:
    """Scores of the points (t, bucket, tile, ...) for the queries that visit their tile."""
    points = points.withColumns({"role": F.lit(0), "bound": F.lit(0.0)})
    queries = queries.withColumn("role", F.lit(1))
    columns = ["t", "bucket", "band", "tile", "role", "id", "vec", "codes", "bound"]
    rows = points.select(columns).unionByName(queries.select(columns))
    rows = rows.repartition("t", "bucket", "band", "tile").sortWithinPartitions("t", "bucket", "band", "tile", "role")
    return rows.mapInArrow(_scored(k, kind, code), "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the vectors that take part, except for their length."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    return rows.where("id is not null and vec is not null").where(~F.coalesce(bad, F.lit(True)) & some)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, probes: int = PROBES, functions: int = 1, seed: int = 8,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank from 1, vec_id and score: for each query its k nearest of the other vectors found."""
    points = usable(vectors, id_col, vec_col)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # the middle of a band is a power, so that norms which should be one are in one band; norms beyond doubles are alike
    band = F.floor(F.log(F.greatest(F.least(norm, F.lit(1e300)), F.lit(1e-300))) / math.log(BAND) + 0.5).cast("int").alias("band")
    sizes = points.groupBy(F.size("vec").alias("dim"), band).agg(F.count("*").alias("n"), F.max(norm).alias("most"))
    total_of = sizes.groupBy("dim").agg(F.sum("n").alias("n"))
    common = total_of.orderBy(F.col("n").desc(), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, total = common
    # at most a few thousand bands between the smallest and the largest double
    most = {r["band"]: r["most"] for r in sizes.where(F.col("dim") == dim).collect()}
    kind = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"
    some, code = F.size("vec") == dim, code_kind(dim, functions)
    index = points.where(some).select("id", "vec", band).mapInArrow(_indexed(dim, most, kind, functions, 1, seed, False), ROW)
    asked = usable(queries, id_col, vec_col).where(some).dropDuplicates(["id"])
    asked = asked.select("id", "vec", F.lit(0).alias("band")).mapInArrow(_indexed(dim, most, kind, functions, probes, seed, True), ROW).drop("band")
    index, asked = stored(index, "ann-index"), stored(asked, "ann-queries")

    tiles = index.groupBy("t", "bucket", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    if functions == 1:
        tiles = F.broadcast(tiles)  # at most TABLES rows for each of the 2 * dim + 2 (rounded up) axes and each band
    index = index.join(tiles, ["t", "bucket", "band"]).withColumn("tile", F.pmod(F.hash("id"), "tiles"))
    asked = asked.join(tiles, ["t", "bucket"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))

    lowest = F.lit(float("-inf"))
    first = asked.where("probe = 0").withColumn("bound", lowest)
    bounds = _top(_searched(index, first, k, kind, code), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    bounds = stored(bounds, "ann-bounds")
    second = asked.join(bounds, asked["id"] == bounds["query_id"], "left").withColumn("bound", F.coalesce("bound", lowest))
    found = stored(_top(_searched(index, second, k, kind, code), k), "ann-found")

    short = asked.select("id", "vec").dropDuplicates(["id"]).join(
        found.where(F.col("rank") == min(k, max(total - 1, 1))), F.col("id") == F.col("query_id"), "left_anti"
    )
    if total > 1 and short.limit(1).count():
        blocks = max(1, -(-total // TILE))
        every = index.where("t = 0").withColumns({"bucket": F.lit(0), "band": F.lit(0), "tile": F.pmod(F.hash("id"), F.lit(blocks)), "codes": F.lit(b"")})
        again = short.withColumns({"t": F.lit(0), "bucket": F.lit(0), "band": F.lit(0), "codes": F.lit(b""), "bound": lowest})
        again = again.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        rest = _top(_searched(every, again, k, kind, code), k)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
