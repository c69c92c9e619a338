"""Uniform sharding with exact sizes through a hypergeometric communication matrix.

A uniform shuffle that fills S shards with exactly known sizes decides, for each input partition, how many of its rows
each shard gets. Those counts follow a multivariate hypergeometric law with both margins fixed: the rows that a
partition has, and the rows that a shard takes. So the counts are drawn first, from the partition sizes alone; each
partition permutes its own rows and deals them out by its counts; one exchange moves the rows; each shard permutes what
it got. The result is a uniform permutation cut into shards of sizes that differ by one row at most (law `rows`).

The matrix is drawn as a tree with FAN children a node, so no task sees more than FAN partitions at a time, and each
single draw walks the law outwards from its mode in about 24 standard deviations of steps. Everything is SQL
expressions. Rows move once. A partition of rows and its place in it come from the physical partition, so the input
must give the same rows in the same partitions when it is read twice: files do; any other input is stored first.

Cases: null ids and texts are rows like others (a null text has 0 bytes); equal texts and repeated rows are separate
rows and get separate slots; an empty table gives no rows; the input's columns are kept, whatever their names but `shard`
and `slot`, which raise an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medloom.llm.common import stored, unit

#: Partitions below one node of the tree; rows that one task of the second permutation takes; rows of the matrix up to
#: which it is broadcast (at 24 shards about 200 bytes each), beyond which it is joined by a shuffle.
FAN, BLOCK_ROWS, BROADCAST_ROWS = 64, 16_384, 20_000
#: monotonically_increasing_id() is the partition shifted by 33 bits plus the place in it.
PLACE_BITS = 33


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def hypergeometric(good: str, bad: str, draws: str, u: str) -> str:
    """SQL for one hypergeometric count: the good ones among `draws` from good + bad, by inversion with the number u.

    Weights relative to the mode's follow from the ratio of neighbours; they are summed once, then walked until
    the sum reaches u of the total: the mode, downwards, upwards. What lies beyond 12 standard deviations is below
    double precision.
    """
    down = "(k * (h.b - h.n + k)) / ((h.g - k + 1D) * (h.n - k + 1D))"
    up = "((h.g - k + 1D) * (h.n - k + 1D)) / (k * (h.b - h.n + k))"
    downs = "if(h.m > h.lo, sequence(h.m, h.lo + 1, -1), cast(array() as array<bigint>))"
    ups = "if(h.hi > h.m, sequence(h.m + 1, h.hi, 1), cast(array() as array<bigint>))"
    zero = "named_struct('w', 1D, 's', 0D)"
    add = "named_struct('w', a.w * ({r}), 's', a.s + a.w * ({r}))"
    total = lambda steps, r: f"aggregate({steps}, {zero}, (a, k) -> {add.format(r=r)}, a -> a.s)"
    seek = (
        "aggregate({steps}, named_struct('w', 1D, 's', {start}, 'x', {x0}), (a, k) -> named_struct("
        "'w', a.w * ({r}), 's', a.s + a.w * ({r}), 'x', if(a.s < t.t, {x}, a.x)), a -> a)"
    )
    low = seek.format(steps=downs, start="1D", x0="h.m", r=down, x="k - 1")
    high = seek.format(steps=ups, start="d.s", x0="d.x", r=up, x="k")
    shape = (
        f"named_struct('g', cast({good} as double), 'b', cast({bad} as double), 'n', cast({draws} as double), 'u', {u})"
    )
    mode = "cast(floor((q.n + 1) * (q.g + 1) / (q.g + q.b + 2)) as bigint)"
    sd = "sqrt(greatest(0D, q.n * q.g / (q.g + q.b) * q.b / (q.g + q.b) * (q.g + q.b - q.n) / greatest(1D, q.g + q.b - 1)))"
    least, most = "cast(greatest(0D, q.n - q.b) as bigint)", "cast(least(q.n, q.g) as bigint)"
    bound = _let(
        f"named_struct('m', least(greatest({mode}, {least}), {most}), 'd', cast(ceil(12 * {sd}) as bigint) + 16)", "z",
        f"named_struct('g', q.g, 'b', q.b, 'n', q.n, 'u', q.u, 'm', z.m, 'lo', greatest({least}, z.m - z.d), "
        f"'hi', least({most}, z.m + z.d))",
    )
    walk = _let(f"named_struct('t', h.u * (1D + {total(downs, down)} + {total(ups, up)}))", "t",
                _let(low, "d", f"{high}.x"))
    drawn = _let(shape, "q", _let(bound, "h", walk))
    return f"if({good} <= 0 or {draws} <= 0, 0L, if({bad} <= 0, cast({draws} as bigint), {drawn}))"


def split_quotas(caps: str, draws: str, seed: int, node: str) -> str:
    """SQL for a multivariate hypergeometric draw: how many of `draws` fall on each of the capacities `caps` (array)."""
    u = f"shiftrightunsigned(xxhash64({seed}, {node}, s.i), 11) * {2.0**-53!r}D"
    one = hypergeometric("cap", "(s.total - cap)", "s.left", u)
    step = _let(one, "x", "named_struct('left', s.left - x, 'total', s.total - cap, 'i', s.i + 1, 'out', concat(s.out, array(x)))")
    sums = f"aggregate({caps}, 0L, (a, c) -> a + c)"
    zero = f"named_struct('left', cast({draws} as bigint), 'total', {sums}, 'i', 0, 'out', cast(array() as array<bigint>))"
    return f"aggregate({caps}, {zero}, (s, cap) -> {step}, s -> s.out)"


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(pid, n, deal array<long>): how many of the n rows of each partition every shard gets, margins exact."""
    top = counts.agg(F.max("pid"), F.sum("n")).first()
    last, rows = int(top[0] or 0), int(top[1] or 0)
    levels = max(1, math.ceil(math.log(last + 1, FAN) - 1e-9)) if last else 1
    nodes = [counts.select(F.col("pid").alias("node"), "n")]
    for _ in range(levels):
        child = F.sort_array(F.collect_list(F.struct("node", "n"))).alias("children")
        up = nodes[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(child, F.sum("n").alias("n"))
        nodes.append(up)
    sizes = [rows // shards + (s < rows % shards) for s in range(shards)]
    caps = F.array(*[F.lit(c).cast("long") for c in sizes])
    level = nodes[-1].select("node", "children", caps.alias("caps"))
    for depth in range(levels, 0, -1):
        draw = split_quotas("t.caps", "c.n", seed + depth, "c.node")
        step = _let(draw, "d", "named_struct('caps', zip_with(t.caps, d, (p, q) -> p - q), 'out', "
                               "concat(t.out, array(named_struct('node', c.node, 'caps', d))))")
        kind = "array<struct<node: bigint, caps: array<bigint>>>"
        dealt = F.expr(
            f"aggregate(children, named_struct('caps', caps, 'out', cast(array() as {kind})), (t, c) -> {step}, t -> t.out)"
        )
        below = level.select(F.explode(dealt).alias("x")).select("x.node", "x.caps")
        level = below if depth == 1 else below.join(nodes[depth - 1].select("node", "children"), "node")
    return level.join(counts.select(F.col("pid").alias("node"), "n"), "node").select(
        F.col("node").alias("pid"), "n", F.col("caps").alias("deal")
    )


def _placed(rows: DataFrame, seed: int) -> DataFrame:
    """Rows permuted inside their partitions; _pid and _pos say where each came to stand."""
    df = rows.withColumn("_first", F.monotonically_increasing_id())
    df = df.withColumn("_key", F.xxhash64(F.lit(seed), "_first")).sortWithinPartitions("_key", "_first")
    at = F.monotonically_increasing_id()
    df = df.withColumn("_at", at).drop("_key", "_first")
    pid = F.shiftright("_at", PLACE_BITS)
    return df.withColumns({"_pid": pid, "_pos": F.col("_at") - F.shiftleft(pid, PLACE_BITS)}).drop("_at")


def _dealt(placed: DataFrame, matrix: DataFrame, few: bool) -> DataFrame:
    """The shard of each row: the first whose running count passes the row's place."""
    ends = F.expr("transform(sequence(1, size(deal)), k -> aggregate(slice(deal, 1, k), 0L, (a, x) -> a + x))")
    bounds = matrix.select(F.col("pid").alias("_pid"), ends.alias("_ends"))
    df = placed.join(F.broadcast(bounds) if few else bounds, "_pid")
    shard = F.size(F.filter("_ends", lambda end: end <= F.col("_pos")))
    missed = F.raise_error(F.lit("the input gave other rows when it was read again; store it first"))
    return df.withColumn("shard", F.when(F.col("_pos") < F.element_at("_ends", -1), shard).otherwise(missed.cast("int"))).drop("_ends")


def shard_uniform(rows: DataFrame, shards: int, seed: int = 17, files: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows with `shard` (int, from 0) and `slot` (long, gapless from 0 in each shard) of a uniform permutation.

    files: rows is a bare read of files, so its partitions are the same when read again; else it is stored first.
    """
    if clash := {"shard", "slot"} & set(rows.columns):
        raise ValueError(f"columns clash with the operator's: {sorted(clash)}")
    rows = rows.select(F.struct(*rows.columns).alias("row"))
    if not files:
        rows = stored(rows, "shard-input")
    counts = stored(rows.groupBy(F.spark_partition_id().cast("long").alias("pid")).agg(F.count("*").alias("n")), "shard-counts")
    matrix = stored(communication_matrix(counts, shards, seed), "shard-matrix")
    total, parts = matrix.agg(F.sum("n"), F.count("*")).first()
    dealt = _dealt(_placed(rows, seed), matrix, parts * shards <= BROADCAST_ROWS * 24)
    blocks = max(1, math.ceil((total or 0) / shards / block_rows))
    key = F.xxhash64(F.lit(seed + 1), "_pid", "_pos")
    block = F.floor(unit(seed + 1, F.col("_pid"), F.col("_pos")) * blocks).cast("long")
    dealt = dealt.withColumns({"_key": key, "_block": block})
    sizes = dealt.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("shard").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("shard", "_block", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = W.partitionBy("shard", "_block").orderBy("_key", "_pid", "_pos")
    df = dealt.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["shard", "_block"])
    df = df.withColumn("slot", (F.col("_start") + F.col("_rank")).cast("long"))
    return df.select("row.*", "shard", "slot")


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 8 for its id."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")
