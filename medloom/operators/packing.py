"""Rows of ordered groups packed greedily into chunks of a bounded size, however long a group is.

What a chunk holds depends on all rows before it, so a group cannot simply be split. But what a run of rows does to the size
of the open chunk is a function with few values: given the size so far, the first row that no longer fits is the same for
all sizes between two sums. So rows are sorted over the whole table and cut into blocks; each block inside one group
tabulates that function, the driver passes the open chunk through the blocks (one table at a time), and a second pass
numbers the chunks of every block from what it begins with. Memory is bounded by a block, and a group of any length is worked
on by as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.sources.shared import stored

BLOCK = 1 << 16


def breaks(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For a chunk that begins at each row: the first row that does not fit any more (the number of rows if all do). And sums."""
    sums = np.cumsum(sizes, dtype=np.int64)
    before = sums - sizes
    found = np.searchsorted(sums, before + most, "right")
    inside = np.minimum(found, len(sizes) - 1)
    # nothing is left behind: a chunk whose rows so far are empty takes the next one, whatever its size
    empty = (found < len(sizes)) & (before[inside] == before)
    return np.where(empty, found + 1, found), sums


def first_break(sums: np.ndarray, used: int, most: int, at: int = 0) -> int:
    """The first row from `at` on that does not fit into a chunk that holds `used` already."""
    base = int(sums[at - 1]) if at else 0
    found = max(at, int(np.searchsorted(sums, base + most - used, "right")))
    empty = not used and found < len(sums) and (found == at or sums[found - 1] == base)
    return found + 1 if empty else found


def passed(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(used, chunks) after the rows for each size from 0 to most + 1 of the chunk that is open before them."""
    n = len(sizes)
    after, sums = breaks(sizes, most)
    used, chunks = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        j = int(after[i])
        if j < n:
            used[i], chunks[i] = used[j], chunks[j] + 1
        else:
            used[i] = sums[-1] - (sums[i] - sizes[i])
    start = np.arange(most + 2)
    at = np.searchsorted(sums, most - start, "right")
    at[0] = first_break(sums, 0, most)
    whole = at >= n
    inside = np.minimum(at, n)
    return np.where(whole, start + sums[-1], used[inside]), np.where(whole, 0, chunks[inside] + 1)


def numbered(sizes: np.ndarray, most: int, used: int, chunk: int) -> tuple[np.ndarray, int, int]:
    """The chunk of each row, and the open chunk's size and number after them."""
    out, sums, at = np.empty(len(sizes), np.int64), np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        end = first_break(sums, used, most, at)
        out[at:end] = chunk
        if end >= len(sizes):
            return out, used + int(sums[-1] - (sums[at - 1] if at else 0)), chunk
        at, used, chunk = end, 0, chunk + 1
    return out, used, chunk


def _edges(keys: pa.Array) -> np.ndarray:
    """Where groups begin in sorted keys; nulls are a group."""
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.diff(codes, prepend=-1))


def _blocks(size: int):
    """Sorted rows as one row for each `size` of them: the task's number, the block's, and lists of its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def cut(n: int) -> pa.RecordBatch:
            nonlocal held, rows, number
            table = pa.Table.from_batches(held)
            now, rest = table.slice(0, n), table.slice(n)
            held, rows = rest.combine_chunks().to_batches(), rest.num_rows
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays(c.chunks)) for c in now.columns]
            out = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), *lists], names=["part", "number", "keys", "orders", "sizes"])
            number += 1
            return out

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            while rows >= size:
                yield cut(size)
        if rows:
            yield cut(rows)

    return run


def _states(most: int):
    """For each block: its first and last key, whether it is of one group, the open chunk after it, and for blocks of one
    group the function from the open chunk before to that after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, number, keys, sizes = (batch.column(c)[i] for c in range(4))
                keys, sizes = keys.values, sizes.values.to_numpy(zero_copy_only=False)
                starts = _edges(keys)
                if len(starts) == 1:
                    used, chunks = passed(sizes, most)
                else:
                    _, u, c = numbered(sizes[starts[-1] :], most, 0, 0)
                    used, chunks = np.array([u]), np.array([c])
                ends = keys.take(pa.array([0, len(keys) - 1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()]), pa.array([number.as_py()]), ends.slice(0, 1), ends.slice(1, 1), pa.array([used.astype("<i8").tobytes()]), pa.array([chunks.astype("<i8").tobytes()])],
                    names=["part", "number", "first", "last", "used", "chunks"],
                )

    return run


def _packed(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, orders, sizes, used, chunk = (batch.column(c)[i] for c in range(5))
                keys, orders, rows = keys.values, orders.values, sizes.values.to_numpy(zero_copy_only=False)
                cuts = np.append(_edges(keys), len(rows))
                out = np.empty(len(rows), np.int64)
                state = used.as_py(), chunk.as_py()
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    out[a:b] = numbered(rows[a:b], most, *state)[0]
                    state = 0, 0
                yield pa.RecordBatch.from_arrays([keys, orders, sizes.values, pa.array(out)], names=["key", "order", "size", "chunk"])

    return run


def packed(rows: DataFrame, key: str, order: str, size: str, most: int, block: int = BLOCK) -> DataFrame:
    """(key, order, size, chunk): the number, from 0, of the chunk of each row.

    Within a key, rows go by order (nulls first, then size); a row that would lift an open, non-empty chunk above `most`
    begins the next one, so a row larger than that is alone unless only empty rows came before it. A null size counts 0, a
    negative one is an error; a null key is a group; equal rows are rows of their own; an empty table gives none.
    """
    kinds = dict(rows.dtypes)
    counted = F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))
    counted = F.when(counted < 0, F.raise_error(F.lit("a size is negative")).cast("long")).otherwise(counted)
    flat = rows.select(F.col(key).alias("key"), F.col(order).alias("order"), counted.alias("size"))
    ordered = flat.repartitionByRange("key", "order", "size").sortWithinPartitions("key", "order", "size")
    shape = f"part long, number long, keys array<{kinds[key]}>, orders array<{kinds[order]}>, sizes array<long>"
    blocks = stored(ordered.mapInArrow(_blocks(block), shape), "packing-blocks")
    states = blocks.select("part", "number", "keys", "sizes").mapInArrow(
        _states(most), f"part long, number long, first {kinds[key]}, last {kinds[key]}, used binary, chunks binary"
    )
    begun, last, used, chunk = [], None, 0, 0
    for i, b in enumerate(stored(states, "packing-states").orderBy("part", "number").toLocalIterator()):
        goes_on = i > 0 and b["first"] == last
        if goes_on:
            begun.append((b["part"], b["number"], used, chunk))
        after, more = np.frombuffer(b["used"], "<i8"), np.frombuffer(b["chunks"], "<i8")
        at = min(used, most + 1) if goes_on and len(after) > 1 else 0
        # past the bound the next row begins a chunk for any size, and what was used before does not matter
        add = chunk if goes_on and len(after) > 1 else 0
        last, used, chunk = b["last"], int(after[at]), add + int(more[at])
    entries = rows.sparkSession.createDataFrame(begun, "part long, number long, used long, chunk long")
    found = blocks.join(entries, ["part", "number"], "left").select("keys", "orders", "sizes", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("used", "chunk")])
    out = found.mapInArrow(_packed(most), f"key {kinds[key]}, order {kinds[order]}, size long, chunk long")
    return out.select(F.col("key").alias(key), F.col("order").alias(order), F.col("size").alias(size), "chunk")
