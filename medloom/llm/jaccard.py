"""N-gram Jaccard self-join: size-banded tiles, hashed bitmap bounds, exact intersection of sorted arrays.

Two documents link when their sets of 5-word shingles have a Jaccard similarity of 0.75 or more. All steps are exact:

1. Count, over all documents, how many hold each shingle (a shuffle of packed counts); those that `frequent` documents or
   more hold are the frequent ones, with the binary logarithm of their count as their class.
2. Order shingles by (class, hash), so the rare ones come first. Sets that link share a shingle among the first
   n - ceil(3n/4) + 1 of both. These are a set's keys. Keys that are not frequent meet in packed parts of even size, where
   those that only one set has are dropped; the frequent ones, which could fill a part, are rows of their own.
3. Equal sets are one node. Nodes next to each other under a key are compared, in an order that changes from round to
   round, which joins whole groups of near copies by chains instead of by all pairs.
4. What is still open meets by key, as Spark groups of bounded size. Keys that fill several tiles are cut by size band and
   hash, and pairs of tiles meet; sizes of linked sets differ by a third at most, so only bands next to each other do. Of
   the sets under such keys, those with more than a seventh of shingles that no other such set has never link with each
   other, so they are not compared: pages of a common template with some text of their own. Folded bitmaps are tested as
   rows meet, and a pair that shares several keys is found under the smallest of them only: rows carry their smaller keys.

Every candidate pair, of 3 and of 4, passes the bitmap bound first: with d differing bits two sets share at most
(a + b - d) / 2 shingles. Bitmaps grow with the sets (a wide one is folded to meet a narrow one), so long sets do not
saturate. What the bound does not exclude is intersected exactly; only these sets are computed again from their texts.

Nothing is capped. The frequent shingles are broadcast up to `frequent_rows` rows (2 million: 24 MB), else joined.
Sets are 64-bit hashes, nodes 64-bit hashes of sets: among 1e9 different texts a collision of nodes is expected with a
probability of 0.03. Keys are cut to about 6 bits more than the text's bytes count, which can only add candidates.

Cases: a null or wordless text has an empty set and links with nothing; a text of fewer than five words has its whole
word sequence as its only shingle; repeated rows and ids are separate documents; a null id takes part, but is never the
smallest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.llm.cc import components
from medloom.llm.common import released, stored
from medloom.llm.shingles import mixed, shingles

#: Shingles gathered before a task hands them on; shingles that a reducing group should hold; documents handled at a
#: time; nodes that a task remembers to have handed on.
FLUSH, GROUP, BATCH, SEEN = 1_000_000, 2_000_000, 500, 100_000
#: Bytes of rows handled at a time.
SLICE = 4 << 20
#: Pairs that a task gathers before it hands on the distinct ones; neighbours compared in later rounds; open pairs a row
#: that the last step may compare; rounds.
HELD, REACH, FEW, MOST_ROUNDS = 1_000_000, 3, 0.5, 16
#: Bytes of the bitmaps that rows of tiles carry, with few and with many pairs a row; smaller keys that they carry at most.
TILE_BYTES, SMALLER_KEYS = (64, 1024), 12
#: Size bands are a little wider than a factor of 4/3, so that linked sets are in the same or in neighbouring ones.
BAND = math.log(1.334)


@dataclass(frozen=True)
class Limits:
    """How work is cut up; no result depends on it."""

    frequent: int = 64  # documents that make a shingle frequent
    frequent_rows: int = 2_000_000  # frequent shingles that may be broadcast
    salt_rows: int = 4096  # rows of a key that are dealt to one part
    tile: int = 1024  # nodes in a tile
    light: float = 20  # pairs a row up to which rows of tiles carry short bitmaps


LIMITS = Limits()


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number of common shingles of linked sets: 100 i >= 75 (a + b - i)."""
    return -(-3 * (a + b) // 7)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most BATCH rows and, on average, SLICE bytes."""
    for batch in batches:
        step = max(1, min(BATCH, batch.num_rows * SLICE // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


# --- 1. frequent shingles -------------------------------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, all lowest bytes first: small numbers compress to their low bytes."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _flushed(parts: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Gathered hashes by their leading bits: the next 32 bits as differences, and how often each came."""
    values, counts = np.unique(np.concatenate(parts) >> np.uint64(32 - bits), return_counts=True)
    group = (values >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    ends = np.append(cuts[1:], len(values))
    each = list(zip(cuts, ends, strict=True))
    return pa.RecordBatch.from_pydict({
        "part": pa.array(group[cuts], pa.int64()),
        "low": pa.array([_planes(np.diff(low[i:j], prepend=np.uint32(0))) for i, j in each], pa.binary()),
        "n": pa.array([_planes(counts[i:j]) for i, j in each], pa.binary()),
    })


def _gathered(bits: int, values: Callable[[pa.RecordBatch], Iterable[np.ndarray]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for batch in sliced(batches):
        for x in values(batch):
            parts.append(x)
            held += len(x)
            if held >= FLUSH:
                yield _flushed(parts, bits)
                parts, held = [], 0
    if held:
        yield _flushed(parts, bits)


def _lows(rows: pa.Table) -> np.ndarray:
    return np.concatenate([np.cumsum(_numbers(x.as_buffer()), dtype=np.uint32) for x in rows["low"]])


def _counted(least: int, rows: pa.Table) -> pa.Table:
    low, n = _lows(rows), np.concatenate([_numbers(x.as_buffer()) for x in rows["n"]]).astype(np.int64)
    order = np.argsort(low, kind="stable")
    low, n = low[order], n[order]
    starts = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-1))
    n = np.add.reduceat(n, starts)
    keep = n >= least
    short = low[starts][keep].astype(np.int64) + (rows["part"][0].as_py() << 32)
    return pa.table({"short": short, "kind": np.log2(n[keep]).astype(np.int32)})


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def frequent(rows: DataFrame, values: Callable[[pa.RecordBatch], Iterable[np.ndarray]], many: float, least: int) -> tuple[DataFrame, int]:
    """(short, kind) of the hashes that come `least` times or more, and how many leading bits `short` has beyond 32.

    values gives the hashes of a batch of rows, each document's distinct ones; many: about how many there are in all.
    """
    bits = min(30, max(4, math.ceil(math.log2(max(1.0, many / GROUP)))))
    parts = rows.mapInArrow(partial(_gathered, bits, values), "part long, low binary, n binary")
    return stored(parts.groupBy("part").applyInArrow(lambda rows: _counted(least, rows), "short long, kind int"), "shingle-frequent"), bits


def _of_texts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for text in batch.column(0).cast(pa.binary()):
        yield shingles(text.as_py())


@dataclass(frozen=True)
class Kinds:
    """The classes of hashes: sorted leading bits of the frequent ones and their classes."""

    short: np.ndarray
    kind: np.ndarray
    bits: int

    def of(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.int32)
        if len(self.short):
            mine = (s >> np.uint64(32 - self.bits)).astype(np.int64)
            at = np.minimum(np.searchsorted(self.short, mine), len(self.short) - 1)
            hit = self.short[at] == mine
            out[hit] = self.kind[at[hit]]
        return out


def _sorted_kinds(short: np.ndarray, kind: np.ndarray, bits: int) -> Kinds:
    order = np.argsort(short, kind="stable")
    return Kinds(short[order], kind[order], bits)


# --- 2. keys --------------------------------------------------------------------------------------------------------


def cut_keys(hashes: np.ndarray, key_bits: int) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(64 - key_bits)).view(np.int64)


def key_bits_for(size: int) -> int:
    """Bits of a key, so that leading ones beyond 32 make parts of some 3 million keys of a text of `size` bytes."""
    return min(62, max(36, math.ceil(math.log2(max(2, size))) + 6))


def _keys(kinds: Kinds, s: np.ndarray, key_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set, distinct: those that are not frequent, and those that are."""
    first = len(s) - -(-3 * len(s) // 4) + 1
    kind = kinds.of(s)
    at = np.lexsort((s, kind))[:first] if kind.any() else np.arange(first)
    keys, hot = cut_keys(s[at], key_bits), kind[at] > 0
    return np.unique(keys[~hot]), np.unique(keys[hot])


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.astype("<u8").tobytes()) - (1 << 63)


def bitmap(s: np.ndarray) -> bytes:
    """Four times as many bits as the set has members, rounded up to a power of two, 64 at least."""
    width = max(64, 1 << (4 * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (row, bytes) brought to a smaller width."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, width), axis=1) if bits.shape[1] > width else bits


def unseen(node: int, seen: set[int]) -> bool:
    """Whether a task meets a node for the first time, as far as it remembers."""
    if node in seen:
        return False
    if len(seen) >= SEEN:
        seen.clear()
    seen.add(node)
    return True


_SET_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
_SET_SCHEMA = "n long, node long, bits binary, keys array<long>, hot array<long>"


def _documents(known, bits: int, key_bits: int):
    """Rows (doc_id, mark, text[, marks]) as sets; equal sets that a task meets again come without bits and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, seen = (Kinds(*known.value, bits) if known else None), set()
        for batch in sliced(batches):
            rows = []
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                s = shingles(text.as_py())
                node = node_of(s) if len(s) else None
                if node is None or not unseen(node, seen):
                    rows.append((len(s), node, None, None, None))
                    continue
                if not known:
                    own = batch.column(3)[i].as_py() or []
                    kinds = _sorted_kinds(np.array([x["short"] for x in own], np.int64), np.array([x["kind"] for x in own], np.int32), bits)
                rows.append((len(s), node, bitmap(s), *_keys(kinds, s, key_bits)))
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(_SET_TYPES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "mark", "n", "node", "bits", "keys", "hot"])

    return run


def _shorts(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (uid, text) as (uid, short) for each shingle."""
    for batch in sliced(batches):
        for uid, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
            short = np.unique(shingles(text.as_py()) >> np.uint64(32 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(short), uid.as_py())), pa.array(short)], names=["uid", "short"])


def broadcast_kinds(found: DataFrame, bits: int, most: int):
    """The frequent hashes as a broadcast (short, kind), sorted; None where there are more than `most`."""
    if found.count() > most:
        return None
    rows = found.toArrow()
    kinds = _sorted_kinds(rows["short"].to_numpy(), rows["kind"].to_numpy(), bits)
    return found.sparkSession.sparkContext.broadcast((kinds.short, kinds.kind))


def _sets(docs: DataFrame, size: int, limits: Limits) -> DataFrame:
    """Rows (doc_id, mark, text) as (doc_id, mark, n, node, bits, keys, hot); mark is a hash of the text."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, mark long, {_SET_SCHEMA}"
    found, bits = frequent(docs.select("text"), _of_texts, size / 6, limits.frequent)
    key_bits = key_bits_for(size)
    if known := broadcast_kinds(found, bits, limits.frequent_rows):
        return docs.mapInArrow(_documents(known, bits, key_bits), schema)
    numbered = stored(docs.withColumn("uid", F.monotonically_increasing_id()), "shingle-numbered")
    marks = numbered.select("uid", "text").mapInArrow(partial(_shorts, bits), "uid long, short long").join(found, "short")
    marks = marks.groupBy("uid").agg(F.collect_list(F.struct("short", "kind")).alias("marks"))
    rows = numbered.join(marks, "uid", "left").select("doc_id", "mark", "text", "marks")
    return rows.mapInArrow(_documents(None, bits, key_bits), schema)


def _part_rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Gathered (nodes, keys) by the leading bits of the keys: their last 32 bits as differences, and the nodes."""
    nodes, keys = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, nodes = keys[order], nodes[order]
    group, low = keys >> 32, (keys & 0xFFFFFFFF).astype(np.uint32)
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    each = list(zip(cuts, np.append(cuts[1:], len(keys)), strict=True))
    return pa.RecordBatch.from_pydict({
        "part": pa.array(group[cuts], pa.int64()),
        "low": pa.array([_planes(np.diff(low[i:j], prepend=np.uint32(0))) for i, j in each], pa.binary()),
        "nodes": pa.array([nodes[i:j].tobytes() for i, j in each], pa.binary()),
    })


@dataclass(frozen=True)
class Lists:
    """How rows (node, keys) are read: `whole` keys are hashes yet to be cut to key_bits."""

    key_bits: int
    whole: bool = False

    def of(self, column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(all keys, where each row's end; rows are cut at these from the first on)."""
        ends = column.offsets.to_numpy()
        flat = column.values.to_numpy()[ends[0] : ends[-1]]
        return cut_keys(flat.view(np.uint64), self.key_bits) if self.whole else flat, ends - ends[0]

    def hashes(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """The keys as hashes of 64 bits, which `frequent` counts."""
        yield self.of(batch.column(0))[0].view(np.uint64) << np.uint64(64 - self.key_bits)

    def hot(self, keys: np.ndarray, kinds: Kinds) -> np.ndarray:
        return kinds.of(keys.view(np.uint64) << np.uint64(64 - self.key_bits)) > 0


def _parts(lists: Lists, known, bits: int):
    """Rows (node, keys) packed, without the frequent keys if these are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, parts, held = (Kinds(*known.value, bits) if known else None), [], 0
        for batch in sliced(batches):
            keys, ends = lists.of(batch.column(1))
            nodes = np.repeat(batch.column(0).to_numpy(), np.diff(ends))
            if kinds:
                cold = ~lists.hot(keys, kinds)
                keys, nodes = keys[cold], nodes[cold]
            parts.append((nodes, keys))
            held += len(keys)
            if held >= FLUSH:
                yield _part_rows(parts)
                parts, held = [], 0
        if held:
            yield _part_rows(parts)

    return run


def _hot_rows(lists: Lists, known, bits: int):
    """Rows (node, keys) as (key, node) for the frequent keys, or for all if these are not known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds(*known.value, bits) if known else None
        for batch in sliced(batches):
            keys, ends = lists.of(batch.column(1))
            nodes = np.repeat(batch.column(0).to_numpy(), np.diff(ends))
            hot = lists.hot(keys, kinds) if kinds else np.ones(len(keys), bool)
            yield pa.RecordBatch.from_arrays([pa.array(keys[hot]), pa.array(nodes[hot])], names=["key", "node"])

    return run


def _met(rows: pa.Table) -> pa.Table:
    """The rows of a part whose key several nodes have."""
    low, node = _lows(rows), np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in rows["nodes"]])
    order = np.lexsort((node, low))
    low, node = low[order], node[order]
    fresh = np.append(True, (low[1:] != low[:-1]) | (node[1:] != node[:-1]))
    low, node = low[fresh], node[fresh]
    same, keep = low[1:] == low[:-1], np.zeros(len(low), bool)
    keep[1:] |= same
    keep[:-1] |= same
    return pa.table({"key": low[keep].astype(np.int64) + (rows["part"][0].as_py() << 32), "node": node[keep]})


def meeting(rows: DataFrame, lists: Lists, known=None, bits: int = 0) -> DataFrame:
    """(key, node) for the keys that several nodes have, of rows (node, keys) without their frequent keys."""
    packed = rows.where(F.size("keys") > 0).mapInArrow(_parts(lists, known, bits), "part long, low binary, nodes binary")
    return packed.groupBy("part").applyInArrow(lambda part: _met(part), "key long, node long")


def meeting_lists(rows: DataFrame, lists: Lists, limits: Limits = LIMITS) -> DataFrame:
    """(key, node) for the keys that several nodes have, of rows (node, keys); any key may be frequent.

    Frequent keys are told by an exact count and go as rows of their own, so that no part grows with one of them; where
    there are too many of them to broadcast, all keys go as rows that an aggregate counts.
    """
    rows = rows.where(F.size("keys") > 0)
    many = rows.agg(F.sum(F.size("keys"))).first()[0] or 0
    found, bits = frequent(rows.select("keys"), lists.hashes, many, limits.frequent)
    known = broadcast_kinds(found, bits, limits.frequent_rows)
    if known:
        hot = rows.mapInArrow(_hot_rows(lists, known, bits), "key long, node long")
        return meeting(rows, lists, known, bits).unionByName(hot.distinct())
    each = rows.mapInArrow(_hot_rows(lists, None, bits), "key long, node long").distinct()
    several = each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return each.join(several, "key", "left_semi").select("key", "node")


# --- 3. and 4. pairs ------------------------------------------------------------------------------------------------


class _Pairs:
    """Distinct pairs of nodes, handed on before they grow beyond HELD."""

    def __init__(self) -> None:
        self.left, self.right, self.held = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.left.append(np.minimum(a, b))
        self.right.append(np.maximum(a, b))
        self.held += len(a)
        if self.held > HELD:
            self.left, self.right = ([x] for x in self._distinct())
            self.held = len(self.left[0])

    def _distinct(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.left, self.right))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return a[new], b[new]

    def full(self) -> bool:
        return self.held > HELD // 2

    def batch(self) -> pa.RecordBatch:
        a, b = self._distinct()
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _neighbours(reach: int):
    """Nodes of different components at most `reach` rows apart in a group that are not too different in size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, last = _Pairs(), None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("key", "part", "node", "n", "root")]
            kept = 0 if last is None else len(last[0])
            key, part, node, n, root = now if last is None else (np.append(x, y) for x, y in zip(last, now, strict=True))
            last = [x[-reach:] for x in (key, part, node, n, root)]
            for d in range(1, reach + 1):
                a, b = n[:-d], n[d:]
                near = (key[d:] == key[:-d]) & (part[d:] == part[:-d]) & (root[d:] != root[:-d])
                near &= 4 * np.minimum(a, b) >= 3 * np.maximum(a, b)
                near[: max(0, kept - d)] = False  # both were in the batch before
                found.add(node[:-d][near], node[d:][near])
            if found.full():
                yield found.batch()
        yield found.batch()

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream sorted by `group` in pieces that never cut a group, which holds two tiles at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("group").to_numpy()
        cut = int((group == group[-1]).argmax())
        if cut or (held and held[-1].column("group")[-1].as_py() != group[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Maps:
    """Bitmaps of rows, brought to a common width where two rows meet."""

    def __init__(self, *bits: pa.Array) -> None:
        self.bits = [np.frombuffer(x.as_buffer(), np.uint8) for column in bits for x in column]
        self.width, self.made = np.array([len(x) for x in self.bits], np.int64), {}

    def _of(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        if width not in self.made:
            rows = np.flatnonzero(self.width >= width)
            at = np.full(len(self.width), -1)
            at[rows] = np.arange(len(rows))
            maps = np.concatenate([folded(self.bits[k][None, :], width) for k in rows])
            self.made[width] = at, maps.view(np.uint64)
        return self.made[width]

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, widths = np.empty(len(i), np.int64), np.minimum(self.width[i], self.width[j])
        for width in np.unique(widths):
            at, maps = self._of(int(width))
            for some in np.array_split(np.flatnonzero(widths == width), 1 + len(i) * int(width) // 50_000_000):
                out[some] = np.bitwise_count(maps[at[i[some]]] ^ maps[at[j[some]]]).sum(1, dtype=np.int64)
        return out


def _together(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of keys, filled up with -1, have a key in common."""
    out = np.zeros(len(x), bool)
    for c in range(x.shape[1]):
        out |= ((y == x[:, c : c + 1]) & (x[:, c : c + 1] >= 0)).any(1)
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the two tiles of a group (of a tile that is alone: of its rows) that the bitmaps do not exclude and that
    have no smaller key in common, as far as the rows carry these."""
    found = _Pairs()
    for piece in _runs(batches):
        group, side, node, n, root, crowd = (piece.column(c).to_numpy() for c in ("group", "side", "node", "n", "root", "crowd"))
        cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = np.repeat(np.append(cuts[1:], len(group)), np.diff(np.append(cuts, len(group))))
        alone = np.repeat(np.add.reduceat(side, cuts) == 0, np.diff(np.append(cuts, len(group))))
        maps, many = _Maps(piece.column("bits")), pa.compute.list_value_length(piece.column("smaller")).to_numpy()
        keys = np.full((len(group), max(1, int(many.max()))), -1)
        keys[np.arange(keys.shape[1]) < many[:, None]] = piece.column("smaller").flatten().to_numpy()
        i, step = np.arange(len(group)), 1
        while len(i := i[i + step < ends[i]]):
            j = i + step
            may = (root[i] != root[j]) & (alone[i] | (side[i] != side[j])) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j]))
            may &= (crowd[i] & crowd[j]) == 0
            p, q = i[may], j[may]
            if len(p):
                likely = (n[p] + n[q] - maps.differ(p, q)) // 2 >= needed(n[p], n[q])
                p, q = p[likely], q[likely]
            if len(p):
                fresh = ~_together(keys[p], keys[q])
                found.add(node[p[fresh]], node[q[fresh]])
            if found.full():
                yield found.batch()
            step += 1
    yield found.batch()


def _short(most: int):
    """Rows (node, bits) with bitmaps of at most so many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            bits = [folded(np.frombuffer(x.as_buffer(), np.uint8)[None, :], most).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["node", "bits"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) as (node, member) for each shingle."""
    for batch in sliced(batches):
        for node, raw in zip(batch.column(0), batch.column(1), strict=True):
            member = np.frombuffer(raw.as_buffer(), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(member), node.as_py())), pa.array(member)], names=["node", "member"])


def _crowd(rows: DataFrame, nodes: DataFrame, store: SetStore) -> DataFrame:
    """Of the rows under keys of several tiles, the nodes that share so little with all others of them that no two of them
    link: of a pair's union each one's own members, more than a seventh of it, would be missing in the intersection."""
    some = stored(nodes.join(rows.select("node").distinct(), "node", "left_semi").select("node", "n"), "shingle-crowd")
    if some.isEmpty():
        return some.select("node", F.lit(1).alias("crowd"))
    sets = store.of(some.select("node")).join(some, "node", "left_semi").dropDuplicates(["node"])
    members = sets.select("node", "shingles").mapInArrow(_members, "node long, member long")
    own = members.groupBy("member").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    own = own.groupBy("node").agg(F.count("*").alias("own")).join(some.select("node", "n"), "node")
    return own.where("7 * own > n").select("node", F.lit(1).alias("crowd"))


def _met_tiles(rows: DataFrame, crowd: DataFrame, per_tile: int) -> DataFrame:
    """Rows (key, node, n) of keys of several tiles as (group, side, key, node), for each pair of tiles that meet."""
    rows = rows.join(crowd, "node", "left").fillna(0, ["crowd"])
    rows = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / BAND).cast("int"))
    sizes = rows.groupBy("key", "band", "crowd").agg(F.ceil(F.count("*") / per_tile).cast("int").alias("tiles"))
    end = lambda c: sizes.select("key", *[F.col(k).alias(f"{k}_{c}") for k in ("band", "crowd", "tiles")])
    meet = F.col("band_y").isin(F.col("band_x"), F.col("band_x") + 1) & ~((F.col("crowd_x") == 1) & (F.col("crowd_y") == 1))
    ordered = (F.col("band_x") < F.col("band_y")) | (F.col("crowd_x") <= F.col("crowd_y"))
    meets = stored(end("x").join(end("y"), "key").where(meet & ordered), "shingle-meets")
    one = (F.col("band_x") == F.col("band_y")) & (F.col("crowd_x") == F.col("crowd_y"))
    tile = lambda many: F.pmod(F.xxhash64("node"), F.col(many)).cast("int")
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    def side(c: str, o: str) -> DataFrame:
        mine = rows.withColumnsRenamed({"band": f"band_{c}", "crowd": f"crowd_{c}"}).join(meets, ["key", f"band_{c}", f"crowd_{c}"])
        mine = mine.withColumn(f"tile_{c}", tile(f"tiles_{c}"))
        own = F.col(f"tile_{c}")
        twins = upto(own, F.col("tiles_x") - 1) if c == "x" else upto(F.lit(0), own - 1)
        others = F.when(one, twins).otherwise(upto(F.lit(0), F.col(f"tiles_{o}") - 1))
        mine = mine.withColumn(f"tile_{o}", F.explode(others))
        group = F.xxhash64("key", "band_x", "band_y", "crowd_x", "crowd_y", "tile_x", "tile_y")
        return mine.select(group.alias("group"), F.lit(0 if c == "x" else 1).alias("side"), "key", "node")

    return side("x", "y").unionByName(side("y", "x"))


def _tile_pairs(rows: DataFrame, nodes: DataFrame, store: SetStore, per_tile: int, bits_bytes: int) -> DataFrame:
    """Pairs (a, b) of the open rows (key, node, n, root) that may link, each once if its nodes' smallest common key is
    among the SMALLER_KEYS smallest of both."""
    many = rows.groupBy("key").agg(F.count("*").alias("c"))
    big = stored(many.where(F.col("c") > per_tile).select("key"), "shingle-big")
    wide = rows.join(big, "key", "left_semi")
    crowd = stored(_crowd(wide, nodes, store), "shingle-crowd")
    met = rows.join(big, "key", "left_anti").select(F.xxhash64("key").alias("group"), F.lit(0).alias("side"), "key", "node")
    if not big.isEmpty():
        met = met.unionByName(_met_tiles(wide, crowd, per_tile))
    first = F.slice(F.array_sort(F.collect_set("key")), 1, SMALLER_KEYS).alias("keys")
    known = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"), first)
    bits = nodes.select("node", "bits").mapInArrow(_short(bits_bytes), "node long, bits binary")
    known = known.join(bits, "node").join(crowd, "node", "left").fillna(0, ["crowd"])
    smaller = F.filter("keys", lambda k: k < F.col("key")).alias("smaller")
    spread = met.join(known, "node").select("group", "side", "node", "n", "root", "crowd", "bits", smaller)
    return spread.repartition("group").sortWithinPartitions("group", "side").mapInArrow(_tiles, "a long, b long")


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that the bitmaps do not exclude, with the most that they can share of what they need."""
    for batch in batches:
        n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        at = np.arange(len(n))
        most = (n + m - _Maps(batch.column("bits_a"), batch.column("bits_b")).differ(at, at + len(n))) // 2 if len(n) else n
        keep = most >= needed(n, m)
        rows = batch.select(["a", "b"]).filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(most[keep] / (n + m)[keep])], names=["a", "b", "share"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a stream (a, b, node, shingles), sorted so, the pairs whose sorted arrays share enough."""
    last, first = None, None
    for batch in batches:
        pairs = []
        for a, b, node, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
            x = np.frombuffer(raw.as_buffer(), "<u8")
            if (a, b) != last:
                last, first = (a, b), (node, x)
            elif first and node != first[0]:
                i = np.searchsorted(x, first[1])
                common = np.count_nonzero(x[np.minimum(i, len(x) - 1)] == first[1])
                if 100 * common >= 75 * (len(x) + len(first[1]) - common):
                    pairs.append((a, b))
                first = None
        if first:
            first = first[0], first[1].copy()
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


class SetStore:
    """The sets of nodes, computed from texts (mark, text) when they are first asked for, and kept in the shared folder."""

    def __init__(self, nodes: DataFrame, texts: DataFrame, extract) -> None:
        self.marks, self.texts, self.extract = nodes.select("node", "mark"), texts, extract
        self.tables: list[DataFrame] = []

    def of(self, need: DataFrame) -> DataFrame:
        """(node, shingles) of these nodes, and of others; some more than once."""
        new = need
        for table in self.tables:
            new = new.join(table.select("node"), "node", "left_anti")
        new = stored(new.join(self.marks, "node"), "shingle-needed")
        if not self.tables or not new.isEmpty():
            some = self.texts.join(new.select("mark").distinct(), "mark", "left_semi").select("text")
            sets = some.mapInArrow(self.extract, "node long, shingles binary")
            self.tables.append(stored(sets.join(new.select("node"), "node", "left_semi"), "shingle-nodes"))
        return reduce(DataFrame.unionByName, self.tables)


def verified(pairs: DataFrame, nodes: DataFrame, store: SetStore, best: bool) -> DataFrame:
    """The pairs (a, b) that really link: bitmaps first, sets only of what these leave; best: for each a only the most
    likely b. The joins are on evenly spread node hashes and may be split where skewed."""
    pairs = pairs.distinct()
    for c in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("n").alias(f"n_{c}")), c)
    likely = pairs.mapInArrow(_bounded, "a long, b long, share double")
    if best:
        likely = likely.groupBy("a").agg(F.max_by("b", F.struct("share", "b")).alias("b"))
    likely = stored(likely.select("a", "b"), "shingle-likely")
    released(likely.sparkSession)
    ends = likely.select(F.explode(F.array("a", "b")).alias("node"), "a", "b")
    met = ends.join(store.of(ends.select("node").distinct()), "node").select("a", "b", "node", "shingles")
    return met.repartition("a", "b").sortWithinPartitions("a", "b", "node").mapInArrow(_linked, "a long, b long")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The component of every node (node, root) once the links (a, b) between nodes hold as well."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    ends = links.join(of("a"), "a").join(of("b"), "b")
    above = components(ends, "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("top"))
    return stored(roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "shingle-roots")


def _open_rows(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows under keys that hold nodes of several components."""
    known = keyed.join(roots, "node")
    several = known.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    return stored(known.join(several, "key").select("key", "node", "n", "root", "parts"), "shingle-open")


def _different_keys(rows: DataFrame, salt_rows: int) -> DataFrame:
    """The rows, with the number of parts a key is dealt to; of keys with the same nodes only the smallest."""
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "node"))
    lists = rows.groupBy("key").agg(F.count("*").alias("c"), mark(1).alias("x"), mark(2).alias("y"))
    kept = lists.where("c > 1").groupBy("c", "x", "y").agg(F.min("key").alias("key"))
    kept = kept.select("key", F.ceil(F.col("c") / salt_rows).cast("int").alias("parts"))
    return stored(rows.join(kept, "key").select("key", "node", "n", "parts"), "shingle-keys")


def _open_pairs(rows: DataFrame) -> tuple[float, int]:
    """Pairs of rows under the same key in different components, and rows."""
    each = rows.groupBy("key", "root").agg(F.count("*").cast("double").alias("c"))
    keys = each.groupBy("key").agg(F.sum("c").alias("g"), F.sum(F.col("c") * F.col("c")).alias("q"))
    pairs, total = keys.agg(F.sum((F.col("g") * F.col("g") - F.col("q")) / 2), F.sum("g")).first()
    return pairs or 0.0, int(total or 0)


def components_of(rows: DataFrame, nodes: DataFrame, store: SetStore, limits: Limits = LIMITS) -> DataFrame:
    """(node, root) of all nodes (node, n, bits) by rows (key, node, n).

    Round 0 compares neighbours by size under each key, later rounds neighbours in an order that changes from round to
    round, and only across components; a key with many rows is dealt to parts, anew in each round. A group of near
    copies grows together in a few rounds, at one pair a node and round. When few open pairs are left, or a round finds
    hardly any link, all that are still open are compared, whatever part they were in.
    """
    keyed = _different_keys(rows, limits.salt_rows)
    roots = nodes.select("node", F.col("node").alias("root"))
    rows, order = keyed.withColumn("root", F.col("node")), F.col("n")
    for turn in range(1, MOST_ROUNDS + 1):
        dealt = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(-turn), "node"), F.col("parts")).cast("int"))
        spread = dealt.repartition("key", "part").sortWithinPartitions("key", "part", order, "node")
        near = spread.select("key", "part", "node", "n", "root").mapInArrow(_neighbours(1 if turn == 1 else REACH), "a long, b long")
        links = stored(verified(near, nodes, store, True), "shingle-links")
        roots = _merged(roots, links)
        rows, order = _open_rows(keyed, roots), F.xxhash64(F.lit(turn), "node")
        released(rows.sparkSession)
        pairs, total = _open_pairs(rows)
        if pairs <= FEW * total or (turn > 1 and links.count() < total / 100):
            break
    if not pairs:
        return roots
    tiled = _tile_pairs(rows.drop("parts"), nodes, store, limits.tile, TILE_BYTES[pairs > limits.light * total])
    return _merged(roots, verified(tiled, nodes, store, False))


def _node_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as (node, shingles), each set once a task or more."""
    seen: set[int] = set()
    for batch in sliced(batches):
        rows = []
        for text in batch.column(0).cast(pa.binary()):
            s = shingles(text.as_py())
            if len(s) and unseen(node := node_of(s), seen):
                rows.append((node, s.astype("<u8").tobytes()))
        columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles"])


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = LIMITS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    size = text_bytes(texts)
    sets = stored(_sets(texts, size, limits), "shingle-sets")
    hot = sets.select(F.explode("hot").alias("key"), "node").distinct()
    rows = stored(meeting(sets.select("node", "keys"), Lists(key_bits_for(size))).unionByName(hot), "shingle-rows")
    nodes = sets.where("bits is not null").join(rows.select("node").distinct(), "node", "left_semi")
    nodes = stored(nodes.select("node", "n", "bits", "mark").dropDuplicates(["node"]), "shingle-nodes")
    store = SetStore(nodes, texts.select("mark", "text"), _node_sets)
    released(docs.sparkSession)
    roots = components_of(rows.join(nodes.select("node", "n"), "node"), nodes, store, limits)

    first = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    grouped = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = grouped.join(least, "root").select("node", "component_id")
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), "node").join(labels, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"))
