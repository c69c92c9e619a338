"""Best-two-fit packing of whole documents into token sequences of a fixed capacity.

Documents become token ids by a public tokenizer, closed by an end id; only what is longer than a sequence is cut. Bins
depend on lengths alone, and there are at most `capacity` different lengths, so the plan is made on the histogram of
all lengths, whatever the number of documents: a bin is filled greedily with the longest piece that still fits, then, as
long as two unpacked pieces fill the gap left by its smallest piece more tightly than that piece did, they replace it.
A pattern found so is repeated as often as the histogram allows. Pieces get their places by their rank among those of
their length; ranks are two-level (counts per length and bucket, then inside the bucket), so no length meets in one task.

The tokenizer drops white space and never joins across it, so the ids of a text are those of its words. Each worker keeps
the ids of words that it has met, in a table that keeps the first half when it grows beyond TABLE_WORDS.

Cases: a null or empty text is the end id alone; ids of documents may be null or repeated, and equal rows are packed
each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medloom.llm.common import stored

CAPACITY, END_ID, TABLE_WORDS, ROWS, BUCKET_ROWS = 4096, 1, 400_000, 1000, 4096
#: Words that go through the tokenizer at a time: what it holds of each takes far more memory than its ids.
ENCODED = 2048
PIECE = "piece int, start long, length long, ids_crc32 long"


# --- token ids ------------------------------------------------------------------------------------------------------


# What of UTF-8 the tokenizer's rules for words rest on. Letters are ASCII or Latin-1 ones; signs are ASCII's.
_LETTERS = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
_SIGN = rb"[!-/:-@\[-`{-~]"
#: Signs after a letter or digit, up to the next white space: a piece of their own for the tokenizer.
_TAIL = re.compile(
    rb"(" + _SIGN + rb"(?:(?<=[a-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))" + _SIGN + rb"*)(?=[ \t-\r]|\Z)", re.DOTALL
)
_ONE_PIECE = re.compile(_LETTERS)
#: Leading bytes of combining marks, and how special tokens begin: lower-casing these first may give other ids.
_DELICATE = (b"\xcc", b"\xcd", b"<|")


def words_of(text: bytes) -> list[bytes]:
    """Words whose ids, one after the other, are the text's: signs that end a word stand apart, A-Z are lower-cased."""
    if any(x in text for x in _DELICATE):
        return text.split()
    return _TAIL.sub(rb" \1", text.lower()).split()


class TokenTable(dict):
    """Token ids of words: word -> row, with ids[starts[row]:][:lens[row]]."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.waiting: list[bytes] = []
        self.ids, self.used = np.empty(1 << 18, "<u4"), 0
        self.starts, self.lens = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def shrink(self, keep: int) -> None:
        """Forgets all but the words met first, which are the frequent ones."""
        first = list(islice(self.items(), keep))
        self.clear()
        self.update(first)
        self.used = int(self.starts[keep - 1] + self.lens[keep - 1])

    def __missing__(self, word: bytes) -> int:
        self.waiting.append(word)
        row = self[word] = len(self)
        return row

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each word). Words of one piece go through as one text: its word ends tell them apart."""
        if words and all(map(_ONE_PIECE.fullmatch, words)):
            ids = np.array(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(words):
                return ids, np.diff(ends, prepend=-1)
        each = [e.ids for e in self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)]
        lens = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter((i for x in each for i in x), "<u4", int(lens.sum())), lens

    def learn(self) -> None:
        """Encodes the words that came up since the last call."""
        rows = np.arange(len(self) - len(self.waiting), len(self))
        while len(self) > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        plain = np.fromiter((bool(_ONE_PIECE.fullmatch(w)) for w in self.waiting), bool, len(rows))
        for some in (plain, ~plain):
            mine = np.flatnonzero(some)
            for part in np.split(mine, range(ENCODED, len(mine), ENCODED)):
                ids, lens = self._encode([self.waiting[k] for k in part])
                while self.used + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
                self.starts[rows[part]] = self.used + np.cumsum(lens) - lens
                self.lens[rows[part]] = lens
                self.ids[self.used : self.used + len(ids)] = ids
                self.used += len(ids)
        self.waiting = []

    def rows(self, text: bytes | None) -> np.ndarray:
        words = words_of(text) if text else []
        return np.array(itemgetter(*words)(self), np.int64).reshape(-1) if words else np.empty(0, np.int64)

    def encoded(self, rows: np.ndarray) -> np.ndarray:
        lens = self.lens[rows]
        total = int(lens.sum())
        at = np.repeat(self.starts[rows] - (np.cumsum(lens) - lens), lens) + np.arange(total)
        return self.ids[at]


_TABLES: dict[str, TokenTable] = {}


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _TABLES.get(path) or _TABLES.setdefault(path, TokenTable(path))
        for batch in (part.slice(at, ROWS) for part in batches for at in range(0, part.num_rows, ROWS)):
            if len(table) > TABLE_WORDS:
                table.shrink(TABLE_WORDS // 2)
            rows = [table.rows(text.as_py()) for text in batch.column(1).cast(pa.binary())]
            table.learn()
            source, piece, start, length, crc, held = [], [], [], [], [], []
            for i, words in enumerate(rows):
                ids = np.append(table.encoded(words), np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    source.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        held.append(part.tobytes())
            columns = [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(held, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


# --- the plan -------------------------------------------------------------------------------------------------------


def _pair(lens: np.ndarray, left: np.ndarray, room: int) -> tuple[int, int]:
    """The two available lengths with the largest sum within room, the longer one as long as possible; (0, 0) if none."""
    ok = (left > 0) & (lens < room)
    have, many = lens[ok], left[ok]
    if not len(have):
        return 0, 0
    j = np.searchsorted(have, np.minimum(room - have, have), side="right") - 1
    j = np.where((j == np.arange(len(have))) & (many < 2), j - 1, j)
    total = np.where(j >= 0, have + have[np.maximum(j, 0)], 0)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    return (int(have[best]), int(have[j[best]])) if total[best] else (0, 0)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a bin, how many such bins) that use up the histogram."""
    lens = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[int(x)] for x in lens], np.int64)
    index = {int(x): i for i, x in enumerate(lens)}
    open_, patterns = [int(x) for x in lens], []
    while open_:
        bin_, room, own = [], capacity, left.copy()
        at = len(open_)
        while at := bisect_right(open_, room, 0, at):
            length = open_[at - 1]
            k = min(int(own[index[length]]), room // length)
            if k:
                bin_ += [length] * k
                own[index[length]] -= k
                room -= k * length
            at -= 1
        while room and len(bin_) > 1:
            smallest = bin_[-1]
            a, b = _pair(lens, own, room + smallest)
            if a + b <= smallest:
                break
            own[index[smallest]] += 1
            own[index[a]] -= 1
            own[index[b]] -= 1
            bin_ = sorted([*bin_[:-1], a, b], reverse=True)
            room += smallest - a - b
        uses = {x: bin_.count(x) for x in bin_}
        times = min(int(left[index[x]]) // k for x, k in uses.items())
        for x, k in uses.items():
            left[index[x]] -= times * k
            if not left[index[x]]:
                open_.pop(bisect_right(open_, x) - 1)
        patterns.append((tuple(bin_), times))
    return patterns


def _slots(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """Places by length and rank: from `rank` on, sequence = base + (rank - first), at `offset`; `at` bounds the lengths."""
    rows, ranks, base = [], {}, 0
    for bin_, times in patterns:
        offset = 0
        for length in bin_:
            first = ranks.get(length, 0)
            rows.append((length, first, base, offset))
            ranks[length] = first + times
            offset += length
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    at = np.searchsorted(table[:, 0], np.arange(capacity + 2))
    return {"at": at, "first": table[:, 1], "base": table[:, 2], "offset": table[:, 3]}


def _seated(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = slots.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for mine in np.split(order, cuts[1:]):
                if len(mine):
                    lo, hi = places["at"][length[mine[0]]], places["at"][length[mine[0]] + 1]
                    row[mine] = lo + np.searchsorted(places["first"][lo:hi], rank[mine], side="right") - 1
            sequence = places["base"][row] + rank - places["first"][row]
            columns = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "rank"]
            names = [name for name in batch.schema.names if name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(places["offset"][row])], names=[*names, "sequence_id", "offset"]
            )

    return run


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with with_ids the ids themselves
    (little-endian unsigned 32-bit numbers); sorting a sequence's pieces by offset gives its tokens."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, {PIECE}" + ", ids binary" * with_ids
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), schema)
    pieces = stored(pieces, "pack-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan_bins(histogram, capacity), capacity))
    buckets = max(1, sum(histogram.values()) // BUCKET_ROWS)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    bases = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("inside", inside).join(bases, ["length", "bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("base") + F.col("inside")).cast("long").alias("rank"))
    return ranked.mapInArrow(_seated(slots), schema + ", sequence_id long, offset long")
