"""Substring dedup: paragraph MinHash banding with exact verification, and exact copies of passages inside paragraphs.

A paragraph is a line of at least `least_words` words (five, the length of a shingle). Its MinHash signature (BANDS bands
of ROWS minima of its 5-word shingles) makes it collide with others; at a Jaccard similarity of 0.75 a pair collides with
a probability of 0.996. Colliding paragraphs are compared exactly, linked from 0.75 on, and clustered by connected
components (see jaccard.components_of); of each cluster that spans several documents the first document by id keeps its
paragraphs and the others lose theirs. Sets of one or two shingles can only link with equal ones, so they need no bands.

Text pasted into a longer line changes that line's shingles too much for this. So every document is also fingerprinted by
winnowing: of the hashes of its SPAN-word sequences, those that are least among WINDOW neighbours. A common passage of
SPAN + WINDOW - 1 = 51 words or more, wherever it stands, shares one; the SPAN words of a fingerprint that several
documents have go from all but the first by id.

Texts are read once for signatures and fingerprints; band keys and fingerprints meet packed (jaccard.meeting_lists), and
only those that meet become rows. Shingle sets are computed again for the paragraphs that bitmaps do not keep apart.
Copies of a third of all documents make skewed joins and aggregates with map-side combining, never a collected group.

Cases: null and empty texts have no paragraphs; lines of fewer than `least_words` words are never removed as paragraphs;
repeated rows and ids are documents of their own; ties go to the smaller id, then the earlier row; a null id never keeps a
passage that an id keeps; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.llm import jaccard
from medloom.llm.common import stored
from medloom.llm.shingles import mixed, word_hashes, word_places

#: Words of a paragraph that counts as long; bands and minima of a signature; words of a fingerprint; neighbours.
LONG, BANDS, ROWS, SPAN, WINDOW = 50, 10, 3, 43, 9
LEAST_WORDS = 5
#: An odd multiplier, the base of rolling hashes, and its inverse modulo 2**64.
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
_TURNS = np.random.default_rng(4).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def _sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of words times powers of the base, and the powers of its inverse: hashes of any sequence."""
    n = len(words)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, n)[:n], dtype=np.uint64)]), _powers(_INVERSE, n)


def _rolled(sums: tuple[np.ndarray, np.ndarray], at: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Hashes of the sequences of k words that begin at these places."""
    total, back = sums
    return mixed((total[at + k] - total[at]) * back[at])


def fingerprints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) that winnowing selects from a text's word hashes; fewer than WINDOW sequences give their least."""
    h = _rolled(_sums(words), np.arange(max(0, len(words) - SPAN + 1)), SPAN)
    at = winnowed(h)
    return at, h[at]


def winnowed(h: np.ndarray) -> np.ndarray:
    """The places of hashes that are least in some window."""
    if len(h) <= WINDOW:
        return np.array([int(h.argmin())]) if len(h) else np.empty(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(1)
    wide = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
    most = np.lib.stride_tricks.sliding_window_view(wide, WINDOW).max(1)
    return np.flatnonzero(h <= most[: len(h)])


def _bands(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The band keys (set, band) of shingle sets that lie one after the other."""
    keys = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64)
        for turn in _TURNS[band * ROWS : (band + 1) * ROWS]:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((s * turn) >> np.uint64(3), starts))
        keys[:, band] = key
    return keys


def _bitmaps(s: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The bitmaps of shingle sets that lie one after the other."""
    return [jaccard.bitmap(x) for x in np.split(s, starts[1:])]


class _Texts:
    """The words, places and paragraphs of some texts, one after the other."""

    def __init__(self, texts: list[bytes], least: int) -> None:
        words, firsts, lasts, lines = [], [], [], []
        for raw in texts:
            data = np.frombuffer(raw, np.uint8)
            start, end = word_places(data)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]).astype(np.int32)
            words.append(word_hashes(raw))
            firsts.append(points[start])
            lasts.append(points[end])
            lines.append(np.searchsorted(np.flatnonzero(data == 10), start))
        self.count = np.array([len(w) for w in words], np.int64)
        self.begin = np.cumsum(self.count) - self.count
        self.words, self.first, self.last = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((words, np.uint64), (firsts, np.int32), (lasts, np.int32)))
        self.sums = _sums(self.words)
        text, line = np.repeat(np.arange(len(texts)), self.count), np.concatenate(lines) if lines else np.empty(0, np.int64)
        cuts = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (line[1:] != line[:-1]))) if len(text) else np.empty(0, np.int64)
        sizes = np.diff(np.append(cuts, len(text)))
        #: Of each paragraph its text, first word and words.
        self.text, self.at, self.size = text[cuts][sizes >= least], cuts[sizes >= least], sizes[sizes >= least]

    def sets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(members, starts, nodes) of the paragraphs' shingle sets: sorted distinct hashes, one set after the other."""
        if not len(self.at):
            return self.words[:0], self.at, self.at
        k = np.minimum(self.size, 5)
        many = self.size - k + 1
        line = np.repeat(np.arange(len(self.at)), many)
        at = np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many) + self.at[line]
        h = _rolled(self.sums, at, k[line])
        order = np.lexsort((h, line))
        h, line = h[order], line[order]
        fresh = np.append(True, (h[1:] != h[:-1]) | (line[1:] != line[:-1]))
        h, line = h[fresh], line[fresh]
        starts = np.searchsorted(line, np.arange(len(self.at)))
        sums = np.add.reduceat(mixed(h ^ np.uint64(_BASE)), starts)
        return h, starts, mixed(sums + np.diff(np.append(starts, len(h))).astype(np.uint64)).view(np.int64)

    def prints(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, places, how many) of the texts' fingerprints."""
        h = _rolled(self.sums, np.arange(max(0, len(self.words) - SPAN + 1)), SPAN)
        found = [winnowed(h[b : max(b, b + n - SPAN + 1)]) for b, n in zip(self.begin, self.count, strict=True)]
        many = np.array([len(x) for x in found], np.int64)
        at = np.concatenate([b + x for b, x in zip(self.begin, found, strict=True)]) if found else self.at[:0]
        return h[at], at, many


_LINE = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("words", pa.int32()), ("node", pa.int64())])
_FRESH = pa.struct([("node", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("keys", pa.list_(pa.int64()))])
_UNITS = (
    "uid long, doc_id {k}, mark long, prints array<long>, first array<int>, last array<int>, "
    "lines array<struct<first: int, last: int, words: int, node: long>>, "
    "fresh array<struct<node: long, n: long, bits: binary, keys: array<long>>>"
)


def _lists(many: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), values)


def _new(nodes: np.ndarray, large: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which sets have more than two members and were not met before."""
    return np.fromiter((big and jaccard.unseen(node, seen) for node, big in zip(nodes.tolist(), large.tolist(), strict=True)), bool, len(nodes))


def _chosen(h: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members, starts) of some of the sets."""
    sizes = np.diff(np.append(starts, len(h)))
    return h[np.repeat(which, sizes)], np.cumsum(sizes[which]) - sizes[which]


def _units(least: int, key_bits: int):
    """Rows (uid, doc_id, mark, text) with their fingerprints, paragraphs and, for paragraphs that the task had not met
    before, bitmaps and band keys; first and last are code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in jaccard.sliced(batches):
            texts = _Texts([text.as_py() or b"" for text in batch.column(3).cast(pa.binary())], least)
            rows = batch.num_rows
            prints, at, many = texts.prints()
            h, starts, nodes = texts.sets()
            sizes = np.diff(np.append(starts, len(h)))
            lines = pa.StructArray.from_arrays(
                [pa.array(texts.first[texts.at]), pa.array(texts.last[texts.at + texts.size - 1]), pa.array(texts.size.astype(np.int32)), pa.array(nodes)], fields=list(_LINE)
            )
            new = _new(nodes, sizes > 2, seen)
            s, begins = _chosen(h, starts, new)
            keys = np.sort(jaccard.cut_keys(_bands(s, begins), key_bits), 1) if len(begins) else np.empty((0, BANDS), np.int64)
            fresh = pa.StructArray.from_arrays(
                [pa.array(nodes[new]), pa.array(sizes[new]), pa.array(_bitmaps(s, begins) if len(begins) else [], pa.binary()),
                 _lists(np.full(len(keys), BANDS), pa.array(keys.ravel()))], fields=list(_FRESH)
            )
            last = texts.last[at + SPAN - 1] if len(at) else texts.last[:0]
            columns = [_lists(many, pa.array(prints.view(np.int64))), _lists(many, pa.array(texts.first[at])), _lists(many, pa.array(last))]
            columns += [_lists(np.bincount(texts.text, minlength=rows), lines), _lists(np.bincount(texts.text[new], minlength=rows), fresh)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *columns], names=["uid", "doc_id", "mark", "prints", "first", "last", "lines", "fresh"]
            )

    return run


def _line_sets(least: int):
    """Texts as (node, shingles) of their paragraphs, each set once a task or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in jaccard.sliced(batches):
            texts = _Texts([text.as_py() for text in batch.column(0).cast(pa.binary())], least)
            h, starts, nodes = texts.sets()
            new = _new(nodes, np.diff(np.append(starts, len(h))) > 2, seen)
            s, begins = _chosen(h, starts, new)
            sets = [x.astype("<u8").tobytes() for x in np.split(s, begins[1:])] if len(begins) else []
            yield pa.RecordBatch.from_arrays([pa.array(nodes[new]), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _met_prints(key_bits: int):
    """Rows (uid, doc_id, prints, first, last, keys) as a row for each fingerprint whose key is among those that met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in jaccard.sliced(batches):
            ids, many, found = [], [], []
            for i, (h, first, last, keys) in enumerate(zip(*(batch.column(c) for c in range(2, 6)), strict=True)):
                h = h.values.to_numpy()
                met = np.isin(jaccard.cut_keys(h.view(np.uint64), key_bits), keys.values.to_numpy())
                found.append((h[met], first.values.to_numpy()[met], last.values.to_numpy()[met]))
                ids.append(i)
                many.append(int(met.sum()))
            at = pa.array(np.repeat(np.array(ids, np.int64), many))
            columns = [pa.array(np.concatenate([f[c] for f in found]) if found else [], kind) for c, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["uid", "doc_id", "print", "first", "last"])

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the removed code point ranges, merged."""
    for batch in batches:
        texts, chars = [], []
        for ranges in batch.column("gone"):
            merged: list[list[int]] = []
            for a, b in sorted((r["first"], r["last"]) for r in ranges.as_py()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            texts.append(",".join(f"{a}:{b}" for a, b in merged))
            chars.append(sum(b - a for a, b in merged))
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid"), pa.array(texts, pa.string()), pa.array(chars, pa.int64())], names=["uid", "spans", "removed_chars"]
        )


def _shared(units: DataFrame, group: str) -> DataFrame:
    """Units (group, doc_id, uid, at) of groups that span several documents, with the group's first document."""
    first: Column = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("keeper")
    keepers = units.groupBy(group).agg((F.min("uid") < F.max("uid")).alias("several"), first).where("several")
    return units.join(keepers.select(group, "keeper"), group)


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, limits: jaccard.Limits = jaccard.LIMITS) -> DataFrame:
    """Per document: doc_id, n_repeated (its paragraphs of LONG words or more and fingerprints that others have too),
    n_short (its shorter paragraphs that others have too), `spans` (removed start:end in code points, comma-joined),
    removed_chars, and `kept_in`, the ids of the documents that keep what went."""
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    key_bits = jaccard.key_bits_for(2 * jaccard.text_bytes(docs))
    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "mark", "text")
    units = stored(numbered.mapInArrow(_units(least_words, key_bits), _UNITS.format(k=kind)), "passage-units")

    fresh = units.select("mark", F.inline("fresh"))
    rows = stored(jaccard.meeting_lists(fresh.select("node", "keys"), jaccard.Lists(key_bits), limits), "passage-rows")
    nodes = fresh.select("node", "n", "bits", "mark").join(rows.select("node").distinct(), "node", "left_semi")
    nodes = stored(nodes.dropDuplicates(["node"]), "passage-nodes")
    store = jaccard.SetStore(nodes, docs.select("mark", "text"), _line_sets(least_words))
    roots = jaccard.components_of(rows.join(nodes.select("node", "n"), "node"), nodes, store, limits)
    lines = units.select("uid", "doc_id", F.inline("lines")).join(roots, "node", "left")
    lines = lines.select("uid", "doc_id", "first", "last", (F.col("words") >= LONG).alias("long"), F.coalesce("root", "node").alias("root"))

    lists = units.where(F.size("prints") > 0)
    met = jaccard.meeting_lists(lists.select(F.col("uid").alias("node"), F.col("prints").alias("keys")), jaccard.Lists(key_bits, whole=True), limits)
    met = met.groupBy(F.col("node").alias("uid")).agg(F.collect_set("key").alias("keys"))
    prints = lists.select("uid", "doc_id", "prints", "first", "last").join(met, "uid")
    prints = stored(prints.mapInArrow(_met_prints(key_bits), f"uid long, doc_id {kind}, print long, first int, last int"), "passage-prints")

    gone = F.col("uid") != F.col("keeper.uid")
    span = F.when(gone, F.struct("first", "last"))
    hits = _shared(lines, "root").select("uid", "long", span.alias("gone"), F.when(gone, F.col("keeper.doc_id")).alias("kept"))
    hits = hits.unionByName(_shared(prints, "print").select("uid", F.lit(True).alias("long"), span.alias("gone"), F.when(gone, F.col("keeper.doc_id")).alias("kept")))
    hits = hits.groupBy("uid").agg(
        F.count_if("long").alias("n_repeated"), F.count_if(~F.col("long")).alias("n_short"),
        F.collect_list("gone").alias("gone"), F.array_sort(F.collect_set("kept")).alias("kept_in"),
    )
    hits = stored(hits, "passage-hits")
    spans = hits.where(F.size("gone") > 0).select("uid", "gone").mapInArrow(_spans, "uid long, spans string, removed_chars long")
    none = lambda c, x: F.coalesce(c, F.lit(x)).alias(c)
    return units.select("uid", "doc_id").join(hits.drop("gone"), "uid", "left").join(spans, "uid", "left").select(
        "doc_id", none("n_repeated", 0), none("n_short", 0), none("spans", ""), none("removed_chars", 0),
        F.coalesce("kept_in", F.array().cast(f"array<{kind}>")).alias("kept_in"),
    )
