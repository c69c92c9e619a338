"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text as UTF-8 bytes (A-Z lower-cased) in windows of WINDOW bytes, once in each direction, and gives
every byte position a probability for each language; a document's probabilities are the mean over all its positions, so
the whole text counts. It is trained in numpy by backpropagation through time on a bounded sample of labelled rows
(`per_lang` documents of each language, `spans` windows of each); prediction streams over all rows.

Cases: a null text, or one without a letter, is `und` with score 0; without any labelled row to learn from everything is
`und`; a null label is not learned from; an empty table gives no rows; ties between languages go to the first by name;
repeated rows get the same answer; texts of any length pass in slices; all columns of the input are kept, and a clash with
`lang_pred` or `score` raises an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bytes of a window, hidden units, windows computed at a time, bytes of text held at a time (a multiple of WINDOW).
WINDOW, HIDDEN, BLOCK, SLICE = 96, 8, 2048, 96 * 20_480
#: Steps of training at least, so that a small sample is passed over more often.
STEPS = 360
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Model:
    """Languages by name, and for each direction the gates' input rows, recurrent matrices and output rows."""

    langs: tuple[str, ...]
    weights: Weights


# --- the network ----------------------------------------------------------------------------------------------------


def _new_weights(rng: np.random.Generator, langs: int) -> Weights:
    w: Weights = {"bias": np.zeros(langs, np.float32)}
    for d in "fb":
        for gate, width in (("g", 2 * HIDDEN), ("c", HIDDEN)):
            w[f"x{gate}_{d}"] = rng.normal(0, 0.3, (256, width)).astype(np.float32)
            w[f"h{gate}_{d}"] = rng.normal(0, 0.35, (HIDDEN, width)).astype(np.float32)
        w[f"out_{d}"] = rng.normal(0, 0.3, (HIDDEN, langs)).astype(np.float32)
    return w


def _states(w: Weights, d: str, codes: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Hidden states (time, window, HIDDEN) of one direction over codes (time, window).

    Gates are kept as tanh of half their input (sigmoid(x) = (1 + tanh(x / 2)) / 2); the weights hold the halves.
    """
    xg, xc, hg, hc = (w[f"{k}_{d}"] for k in ("xg", "xc", "hg", "hc"))
    steps, many = codes.shape
    out = np.empty((steps, many, HIDDEN), np.float32)
    h = np.zeros((many, HIDDEN), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        gates = np.take(xg, codes[t], 0, mode="clip")
        gates += h @ hg
        np.tanh(gates, gates)
        gates += 1
        gates *= 0.5
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        rh = r * h
        c = np.take(xc, codes[t], 0, mode="clip")
        c += rh @ hc
        np.tanh(c, c)
        if trace is not None:
            trace.append((t, h, r.copy(), z.copy(), rh, c))
        h = np.add(h, z * (c - h), out=out[t])
    return out


def position_probabilities(w: Weights, codes: np.ndarray) -> np.ndarray:
    """Language probabilities (time, window, language) of every byte position."""
    logits = _states(w, "f", codes) @ w["out_f"]
    logits += _states(w, "b", codes) @ w["out_b"]
    logits += w["bias"]
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits


def _gradients(w: Weights, codes: np.ndarray, valid: np.ndarray, label: np.ndarray) -> tuple[Weights, float]:
    """Gradients of the mean cross-entropy over valid positions, through time, and that mean."""
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    traces: dict[str, list] = {"f": [], "b": []}
    states = {d: _states(w, d, codes, traces[d]) for d in "fb"}
    logits = states["f"] @ w["out_f"] + states["b"] @ w["out_b"] + w["bias"]
    logits -= logits.max(-1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(-1, keepdims=True)
    share = (valid / valid.sum()).astype(np.float32)
    loss = float(-(np.log(np.take_along_axis(p, np.broadcast_to(label[None, :, None], (*codes.shape, 1)), 2) + 1e-9)[..., 0] * share).sum())
    p[:, np.arange(len(label)), label] -= 1
    p *= share[:, :, None]
    grads["bias"] = p.sum((0, 1))
    for d in "fb":
        grads[f"out_{d}"] = np.einsum("tbh,tbl->hl", states[d], p)
        above = p @ w[f"out_{d}"].T
        hg, hc = w[f"hg_{d}"], w[f"hc_{d}"]
        dh = np.zeros((len(label), HIDDEN), np.float32)
        for t, h, r, z, rh, c in reversed(traces[d]):
            dh = dh + above[t]
            dc = dh * z * (1 - c * c)
            drh = dc @ hc.T
            gates = np.concatenate([drh * h * r * (1 - r) * 2, dh * (c - h) * z * (1 - z) * 2], 1)
            np.add.at(grads[f"xc_{d}"], codes[t], dc)
            np.add.at(grads[f"xg_{d}"], codes[t], gates)
            grads[f"hc_{d}"] += rh.T @ dc
            grads[f"hg_{d}"] += h.T @ gates
            dh = dh * (1 - z) + drh * r + gates @ hg.T
    return grads, loss


def train(windows: list[bytes], labels: list[str], seed: int = 5, epochs: int = 10, batch: int = 256, rate: float = 0.01) -> Model:
    """Fits the network by Adam on labelled windows; the same windows in the same order give the same model."""
    langs = tuple(sorted(set(labels)))
    rng = np.random.default_rng(seed)
    w = _new_weights(rng, len(langs))
    codes = np.zeros((WINDOW, len(windows)), np.uint8)
    valid = np.zeros((WINDOW, len(windows)), bool)
    for i, x in enumerate(windows):
        codes[: len(x), i] = np.frombuffer(x, np.uint8)
        valid[: len(x), i] = True
    label = np.array([langs.index(x) for x in labels])
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    each = max(1, -(-len(windows) // batch))
    epochs = max(epochs, -(-STEPS // each))
    total = epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            grads, _ = _gradients(w, codes[:, at], valid[:, at], label[at])
            norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
            step += 1
            now = rate * min(1.0, 2 * (1 - step / (total + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.005 * (g * g - second[k])
                w[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
    return Model(langs, w)


# --- Spark ----------------------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1 (null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _spans(count: int):
    """Cuts the windows to learn from out of sampled texts, evenly over each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"lang": [], "order": [], "span": []}
            for lang, order, text in zip(*(batch.column(i) for i in (0, 1)), batch.column(2).cast(pa.binary()), strict=True):
                raw = text.as_py().lower()
                starts = np.unique(np.linspace(0, max(0, len(raw) - WINDOW), count).astype(int))
                for at in starts:
                    rows["lang"].append(lang.as_py())
                    rows["order"].append(order.as_py())
                    rows["span"].append(raw[at : at + WINDOW])
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("lang", pa.string()), ("order", pa.int64()), ("span", pa.binary())]))

    return run


def fit(docs: DataFrame, per_lang: int = 192, spans: int = 12, seed: int = 5) -> Model | None:
    """A model learned from `per_lang` documents of each language; None where no row is labelled.

    The sample is the rows with the smallest seeded hashes. Rows are thinned to a few times the sample by hash before
    they are ranked, so that no task ranks a whole language.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.where("lang is not null and length(text) > 0")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    order = F.xxhash64(F.lit(seed), "doc_id", "text")
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4 * per_lang / n))]), F.col("lang"))
    some = usable.select("lang", order.alias("order"), "text").where((F.col("order") + F.lit(2.0**63)) * 2.0**-64 < share)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("order"))
    sample = some.withColumn("rank", rank).where(F.col("rank") <= per_lang).select("lang", "order", "text")
    cut = sample.mapInArrow(_spans(spans), "lang string, order long, span binary")
    rows = sorted((r["lang"], r["order"], i, bytes(r["span"])) for i, r in enumerate(cut.collect()))
    rows = sorted({(lang, o, span) for lang, o, _, span in rows})
    return train([r[2] for r in rows], [r[0] for r in rows], seed)


def _has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw)) or any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def _window_sums(model: Model, parts: list[bytes]) -> np.ndarray:
    """Probabilities (part, language) summed over all positions of each part."""
    sizes = np.array([len(x) for x in parts])
    wins = -(-sizes // WINDOW)
    ends = np.cumsum(wins)
    codes = np.zeros(int(ends[-1]) * WINDOW, np.uint8)
    for x, at in zip(parts, (ends - wins) * WINDOW, strict=True):
        codes[at : at + len(x)] = np.frombuffer(x, np.uint8)
    codes = codes.reshape(-1, WINDOW)
    filled = np.full(len(codes), WINDOW)
    filled[ends - 1] = sizes - (wins - 1) * WINDOW
    sums = np.empty((len(codes), len(model.langs)))
    for i in range(0, len(codes), BLOCK):
        p = position_probabilities(model.weights, np.ascontiguousarray(codes[i : i + BLOCK].T))
        for j in np.flatnonzero(filled[i : i + BLOCK] < WINDOW):
            p[filled[i + j] :, j] = 0
        sums[i : i + BLOCK] = p.sum(0)
    return np.add.reduceat(sums, ends - wins)


def pooled(model: Model, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """For each text in turn its probabilities, the mean over all positions; at most about two slices are held."""
    parts, owners, held = [], [], 0
    waiting: list[list] = []  # [sum so far, bytes, whether all parts were cut]

    def flush() -> Iterator[np.ndarray]:
        nonlocal parts, owners, held
        if parts:
            for own, x in zip(owners, _window_sums(model, parts), strict=True):
                own[0] = own[0] + x
        parts, owners, held = [], [], 0
        while waiting and waiting[0][2]:
            total, size, _ = waiting.pop(0)
            yield total / size

    for raw in texts:
        own = [np.zeros(len(model.langs)), len(raw), False]
        waiting.append(own)
        for at in range(0, len(raw), SLICE):
            parts.append(raw[at : at + SLICE].lower())
            owners.append(own)
            held += len(parts[-1])
            own[2] = at + SLICE >= len(raw)
            if held >= SLICE:
                yield from flush()
    yield from flush()


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All rows and columns, with lang_pred and score; only the text goes through Python, and only the answer back."""
    if clash := {"lang_pred", "score"} & set(docs.columns):
        raise ValueError(f"columns clash with the operator's: {sorted(clash)}")

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def answer(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            langs, scores = ["und"] * len(column), np.zeros(len(column))
            raw = column.cast(pa.binary())
            at = [i for i, x in enumerate(raw) if model and x.is_valid and _has_letter(x.as_py())]
            for i, p in zip(at, pooled(model, (raw[i].as_py() for i in at)) if at else (), strict=True):
                best = int(p.argmax())
                langs[i], scores[i] = model.langs[best], min(float(p[best]), 1.0)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    # the generator keeps later filters from asking twice
    return docs.select("*", F.inline(F.array(answer(F.col(text_col)))))
