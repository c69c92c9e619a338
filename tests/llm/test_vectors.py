"""Nearest neighbours against brute force, and the pipeline as a whole."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from medloom.llm import ann, jaccard, queries
from medloom.llm.common import stored, table


def test_recall(spark, small):
    rows = queries.op8_ann(spark, small).collect()
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    ids = np.array(sorted(vectors))
    x = np.stack([vectors[i] for i in ids])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        score = (x * vectors[q]).sum(1)
        best = [ids[k] for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - vectors[q] @ vectors[r.vec_id]) < 1e-12 for r in mine)
        hits += len({r.vec_id for r in mine} & set(best))
        total += 20
    assert hits >= 0.9 * total


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=5).tolist()) for i in range(30)]
    same = [(100 + i, [3.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]
    bad = [(200, None), (201, [0.0] * 5), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [nan] * 5), (204, [inf] * 5), (205, [1.0, 2.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame([*good, *same, *bad], "vec_id long, embedding array<double>").repartition(3)
    rows = ann.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect()
    vectors = dict([*good, *same])
    for q in (0, 20, 100, 120):
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert len(mine) == 20
        assert all(abs(r.score - np.dot(vectors[q], vectors[r.vec_id])) < 1e-9 for r in mine)
    assert [r.vec_id for r in sorted((r for r in rows if r.query_id == 100), key=lambda r: r["rank"])] == [i for i, _ in same if i != 100][:20]
    assert {r.query_id for r in rows} == {0, 20, 100, 120}


@pytest.mark.parametrize("norms", ["one long", "some long", "lognormal", "huge"])
def test_recall_under_unequal_norms(spark, norms):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(40, 64))[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 64)) * 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "one long":
        x[7] *= 10
    elif norms == "some long":
        x[rng.random(4000) < 0.02] *= 5
    elif norms == "lognormal":
        x *= rng.lognormal(sigma=0.5, size=(4000, 1))
    else:
        x[11] *= 1e160
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found: dict[int, set] = {}
    for r in ann.nearest(df, df.where("vec_id % 40 = 0"), k=20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 4000, 40):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.lexsort((np.arange(4000), -score))[:20].tolist()))
    assert hits >= 0.9 * 20 * 100


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    rows = ann.nearest(df, df, k=20).collect()
    assert {(r.query_id, r.vec_id) for r in rows} == {(a, b) for a in range(5) for b in range(5) if a != b}
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(none, none).count() == 0


@pytest.mark.parametrize("functions", [1, 2])
def test_axes(functions):
    x = np.eye(8)[:3]
    codes = ann.axes(x, 0, functions, 4, 1)
    assert codes.shape == (3, 4) and (codes >= 0).all() and (codes < 16**functions).all()
    assert len({tuple(c) for c in codes.tolist()}) == 3
    assert abs(np.linalg.norm(ann.turned(x, 3, 1), axis=1) - 1).max() < 1e-12


# --- the pipeline ---------------------------------------------------------------------------------------------------


def test_stages(spark, small, docs):
    before, rows = docs.columns, docs
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stored(stage(spark, rows, small), f"test-{name}")
        counts[name] = rows
        if name != "pack":
            assert rows.columns == before and rows.dtypes == docs.dtypes
    assert counts["language"].count() == docs.where("text rlike '\\\\p{L}'").count()
    kept = {r.doc_id for r in counts["near_copies"].collect()}
    groups = {r.doc_id: r.component_id for r in jaccard.similar_groups(counts["language"]).collect()}
    assert kept == set(groups.values())
    assert counts["personal_data"].where("text rlike '[a-z0-9]@mail[0-9]'").count() == 0
    assert counts["personal_data"].count() == len(kept)
    assert {r.doc_id for r in counts["pack"].collect()} == {r.doc_id for r in counts["mix"].collect()}


def test_stages_take_odd_rows(spark, small, odd, empty):
    for start in (odd, empty):
        rows = start
        for _, stage in corpus_pipeline.STAGES:
            rows = stored(stage(spark, rows, small), "test-odd")
        assert rows.columns[0] == "doc_id"


def test_run_gives_the_last_stage(spark, small):
    assert corpus_pipeline.run(spark, small).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert table(spark, small, "documents").count() > 0
