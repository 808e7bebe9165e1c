import itertools

import numpy as np
import pytest

from seqmill.llm import ann


def brute(ids, vectors, every, top):
    out = {}
    for i, v in zip(ids, vectors, strict=True):
        if i % every == 0:
            score = [(-float(np.add.reduce(v.astype(float) * w.astype(float))), j) for j, w in zip(ids, vectors, strict=True) if j != i]
            out[i] = [(j, -s) for s, j in sorted(score)[:top]]
    return out


@pytest.mark.parametrize(("dims", "depth"), [(2, 3), (3, 2), (4, 2), (1, 4)])
def test_curve_visits_each_cell_once_in_steps_of_one(dims, depth):
    cells = np.array(list(itertools.product(range(1 << depth), repeat=dims)))
    keys = ann.hilbert_keys(cells, depth)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1200, 32)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    want = brute(range(len(v)), v, 20, 20)
    rows = ann.nearest(df, block=64).collect()
    hits = 0
    for q, best in want.items():
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [(r.score, -r.vec_id) for r in mine] == sorted(((r.score, -r.vec_id) for r in mine), reverse=True)
        exact = {j: float((v[q].astype(float) * v[j].astype(float)).sum()) for j in [r.vec_id for r in mine]}
        assert all(abs(r.score - exact[r.vec_id]) < 1e-12 for r in mine) and q not in exact
        hits += len(exact.keys() & {j for j, _ in best})
    assert hits / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("shape", ["norms", "clusters"])
def test_recall_by_shape(spark, monkeypatch, shape):
    """Norms of every size; clusters, in which the reach is short; and queries dealt to several tasks."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 16))
    v = v * np.exp(rng.normal(size=(3000, 1))) if shape == "norms" else rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)] * 10 + v * 0.3
    if shape == "clusters":
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    monkeypatch.setattr(ann, "ASKED", 20)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    want = brute(range(len(v)), v, 20, 20)
    got = {}
    for r in ann.nearest(df, block=64).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {j for j, _ in best}) for q, best in want.items())
    assert all(len(x) == 20 for x in got.values()) and hits / (20 * len(want)) >= 0.9


def products(spark, n, clusters):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(n, 64))
    if clusters:
        v = rng.normal(size=(clusters, 64))[rng.integers(0, clusters, n)] * 3 + v
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    compared = spark.sparkContext.accumulator(0)
    rows = ann.nearest(df, compared=compared).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    near = v[::20].astype(float) @ v.T.astype(float)
    near[np.arange(len(near)), np.arange(0, n, 20)] = -9
    best = np.argsort(-near, axis=1)[:, :20]
    recall = sum(len(got[20 * k] & set(b.tolist())) for k, b in enumerate(best)) / best.size
    return compared.value / (len(near) * n), recall


def test_fewer_products_than_all_pairs(spark):
    """Without structure below all pairs; with structure a small share, which falls as rows are added."""
    share, recall = products(spark, 8000, 0)
    print(f"unit vectors: {share:.2f} of all pairs, recall {recall:.3f}")
    assert share < 1 and recall >= 0.9
    few, recall = products(spark, 4000, 100)
    more, recall_of_more = products(spark, 16000, 400)
    print(f"clusters: {few:.3f} of all pairs at 4,000 rows, {more:.3f} at 16,000; recall {recall:.3f}, {recall_of_more:.3f}")
    assert more < few < 0.4 and min(recall, recall_of_more) >= 0.9


def test_copies_ties_and_odd_vectors(spark):
    same = [1.0, 0.0, 0.0]
    rows = [(k, same) for k in range(0, 120)] + [(200, [0.9, 0.1, 0.0]), (201, None), (202, [0.0, 0.0, 0.0]), (203, [float("nan"), 1.0, 0.0]), (204, [1.0, None, 0.0]), (205, [float("inf"), 0.0, 0.0]), (206, [1.0, 2.0]), (40, same), (None, same)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string").repartition(3)
    got = {}
    for r in ann.nearest(df, block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 20, 40, 60, 80, 100, 200}
    assert got[0] == list(range(1, 21)) and got[40] == list(range(20)) and got[10 * 2] == [*range(20)] and got[200] == list(range(20))
    few = ann.nearest(spark.createDataFrame([(0, same), (1, [0.0, 1.0, 0.0])], df.schema.fieldNames()[:2] and "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in few] == [(0, 1, 0.0)]
    assert ann.nearest(df.limit(0)).count() == 0
