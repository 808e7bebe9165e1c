import math
import random
import zlib

import numpy as np
import pytest

from seqmill.llm import nbsvm

DOCS = "doc_id long, text string, score double, label string, buckets int"
LABELS = "doc_id long, quality int, toxic int, text string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "ko", "ti", "re", "lu", "né"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def junk(rng, n):
    words = prose(rng, n).split()
    kind = rng.randrange(3)
    return " ".join(w + "###" for w in words) if kind == 0 else " ".join(w.upper() + "!!" for w in words) if kind == 1 else " ".join(f"{w} {w}" for w in words)


def test_shapes():
    assert [nbsvm.shape(w) for w in ("", "and", "Rewh.###", "THE!!", "x86_64", "日本", "ÉTÉ", "--")] == ["", "a", "Aa.#", "A!", "a0_0", "a", "A", "-"]


def test_features_are_indicators_of_ngrams():
    features, rng = nbsvm.Features(), random.Random(5)
    for _ in range(50):
        text = junk(rng, rng.randint(0, 30))
        found = features(text)
        assert found.dtype == np.int32 and (np.diff(found) > 0).all() and (not len(found) or 0 <= found[0] <= found[-1] < nbsvm.BUCKETS)
        assert (found == nbsvm.Features()("\n " + text.replace(" ", "\t\x0b") + " ")).all()  # another worker, other blanks
    assert not len(features(None)) and not len(features(" \n"))
    # a word more adds its n-grams and takes none away; a repeated word is another shape
    assert set(features("ba ko")) < set(features("ba ko ti")) and set(features("ba ba")) - set(features("ba ko")) - set(features("ba"))
    few = [len(features(t)) for t in ("ba", "ba Ko", "ba Ko 9")]
    assert few == [2, 6, 11]  # words 1 + shapes 1; then 2 + 1 pairs and 2 + 1; then 3 + 2 and 3 + 2 + 1


def test_words_are_forgotten_when_too_many(monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, 40) for _ in range(60)]
    want = [nbsvm.Features()(t).tolist() for t in texts]
    monkeypatch.setattr(nbsvm, "KEPT", 50)
    features = nbsvm.Features()
    assert [features(t).tolist() for t in texts] == want and len(features.kept) < 100


def test_ratios_by_hand():
    bad, good = np.zeros(nbsvm.BUCKETS), np.zeros(nbsvm.BUCKETS)
    bad[3], good[3], good[9] = 4, 1, 2
    r = nbsvm.log_count_ratios(bad, good)
    n = nbsvm.BUCKETS
    assert math.isclose(r[3], math.log((2 / (n + 3)) / (5 / (n + 4)))) and math.isclose(r[9], math.log((3 / (n + 3)) / (1 / (n + 4))))
    assert not r[np.setdiff1d(np.arange(n), [3, 9])].any()


def test_coordinate_descent_reaches_the_least_objective(monkeypatch):
    monkeypatch.setattr(nbsvm, "CLOSE", 1e-6)
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(120)]
    values = [rng.normal(size=8) for _ in rows]
    y = np.sign(np.array([v.sum() for v in values]) + rng.normal(size=120))
    w = nbsvm.coordinate_descent(rows, values, y, cost=0.5, rounds=3000)
    x = np.zeros((120, 31))
    for k, (r, v) in enumerate(zip(rows, values, strict=True)):
        x[k, r] = v
    x[:, 30] = 1.0

    def objective(u):
        return u @ u / 2 + 0.5 * np.maximum(0, 1 - y * (x @ u)).sum()

    own = np.append(w[:30], w[-1])
    assert not w[30:-1].any()
    u, best = np.zeros(31), math.inf  # subgradients with falling steps
    for k in range(1, 20_000):
        u = u - (u - 0.5 * (y * (y * (x @ u) < 1)) @ x) / (k + 10)
        best = min(best, objective(u))
    assert objective(own) <= best + 1e-3


def test_curve_gives_probabilities():
    rng = np.random.default_rng(2)
    m = rng.normal(size=4000)
    good = (rng.random(4000) < 1 / (1 + np.exp(-(2 * m - 1)))).astype(float)
    slope, offset = nbsvm.logistic_curve(m, good)
    assert abs(slope - 2) < 0.2 and abs(offset + 1) < 0.2


def labelled(seed=1, n=600):
    rng = random.Random(seed)
    rows = [(k, (junk if k % 5 == 0 else prose)(rng, rng.randint(5, 60)), 0.5, "x", 1) for k in range(n)]
    return rows, [(k, int(k % 5 != 0), 0, "clash") for k in range(n)]


def test_counts_and_scores_against_a_plain_version(spark):
    docs, labels = labelled()
    d, la = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels + labels[:40], LABELS)
    model = nbsvm.learn(d, la)
    train = [k for k in range(len(docs)) if zlib.crc32(str(k).encode()) % 4 != 2]
    features = {k: nbsvm.Features()(docs[k][1]) for k in range(len(docs))}
    counts = np.zeros((2, nbsvm.BUCKETS))
    for k in train:
        for b in features[k]:
            counts[labels[k][1], b] += 1
    assert np.allclose(model.ratios, nbsvm.log_count_ratios(counts[0], counts[1]))
    order = sorted(train, key=str)
    again = nbsvm.fit([features[k] for k in order], np.array([labels[k][1] for k in order], float), model.ratios)
    assert np.allclose(again.weights, model.weights) and math.isclose(again.slope, model.slope)
    rows = nbsvm.score(d, model).collect()
    assert [r.asDict().keys() for r in rows][0] == {"doc_id", "held_out", "score", "predicted"} and len(rows) == len(docs)
    for r in rows:
        k = r["doc_id"]
        scaled = {b: model.ratios[b] for b in features[k]}
        size = math.sqrt(sum(v * v for v in scaled.values()))
        margin = sum(model.weights[b] * v for b, v in scaled.items()) / size + model.constant
        assert math.isclose(r["score"], 1 / (1 + math.exp(-(model.slope * margin + model.offset))), rel_tol=1e-6, abs_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 100 and sum(r["predicted"] == labels[r["doc_id"]][1] for r in held) >= 0.98 * len(held)
    kept = nbsvm.keep_good(d, model)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["predicted"]}


def test_many_labels_meet_their_texts_by_a_shuffle(spark, monkeypatch):
    docs, labels = labelled(3, 200)
    d, la = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    near = nbsvm.learn(d, la)
    for bound in ("AT_HAND", "AT_HAND_BYTES"):
        with monkeypatch.context() as m:
            m.setattr(nbsvm, bound, 10)
            far = nbsvm.learn(d, la)
        assert (far.weights == near.weights).all() and (far.ratios == near.ratios).all() and far.offset == near.offset


def test_the_sample_is_bounded(spark, monkeypatch):
    docs, labels = labelled(2, 500)
    monkeypatch.setattr(nbsvm, "FIT_ROWS", 150)
    seen = []
    real = nbsvm.fit
    monkeypatch.setattr(nbsvm, "fit", lambda rows, good, ratios: seen.append(len(rows)) or real(rows, good, ratios))
    model = nbsvm.learn(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert 80 < seen[0] <= 150
    scores = [model.score(nbsvm.Features()(t)) for _, t, *_ in docs]
    assert sum((s >= 0.7) == q[1] for s, q in zip(scores, labels, strict=True)) > 0.95 * len(docs)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0, "")], [(1, 0, 0, ""), (3, 0, 0, "")], [(None, 1, 0, ""), (9, 0, 0, ""), (3, None, 1, "")], [(1, 0, 0, ""), (1, 1, 0, ""), (3, 1, 0, ""), (4, 0, 0, "")]])
def test_odd_tables(spark, labels):
    docs = spark.createDataFrame([(1, "some words here", 0.0, "", 0), (1, "some words here", 0.0, "", 0), (3, None, 0.0, "", 0), (4, "", 0.0, "", 0), (None, "w" * 100_000 + " x " * 5000, 0.0, "", 0)], DOCS)
    rows = nbsvm.score(docs, nbsvm.learn(docs, spark.createDataFrame(labels, LABELS))).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 4)}) == 1 and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert nbsvm.score(docs.limit(0), nbsvm.learn(docs.limit(0), spark.createDataFrame(labels, LABELS))).count() == 0
