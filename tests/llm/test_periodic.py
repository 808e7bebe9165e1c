import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from seqmill.llm import periodic

DOCS = "doc_id long, text string, runs string, collapsed string, longest int"


def plain_runs(x):
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            start = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i - start + q >= max(12, 2 * q) and i > start:
                found.setdefault((start, i - start + q), q)
            i = max(i, start + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def looped(rng, n, letters, loops):
    x = [rng.randrange(letters) for _ in range(n)]
    for _ in range(loops if n > 3 else 0):
        a = rng.randrange(n)
        p, e = rng.randint(1, max(1, (n - a) // 2)), rng.randint(a, n)
        for i in range(a, e):
            x[i] = x[a + (i - a) % p]
        if rng.random() < 0.5:
            x[rng.randrange(n)] = rng.randrange(letters)
    return x


def test_all_runs_and_no_others():
    rng = random.Random(12)
    for _ in range(3000):
        x = looped(rng, rng.choice([0, 1, 11, 12, 13, 20, 40, 80, 150, 300]), rng.choice([1, 2, 2, 3, 5, 20, 100, 5000]), rng.randint(0, 5))
        assert periodic.find_runs(np.array(x, np.int64)) == plain_runs(x), x


@pytest.mark.parametrize("q", range(1, 70))
def test_every_period_at_every_place(q):
    for start in range(0, 17):
        x = [1000 + k for k in range(start)] + [k % q for k in range(max(12, 2 * q))] + [2000 + k for k in range(5)]
        assert periodic.find_runs(np.array(x, np.int64)) == [(start, max(12, 2 * q), q)]
        short = x[:start] + x[start + 1 :]
        assert periodic.find_runs(np.array(short, np.int64)) == []


def test_long_documents_take_time_in_proportion():
    word, prev = [0, 1], [0]
    while len(word) < 30_000:
        prev, word = word, word + prev
    rng = random.Random(1)
    cases = [[0] * 200_000, [rng.randrange(50_000) for _ in range(30_000)] * 10, word, [rng.randrange(2) for _ in range(30_000)]]
    for x in cases:
        began = time.time()
        found = periodic.find_runs(np.array(x, np.int64))
        assert found and time.time() - began < 30
    assert periodic.find_runs(np.array(cases[0], np.int64)) == [(0, 200_000, 1)]


def plain(doc_id, text, altered=True):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    if altered and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    return doc_id, len(runs), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped))


def test_documents_with_odd_texts(spark):
    rng = random.Random(3)
    texts = [None, "", " \t", "a " * 11, "a " * 12, "x\x0by\x0cz " * 9, "    " * 8, "日本 語 " * 30, "Ab ab " * 7, "w" * 5000]
    texts += [" ".join(f"w{k}" for k in looped(rng, rng.randint(0, 200), rng.choice([2, 5, 300]), 3)) for _ in range(150)]
    rows = [(None if k == 5 else k * 7919 % 100_000, t, "clash", "clash", 1) for k, t in enumerate(texts)]
    rows += rows[-3:]
    docs = spark.createDataFrame(rows, DOCS)
    got = periodic.digest(periodic.repetitions(docs, alter=periodic.loop_tail))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes[:6]} == {"bigint"}
    key = lambda r: tuple(map(str, r))
    want = [plain(i, t) for i, t, *_ in rows]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(w[1] > 0 for w in want) > 50
    as_they_are = periodic.digest(periodic.repetitions(docs))
    assert sorted(map(tuple, as_they_are.collect()), key=key) == sorted((plain(i, t, False) for i, t, *_ in rows), key=key)


def test_real_outputs_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "so it goes " + "on and " * 8 + "then ends", "", "", 0)], DOCS)
    row = periodic.repetitions(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(3, 16, 2)] and row["collapsed"] == "so it goes on and then ends"
    assert periodic.digest(periodic.repetitions(docs.limit(0))).count() == 0
