import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from seqmill.llm import packing
from seqmill.llm.queries import vocabulary


def check(histogram, patterns, window):
    used = {}
    for items, times in patterns:
        assert sum(n * k for n, k in items) <= window
        for n, k in items:
            used[n] = used.get(n, 0) + k * times
    assert used == {n: c for n, c in histogram.items() if c}


def best_by_search(items, window):
    """Fewest windows, by trying all ways to place the items one after the other."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= items[k]:
                rest = list(bins)
                rest.remove(room)
                go(k + 1, [*rest, room - items[k]])
        go(k + 1, [*bins, window - items[k]])

    go(0, [])
    return best[0]


def test_as_few_windows_as_exhaustive_search():
    rng = np.random.default_rng(3)
    for k in range(3000):
        window = int(rng.integers(8, 60))
        items = rng.integers(1, window + 1, int(rng.integers(1, 13)))
        items = (np.maximum(1, items // 2) if k % 2 else items).tolist()
        histogram = {n: items.count(n) for n in set(items)}
        patterns, bound = packing.solve(histogram, window)
        check(histogram, patterns, window)
        used = sum(t for _, t in patterns)
        assert used == bound  # proved by the search
        assert packing.lower_bound([histogram.get(n, 0) for n in range(window + 1)], window) <= used
        if used > -(-sum(items) // window):
            assert used == best_by_search(items, window)


def test_a_filling_need_not_be_laid_as_often_as_can_be():
    items = [2, 2, 4, 4, 5, 5, 5, 5, 7, 8, 8]
    histogram = {n: items.count(n) for n in set(items)}
    for steps in (packing.STEPS, None):
        patterns, bound = packing.solve(histogram, 14, steps)
        check(histogram, patterns, 14)
        assert sum(t for _, t in patterns) == bound == 4


def test_the_search_ends_with_its_steps():
    rng = np.random.default_rng(4)
    values, counts = np.unique(rng.integers(300, 700, 2000), return_counts=True)
    histogram = dict(zip(values.tolist(), counts.tolist(), strict=True))
    for steps in (0, 1, 100, 5000):
        patterns, bound = packing.solve(histogram, 1024, steps)
        check(histogram, patterns, 1024)
        assert bound <= sum(t for _, t in patterns)


def test_large_histograms_come_to_the_bound():
    rng = np.random.default_rng(1)
    values, counts = np.unique(np.clip(np.exp(rng.normal(5.5, 1, 100_000)).astype(int), 1, 1024), return_counts=True)
    histogram = dict(zip(values.tolist(), counts.tolist(), strict=True))
    patterns, bound = packing.solve(histogram)
    check(histogram, patterns, 1024)
    assert sum(t for _, t in patterns) == bound


def test_odd_histograms():
    assert packing.solve({}) == ([], 0)
    assert packing.solve({1024: 3})[0] == [(((1024, 1),), 3)]
    with pytest.raises(ValueError):
        packing.solve({1025: 1})


def test_pieces_and_places(spark):
    texts = [None, "", "a", "word " * 3000, "the cat sat " * 100, "x", "x", "é漢字" * 700, "tail"]
    rows = [(k, t, "other", 7) for k, t in enumerate(texts)] + [(None, "no id", "o", 1), (3, "again", "o", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string, part int").repartition(3)
    got = packing.pack(df, vocabulary()).collect()
    library = Tokenizer.from_file(vocabulary())
    want = []
    for i, t, _, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at, size = 0, len(ids) % 1024 or 1024
        for piece in range(-(-len(ids) // 1024)):
            want.append((i, piece, at, size, zlib.crc32(ids[at : at + size].tobytes())))
            at, size = at + size, 1024
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(df.limit(0), vocabulary()).count() == 0
