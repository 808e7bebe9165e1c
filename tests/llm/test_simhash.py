import numpy as np
import pytest
import xxhash

from seqmill.llm import simhash


def plain_fingerprint(text):
    """By the definition, bit by bit."""
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in t.encode().split() if w]
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(words, budget=4):
    label = np.arange(len(words))
    near = np.bitwise_count(words[:, None] ^ words[None, :]) <= budget
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def clusters(seed, groups=15, each=30, noise=200):
    rng = np.random.default_rng(seed)
    out = list(rng.integers(0, 1 << 63, noise, dtype=np.uint64))
    for base in rng.integers(0, 1 << 63, groups, dtype=np.uint64):
        for _ in range(each):
            x = base
            for k in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= np.uint64(1) << np.uint64(k)
            out.append(x)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("text", ["", None, " \t\n\x0b\x0c\r", "One", "a b c", "a b c d", "A b C d e É x\xa0y", "x " * 500, "The cat sat on the mat and the dog sat on the log"])
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("leaf", [1, 40, 1 << 14])
def test_trie_join_finds_all_links(leaf, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    for seed in range(3):
        words = clusters(seed)
        assert (simhash.trie_links(words) == plain_components(words)).all()
    assert len(simhash.trie_links(np.zeros(0, np.uint64))) == 0


def test_layouts():
    words = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    for n, parts, copies in ((1000, 5, 5), (simhash.AIM << 12, 6, 15), (simhash.AIM << 22, 7, 35), (simhash.AIM << 40, 7, 35)):
        laid, shift = simhash.layouts(n, 4)
        assert len(laid.moves) == copies and shift <= laid.front
        fronts = np.stack([laid.lay(words, k) >> np.uint64(64 - laid.front) for k in range(copies)])
        for k in range(copies):
            assert (laid.back(laid.lay(words, k), k) == words).all()
        flips = np.random.default_rng(2)
        for i in range(100):  # four bits changed: the front of some layout is as it was
            x = words[i]
            for b in flips.choice(64, 4, replace=False):
                x = x ^ np.uint64(1) << np.uint64(b)
            one = np.array([laid.lay(np.array([x]), k)[0] >> np.uint64(64 - laid.front) for k in range(copies)])
            assert (one == fronts[:, i]).any()


@pytest.mark.parametrize(("tile", "aim"), [(1 << 16, simhash.AIM), (37, simhash.AIM), (1 << 16, 1 / 64), (50, 1 / (1 << 16))])
def test_forest_connects_what_links_connect(spark, tile, aim, monkeypatch):
    from seqmill.llm.graph import components

    if aim < 1:  # as if there were very many fingerprints
        plain = simhash.layouts
        monkeypatch.setattr(simhash, "layouts", lambda n, budget, _: plain(int(n / aim), budget, 1))

    words = clusters(9)
    df = spark.createDataFrame([(int(x),) for x in words.view(np.int64)], "fp long").repartition(3)
    roots = {r.node: r.root for r in components(simhash.link_forest(df, tile=tile)).collect()}
    want = plain_components(words)
    got = [roots.get(int(x), int(x)) for x in words.view(np.int64)]
    assert len({(a, b) for a, b in zip(want, got, strict=True)}) == len(set(want)) == len(set(got))


def test_components_of_a_path(spark):
    from seqmill.llm.graph import components

    edges = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(100, 100), (7, 7)], "u long, v long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(k, 0) for k in range(1, 61)}
    assert components(edges.limit(0)).count() == 0


def test_rows_keep_their_ids_and_nulls(spark):
    long = "word " * 40 + "tail"
    rows = [(5, "same text here now", "x"), (3, "same text here now", "y"), (9, None, "z"), (8, "", "z"), (None, "alone in the whole wide world", None), (4, long, "a"), (4, long, "a"), (2, "quite another text it is", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[5] == by[3] == {3} and by[9] == by[8] == {8} and by[None] == {None} and by[4] == {4} and by[2] == {2}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 2), (False, 3), (False, 4), (False, 8), (True, None)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0
