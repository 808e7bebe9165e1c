import random
import re
from itertools import permutations

import pytest

from seqmill.llm import audit

DOCS = "doc_id long, text string, source string, n long, mask string, good int"
LABELS = "doc_id long, quality int, toxic int, text string"


def plain_mask(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text))]
    return sum(1 << k for k, f in enumerate(fails) if f)


def plain(docs, labels):
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = {}
    for i, text, source, *_ in docs:
        text = text or ""
        mask = plain_mask(text) + 16 * (i is not None and i > least[text])
        good = any(d == i and q == 1 for d, q, *_ in labels if i is not None)
        toxic = any(d == i and t == 1 for d, _, t, *_ in labels if i is not None)
        parts.setdefault(source or "", []).append((mask, good, toxic))
    out = []
    for part, rows in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = rows, []
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                lost = [r for r in left if r[0] & bit]
                redundant = sum(1 for r in gone if r[0] & bit)
                left, gone = [r for r in left if not r[0] & bit], gone + lost
                removed_by[f] += len(lost)
                out.append([part, "".join(order), step, f, len(left), len(lost), redundant, sum(r[0] == bit for r in rows), sum(r[1] for r in lost), sum(r[2] for r in lost)])
        out = [[*r, removed_by[r[3]]] if r[0] == part and len(r) == 10 else r for r in out]
    return sorted(map(tuple, out))


def text_of(rng):
    words = ["ba", "Ko", "TI", "re", "lu", "ne", "né", "x#", "|", "日本"]
    n = rng.choice([0, 1, 49, 50, 51, 80, 130])
    base = [rng.choice(words[: rng.randint(1, len(words))]) for _ in range(n)]
    if rng.random() < 0.5:
        base = [w + str(k) for k, w in enumerate(base)]
    return rng.choice(["", " ", "\t"]) + rng.choice([" ", "\n", "\x0b", "  ", " "]).join(base)


def test_against_every_order_in_turn(spark):
    rng = random.Random(13)
    texts = [text_of(rng) for _ in range(40)] + [None, "", " \x0c", "A" * 20 + "a" * 380]
    docs = [(rng.choice([None, rng.randint(0, 150)]) if rng.random() < 0.3 else k, rng.choice(texts), rng.choice([None, "", "a", "a", "b"]), 1, "m", 2) for k in range(200)]
    docs += docs[:9] + [(1000 + k, "the same text", "hot", 0, "", 0) for k in range(150)]
    labels = [(rng.choice([None, rng.randint(0, 1100)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1]), "clash") for _ in range(300)]
    found = audit.audit(audit.cells(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)))
    assert found.columns == ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert dict(found.dtypes)["step"] == "int" and {t for c, t in found.dtypes[4:]} == {"bigint"}
    assert sorted(map(tuple, found.collect())) == plain(docs, labels)


def test_empty_tables_and_limits(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.audit(audit.cells(docs, labels)).count() == 0
    one = spark.createDataFrame([(7, "a", "s", 0, "", 0)], DOCS)
    rows = audit.audit(audit.cells(one, labels)).collect()
    assert len(rows) == 600 and sum(r["removed"] for r in rows) == 120 and {r["shapley"] for r in rows if r["filter"] == "A"} == {120}
    for bad in ("", "AA", "ABCDEFGHI", "A'"):
        with pytest.raises(ValueError):
            audit.audit(audit.cells(one, labels), bad)


def test_other_filters_by_their_masks(spark):
    cells = spark.createDataFrame([("p", 3, 10, 4, 1), ("p", 1, 5, 5, 0), ("p", 0, 2, 1, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["good_lost"], r["shapley"]) for r in audit.audit(cells, "xy").collect()}
    assert got == {("xy", 1): (2, 15, 0, 9, 20), ("xy", 2): (2, 0, 10, 0, 10), ("yx", 1): (7, 10, 0, 4, 10), ("yx", 2): (2, 5, 10, 5, 20)}
