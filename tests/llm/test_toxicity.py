import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from seqmill.llm import toxicity as tox


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_automaton_by_edit_distance():
    terms = {"idiot": False, "moron": False, "clown": False, "disgusting": False, "scum": False, "grumbl": True}
    lexicon = tox.Lexicon(terms, frozenset({"crown"}))
    rng = random.Random(4)
    for _ in range(20_000):
        w = list(rng.choice(list(terms)))
        for _ in range(rng.randint(0, 2)):
            k, kind = rng.randint(0, len(w)), rng.randint(0, 2)
            if kind == 0:
                w.insert(k, rng.choice("abdiotmrncwl"))
            elif w and kind == 1:
                w.pop(min(k, len(w) - 1))
            elif w:
                w[min(k, len(w) - 1)] = rng.choice("abdiotmrncwl")
        w = "".join(w)
        near = any(not p and len(t) >= 5 and distance(w, t) <= 1 for t, p in terms.items())
        want = 0 if terms.get(w) is False else 1 if w.startswith("grumbl") else 2 if near and w != "crown" and len(w) >= 4 else None
        got = lexicon.match(w)
        assert (got[0] if got else None) == want, w


def test_context_tells_quotation_from_abuse():
    match = tox.Matcher(tox.Lexicon({"moron": False}))
    at = dict(zip(tox.FEATURES, range(len(tox.FEATURES)), strict=True))
    quoted, abuse = match.features('He said: "moron", and left'), match.features("you moron, go away")
    assert quoted[at["quoted"]] > 0 and quoted[at["exact"]] == 0
    assert abuse[at["exact"]] > 0 and abuse[at["addressed"]] > 0 and abuse[at["quoted"]] == 0
    assert match.features(None) == match.features("") == [0.0] * len(tox.FEATURES)


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["ba", "ko", "ti", "re", "lu", "ne"]) for _ in range(rng.randint(2, 4))) for _ in range(300)]
    rows = []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 80))]
        bad = k % 8 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(["zwimpel", "zwimpel", "zwimpl", "grofex", "Grofex,"])
        rows.append((k, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 0, 1), (5, 0, None), (99_999, 0, 1)], "doc_id long, quality int, toxic int")
    return rows, docs, labels, tox.learn(docs, labels)


def test_held_out_accuracy(learned):
    rows, docs, _, model = learned
    truth = {i: y for i, _, y in rows}
    held = [r for r in tox.score(docs, model).collect() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held)


def test_odd_rows_and_the_filter(spark, learned):
    _, docs, labels, model = learned
    odd = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "zwimpel grofex " * 20_000, "x"), (2, "zwimpel " * 3, "x"), (3, "bako tire " * 9, None)], "doc_id long, text string, __score string")
    got = tox.score(odd, model).collect()
    assert len(got) == 5 and {(r.doc_id, r.predicted) for r in got} == {(1, 0), (None, 0), (2, 1), (3, 0)}
    kept = tox.keep_clean(odd, model)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]
    assert {r["__score"] for r in kept.collect()} == {"x", None}  # a column of the input, as it was
    dotted = odd.select(F.col("doc_id").alias("doc.id"), F.col("text").alias("a.text"))
    assert tox.score(dotted, model, "doc.id", "a.text").where("predicted = 1").count() == 2 and tox.keep_clean(dotted, model, "a.text").count() == 3
    assert tox.score(odd.limit(0), model).count() == 0
    untaught = tox.learn(docs, labels.limit(0))
    assert {r.predicted for r in tox.score(docs, untaught).collect()} == {0}


def plain_features(text, lexicon):
    """By definition, match by match."""
    words = [(m.group(), m.start(), m.end()) for m in tox.WORD.finditer(text.lower())]
    counts, quoted, addressed, terms = [0, 0, 0], 0, 0, set()
    for k, (w, begin, end) in enumerate(words):
        m = lexicon.match(w)
        if m is None:
            continue
        terms.add(m[1])
        before, after = words[max(0, k - tox.WINDOW) : k], words[k + 1 : k + 1 + tox.WINDOW]
        left = text.lower()[before[0][1] if before else begin : begin]
        right = text.lower()[end : (after[-1][2] if after else end) + 1]
        near = {x for x, _, _ in [*before, *after]} | {w}
        marked = any(c in tox.OPEN for c in left) and any(c in tox.CLOSE for c in right)
        told = not near & tox.ADDRESS and any(x in tox.REPORT for x, _, _ in before)
        if marked or told:
            quoted += 1
        else:
            counts[m[0]] += 1
            addressed += bool(near & tox.ADDRESS)
    return [math.log1p(x) for x in (*counts, quoted, addressed, len(terms), 100 * sum(counts) / max(1, len(words)))]


def test_features_by_definition():
    rng = random.Random(8)
    lexicon = tox.Lexicon({"zwimpel": False, "grofe": True}, fuzzy=frozenset({"grofe"}))
    bits = ["zwimpel", "zwimpe", "grofexes", "you", "said", "wrote", "the", "cat", '"', '"', "\u201c", "\u201d", ",", "grfex", "dog", "a", "b"]
    for _ in range(2000):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        assert tox.Matcher(lexicon).features(text) == pytest.approx(plain_features(text, lexicon))


def test_many_and_long_terms():
    """No cap on terms, nor on their letters: every one of 5,000 terms is found with an edit, and so is one of 70 letters."""
    rng = random.Random(9)
    words = {"".join(rng.choice("abcdefghijklmnopqrst") for _ in range(12)) for _ in range(5000)} | {"ab" * 35}
    lexicon = tox.Lexicon(dict.fromkeys(words, False))
    for w in words:
        at = rng.randrange(1, len(w))
        assert lexicon.match(w[:at] + "z" + w[at:]) == (2, w) and lexicon.match(w) == (0, w)
    assert lexicon.match("ab" * 36) is None and lexicon.match("q" * 1_000_000) is None


def test_a_large_lexicon_is_learned(spark):
    """Each of 1,200 terms stands in six toxic documents; none is left out."""
    rng = random.Random(10)
    words = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(1200)]
    rows = [(k, " ".join(rng.sample(words, 30)) if k % 3 == 0 else "clean text of no note", int(k % 3 == 0)) for k in range(1500)]
    lexicon = tox.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    held = {w: sum(w in t.split() for _, t, y in rows if y) for w in words}
    sure = [w for w, n in held.items() if n > 13]
    assert len(sure) > 300 and all(lexicon.match(w) is not None for w in sure)


def test_prefixes_take_an_edit():
    """By edit distance: to a start of the word for prefixes, to the word for whole words under a prefix."""
    terms, under = {"stupid": True, "zwim": True, "moron": False}, {"zwimpel", "stupidly"}
    lexicon = tox.Lexicon(terms, frozenset({"stupor"}), frozenset({"stupid", "zwim", *under}))
    assert [lexicon.match(w) for w in ("stupidly", "stuppid", "stpidly", "zwmpel", "zwxm", "stupor")] == [(1, "stupid"), (2, "stupid"), (2, "stupidly"), (2, "zwimpel"), None, None]
    rng = random.Random(5)
    for _ in range(20_000):
        w = list(rng.choice([*terms, *under]) + rng.choice(["", "", "e", "ness"]))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(["", "s", "t", "i", "pp", "mo"])
            w = list("".join(w)) or ["x"]
        w = "".join(w)
        near = any(distance(w, t) <= 1 for t in ("moron", *under)) or any(distance(w[:k], "stupid") <= 1 for k in range(len(w) + 1))
        want = 0 if w == "moron" else 1 if w.startswith(("stupid", "zwim")) else 2 if near else None
        got = lexicon.match(w)
        assert (got[0] if got else None) == want, w


def test_misspelt_stems_of_learned_prefixes(spark):
    """A stem with several endings becomes a prefix; held-out texts with an edit inside the stem are still caught."""
    rng, rows, bent = random.Random(6), [], set()
    for k, text, bad in corpus(2400):
        if bad:
            text = " ".join(w for w in text.split() if not w.lower().startswith(("zwim", "grofex")))
            stem = "stupid"
            if k % 32 == 0:
                at = rng.randrange(1, 5)
                stem, _ = stem[:at] + rng.choice("abcefghjk") + stem[at + rng.randint(0, 1) :], bent.add(k)
            text += f" {stem}{rng.choice(['ly', 'e', 'ity', 'ness'])}"
        rows.append((k, text, bad))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = tox.learn(docs, labels)
    prefixes = [t for t, prefix in model.lexicon.terms.items() if prefix]
    assert any("stupid".startswith(p) for p in prefixes), prefixes
    held = [r for r in tox.score(docs, model).collect() if r.held_out]
    caught = [r.predicted for r in held if r.doc_id in bent]
    assert len(caught) > 8 and sum(caught) / len(caught) > 0.9
    assert sum(r.predicted == (r.doc_id % 8 == 0) for r in held) / len(held) > 0.97


def test_a_sign_inside_a_word_takes_the_edit():
    lexicon = tox.Lexicon({"idiot": False, "stupid": False, "clown": False, "grumbl": True}, frozenset({"mo.rons"}), frozenset({"grumbl"}))
    match = tox.Matcher(lexicon)
    at = dict(zip(tox.FEATURES, range(len(tox.FEATURES)), strict=True))
    for word in ("st*pid", "id1ot", "idi_ot", "stu-pid", "cl0wn", "St.upid", "gr*mbling"):
        f = match.features(f"well you {word}, go")
        assert f[at["fuzzy"]] == math.log1p(1) and f[at["addressed"]] == math.log1p(1) and f[at["exact"]] == 0, word
    for text in ("e-mail x_1 3.5 a/b", "st**pid", "s*up*d", "id1", "st *pid", "un-idiomatic", "*stu", "don't", "", "12_34"):
        assert match.features(text) == [0.0] * len(tox.FEATURES), text
    # words that are matched by themselves do not count once more; quoted ones are quoted
    assert match.features("you stupid-idiot")[at["exact"]] == math.log1p(2) and match.features("you stupid-idiot")[at["fuzzy"]] == 0
    assert match.features('she said "st*pid" once')[at["quoted"]] == math.log1p(1)
    assert tox.Lexicon({"moron": False}, frozenset({"mor.on"})).match_inner("mor.on") is None


def test_inner_signs_against_a_plain_scan():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("abé日_1*.' \n-") for _ in range(rng.randint(0, 40)))
        want = []
        for i, c in enumerate(text):
            if not (c.isalpha() or c.isspace() or c == "'") and 0 < i < len(text) - 1 and text[i - 1].isalpha() and text[i + 1].isalpha():
                a, b = i, i + 1
                while a and text[a - 1].isalpha():
                    a -= 1
                while b < len(text) and text[b].isalpha():
                    b += 1
                want.append((a, i, b))
        assert list(tox.inner_signs(text, 80)) == want
        assert list(tox.inner_signs(text, 3)) == [w for w in want if w[1] - w[0] < 3]


def test_counts_and_lexicon_against_a_plain_version(spark):
    """Documents by word and prefix, and the terms that their evidence gives, counted one text at a time."""
    rng = random.Random(17)
    docs, plain = [], [rng.choice("bdgklmnprst") + "".join(rng.choice(["a", "e", "ir", "ol", "un"]) for _ in range(3)) for _ in range(200)]
    for k in range(700):
        words = [rng.choice(plain) for _ in range(30)]
        if k % 7 == 0:
            words[3:6] = [rng.choice(["vexling", "vexlings", "vexlingo", "dunderk"]), rng.choice(plain), "brunzel"]
        docs.append((k, int(k % 7 == 0), " ".join(words)))
    train = spark.createDataFrame(docs, "doc_id long, toxic int, text string").repartition(5)
    counted = train.select("toxic", "text").mapInArrow(tox._partial_counts, "term string, prefix boolean, bad long, good long").groupBy("term", "prefix").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    want = {}
    for _, toxic, text in docs:
        words = set(tox.WORD.findall(text.lower()))
        for item in {(w, False) for w in words} | {(w[:n], True) for w in words for n in range(4, min(12, len(w)) + 1)}:
            want.setdefault(item, [0, 0])[0 if toxic else 1] += 1
    assert {(r.term, r.prefix): [r.bad, r.good] for r in counted.collect()} == want
    bad, good = sum(t for _, t, _ in docs), sum(1 - t for _, t, _ in docs)
    share = bad / (bad + good)
    strong = {
        item
        for item, (b, g) in want.items()
        if b > 1 and b / (b + g) > share and b * math.log(b / (b + g) / share) + (g * math.log(g / (b + g) / (1 - share)) if g else 0) >= tox.EVIDENCE and b / (b + (g + 0.5) / math.sqrt(max(1, good / bad))) >= tox.PURITY
    }
    lexicon = tox.learn_lexicon(train)
    assert lexicon.terms.keys() <= {t for t, _ in strong}
    for term, _ in strong:  # each is a term, or stands under one, or leads to one that nearly all of its documents have
        assert term in lexicon.terms or any(term.startswith(t) or t.startswith(term) for t in lexicon.terms), term
    assert lexicon.terms.get("brunzel") is False and any(p and "vexling".startswith(t[:7]) for t, p in lexicon.terms.items())
    assert tox.Matcher(lexicon).features("you brun-zel")[tox.FEATURES.index("fuzzy")] > 0
