import math
import random
import zlib

import numpy as np
import pytest

from seqmill.llm import langid

SYLLABLES = {"en": ["the", "ing", "and", "er"], "de": ["sch", "ung", "ein", "lich"], "fr": ["eux", "ment", "oi", "re"]}


def rows(n=600, seed=3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 30))]
        out.append((k, " ".join(words), lang, f"{lang}.host{k % 4}.example"))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, lang string, source string, language string")
    return data, docs, langid.learn(docs, host="source")


def test_held_out_accuracy(learned):
    data, docs, how = learned
    got = {r.doc_id: r for r in langid.identify(docs, how).collect()}
    held = [(i, lang) for i, _, lang, _ in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == len(data)
    assert sum(got[i].language == lang for i, lang in held) / len(held) > 0.98
    assert langid.keep_identified(docs, how).count() > 0.97 * len(data)


def test_counts_by_definition(learned):
    data, _, how = learned
    counts = np.zeros((3, langid.BUCKETS))
    for i, t, lang, _ in data:
        if zlib.crc32(str(i).encode()) % 5 != 0:
            for b in langid.buckets(t):
                np.add.at(counts[how.model.languages.index(lang)], b, 1)
    mean, want = sum(c / c.sum() for c in counts) / 3, np.zeros_like(counts)
    for k, c in enumerate(counts):
        kinds = np.count_nonzero(c)
        want[k] = langid.TEMPER * np.log((c + kinds * (mean / 2 + 0.5 / langid.BUCKETS)) / (c.sum() + kinds))
    assert np.allclose(how.model.table[:3], want)


def test_all_evidence_is_fused(spark, learned):
    """Posterior against the formula written out, for rows with markup, address and host."""
    _, _, how = learned
    how = langid.Identifier(how.model, "html", address="url")
    langs = how.model.languages
    pages = [(1, '<html lang="de">', "http://a.b.de/x"), (2, "<HTML lang=fr>", "https://a.b.de/fr/1"), (3, "", "http://c.example/"), (4, None, None), (5, "the ing and the", "http://c.example/de/")]
    df = spark.createDataFrame(pages, "page_id long, html string, url string")
    said = {1: ("de", "de"), 2: ("fr", "fr"), 3: (None, None), 4: (None, None), 5: (None, "de")}
    hosts = {1: ("a.b.de", "de"), 2: ("a.b.de", "de"), 3: ("c.example", "example"), 4: (None, None), 5: ("c.example", "example")}
    ll, soft = {}, lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    rates = []
    for kind, first in ((0, 0.9), (1, 0.8)):  # counted where the text alone is sure
        sure = {i: langs[int(p.argmax())] for i, html, _ in pages for p in [soft(how.model.log_likelihoods(html))] if p.max() >= 0.99}
        told = [said[i][kind] == lang for i, lang in sure.items() if lang != "und" and said[i][kind]]
        rates.append((sum(told) + 20 * first) / (len(told) + 20))
    for i, html, _ in pages:
        x = how.model.log_likelihoods(html).copy()
        for s, r in zip(said[i], rates, strict=True):
            if s:
                x += [math.log(r) if lang == s else math.log((1 - r) / (len(langs) - 1)) for lang in langs]
        ll[i] = x
    own = {i: soft(x) for i, x in ll.items()}
    corpus = sum(own.values()) + 1.0
    corpus[-1] = langid.UND_PRIOR * corpus[:-1].sum()
    base = corpus / corpus.sum()
    for r in langid.identify(df, how, "page_id").collect():
        i, (host, suffix) = r.page_id, hosts[r.page_id]
        prior = base
        if host:
            s = sum(own[j] for j in own if hosts[j][1] == suffix)
            prior = (s + 50 * base) / (s.sum() + 50)
            h = sum(own[j] for j in own if hosts[j][0] == host and j != i) if any(hosts[j][0] == host and j != i for j in own) else np.zeros(len(langs))
            prior = (h + 10 * prior) / (h.sum() + 10)
        p = soft(ll[i] + np.log(prior))
        assert r.language == langs[int(p.argmax())] and abs(r.posterior - p.max()) < 2e-6, i


def test_hosts_with_many_rows_are_dealt_out(learned, monkeypatch):
    """Whether a host is joined in parts or whole, results are the same."""
    _, docs, how = learned
    a = {(r.doc_id, r.language, r.posterior) for r in langid.identify(docs, how).collect()}
    monkeypatch.setattr(langid, "HOT_SHARE", 0.1)
    assert a == {(r.doc_id, r.language, r.posterior) for r in langid.identify(docs, how).collect()}


def test_reliabilities_are_counted(spark, learned):
    data, _, how = learned
    how = langid.Identifier(how.model, "text", address="url", markup="html")
    long = [(i, " ".join([t] * 20), lang) for i, t, lang, _ in data if len(t) > 60][:300]
    others = {"en": "de", "de": "fr", "fr": "en"}
    rows = [(i, t, f"<html lang='{lang if k % 4 else others[lang]}'>", f"http://h.{('fr' if lang == 'fr' else 'com') if k % 2 else 'de'}/") for k, (i, t, lang) in enumerate(long)]
    seen, names = how.evidence(spark.createDataFrame(rows, "doc_id long, text string, html string, url string"))
    rates = how.reliabilities(seen, names)
    told = sum(k % 4 > 0 for k in range(len(long)))
    assert rates["declared"] == pytest.approx((told + 20 * 0.9) / (len(long) + 20))
    says = [("fr" if lang == "fr" else None) if k % 2 else "de" for k, (_, _, lang) in enumerate(long)]
    right = sum(s == lang for s, (_, _, lang) in zip(says, long, strict=True))
    assert rates["says"] == pytest.approx((right + 20 * 0.8) / (sum(s is not None for s in says) + 20))


def test_many_languages(spark):
    """150 languages, each with as few bytes as a language needs: all are learned and told apart."""
    rng, rows = random.Random(11), []
    for k in range(150):
        syllables = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(8)]
        rows += [(1000 * k + j, " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(60)), f"l{k:03}", "h") for j in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    how = langid.learn(docs, host="source")
    assert how.model.languages == [*(f"l{k:03}" for k in range(150)), "und"]
    truth = {i: lang for i, _, lang, _ in rows}
    held = [r for r in langid.identify(docs, how).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 200 and sum(r.text_language == truth[r.doc_id] for r in held) / len(held) > 0.99


def test_clashing_columns_stay(spark, learned):
    data, docs, how = learned
    own = docs.selectExpr("*", "'a' AS __ll", "'b' AS __host", "'c' AS host", "'d' AS salt", "'e' AS `a.b`")
    kept = langid.keep_identified(own, how)
    assert kept.columns == own.columns
    assert {tuple(r)[-5:] for r in kept.collect()} == {("a", "b", "c", "d", "e")}


def test_odd_rows(spark, learned):
    _, _, how = learned
    odd = spark.createDataFrame([(1, None, None), (2, "", ""), (None, "12 34 !!", "h"), (3, "schung " * 60_000, "h"), (3, "schung einlich " * 9, None)], "doc_id long, text string, source string")
    got = langid.identify(odd, how).collect()
    assert len(got) == 5 and {r.language for r in got if r.doc_id == 3} == {"de"}
    assert langid.identify(odd.limit(0), how).count() == 0 and langid.keep_identified(odd.limit(0), how).count() == 0
    none = langid.learn(odd.selectExpr("*", "CAST(NULL AS string) AS lang"), host="source")
    assert {r.language for r in langid.identify(odd, none).collect()} == {"und"}


def test_rare_languages_are_learned(spark, monkeypatch):
    """Two languages with less than a hundredth of the rows, one of them in a script of its own."""
    rng, data = random.Random(7), rows(3000)
    rare = {"el": ["και", "της", "ου", "ειν"], "pt": ["ção", "lha", "nho", "ões"]}
    for lang, syllables in rare.items():
        data += [(len(data) + k, " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(40)), lang, "x") for k in range(25)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    how = langid.learn(docs, host="source")
    assert how.model.languages == ["de", "el", "en", "fr", "pt", "und"]
    got = {r.doc_id: r for r in langid.identify(docs, how).collect()}
    assert all(got[i].language == lang and got[i].accepted for i, _, lang, _ in data if lang in rare)
    monkeypatch.setattr(langid, "LANGUAGES", 4)
    with pytest.raises(ValueError):
        langid.learn(docs, host="source")


def test_a_language_of_one_short_document(spark):
    """It is in the model and its other texts are found; texts of the others, and of none, stay where they were."""
    rng, data = random.Random(23), rows(1500, 5)
    own = ["zwa", "kru", "pli", "dso", "wyx"]
    text = lambda n: " ".join("".join(rng.choice(own) for _ in range(rng.randint(1, 3))) for _ in range(n))
    data = [*data, (1, text(12), "zz", "h"), *((10_000 + k, text(20), None, "h") for k in range(40))]
    data += [(20_000 + k, " ".join("".join(rng.choice("ωψξφγδλ") for _ in range(6)) for _ in range(20)), None, "h") for k in range(20)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    how = langid.learn(docs, host="source")
    assert how.model.languages == ["de", "en", "fr", "zz", "und"]
    got = {}
    for r in langid.identify(docs, how).collect():
        got.setdefault(r.doc_id, r)
    assert sum(got[i].language == "zz" for i in range(10_000, 10_040)) >= 38
    assert {got[i].language for i in range(20_000, 20_020)} == {"und"} and not any(got[i].accepted for i in range(20_000, 20_020))
    rest = [(i, lang) for i, _, lang, _ in data if lang not in (None, "zz") and i != 1]
    assert sum(got[i].language == lang for i, lang in rest) / len(rest) > 0.98
    blank = spark.createDataFrame([(1, "12 34", "xx", "h"), (3, "the ing and", "en", "h")], docs.schema)
    assert langid.learn(blank, host="source").model.languages == ["en", "und"]


def test_pages_whose_markup_is_hidden(spark):
    """Languages of pages by text and host alone, held against what their markup declares."""
    import re

    from pyspark.sql import functions as F

    from seqmill.session import table

    sf = "/root/testdata/sf0.1"
    model = langid.learn(table(spark, sf, "documents")).model
    pages = table(spark, sf, "pages")
    said = {r.page_id: m[1].lower() for r in pages.collect() if (m := re.search(r"""<html[^>]*\blang\s*=\s*["']?([a-zA-Z]{2})""", r.html or ""))}
    text = F.regexp_replace("html", r"(?s)<(script|style).*?</\1>|<[^>]*>", " ")
    hidden = pages.select("page_id", text.alias("text"), F.regexp_extract("url", langid.HOST, 1).alias("host"))
    got = {r.page_id: r.language for r in langid.identify(hidden, langid.Identifier(model, "text", host="host"), "page_id").collect()}
    right = sum(got[i] == lang for i, lang in said.items())
    print(f"{right} of {len(said)} pages as their hidden markup says")
    assert len(said) > 1000 and right / len(said) > 0.9


def test_query_on_odd_pages(spark, tmp_path):
    """Pages without address or markup, empty or null, each have a row."""
    from seqmill.llm.queries import language_of_pages

    spark.createDataFrame([(k, t, lang, "h") for k, t, lang, _ in rows(200)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(1, None, None), (2, "", ""), (None, "http://x.de/", "<html lang=de>"), (4, "no address", "<html lang='fr'><body>12"), (4, None, "sch ung ein lich schung " * 9)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = language_of_pages(spark, str(tmp_path)).collect()
    assert len(got) == 5 and all(r.language is not None and 0 <= r.posterior <= 1 for r in got)
    assert {r.language for r in got if r.page_id is None} == {"de"}


def test_query_over_pages(spark):
    """Every page is identified, and what its markup or path says is found in nearly all of those that say something."""
    import re

    from seqmill.llm.queries import language_of_pages

    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in language_of_pages(spark, sf).collect()}
    assert got.keys() == pages.keys() and all(0 <= r.posterior <= 1 for r in got.values())
    said = {i: m[1].lower() for i, r in pages.items() if (m := re.search(r"""<html[^>]*\blang\s*=\s*["']?([a-zA-Z]{2})""", r.html or ""))}
    assert len(said) > 100 and sum(got[i].language == lang for i, lang in said.items()) / len(said) > 0.9
