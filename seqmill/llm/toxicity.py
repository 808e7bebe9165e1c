"""Toxicity: a learned lexicon, misspellings by Levenshtein automata, and context windows.

Learning. Of the labelled training rows at most ``FIT_ROWS``, taken by a hash of the id, are learned
from; so the bound is a parameter, and scores cover all rows. Grouped aggregation over them counts, for each word and each prefix
of a word, the documents of either label that hold it. Strings that mark toxic documents become the
lexicon: whole words, and prefixes whose words are many. A word that occurs in clean training
documents is noted as known, so that it is not taken for a misspelling.

Matching. The lexicon is a trie. A word of a text is a Levenshtein automaton, held as one bit mask
for each number of edits; both are walked together, and a branch ends when no state is left. Short
terms take no edit, longer ones one; a learned prefix takes it within the prefix, and the whole words
that a prefix stands for stay in the trie as fuzzy terms. A digit or a sign between two letters may
stand for a letter, or for none: what lies around it is one word then, which takes that edit. Words
repeat, so a worker keeps what it has matched.

Context. Each match is looked at within a window of words: quotation marks around it and verbs of
reporting before it speak for quotation, words of address for abuse. A logistic model over counts of
matches by kind turns this into a score; it is fitted to the features of the same rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmill.session import fresh, small_batches, stored

FOLDS, HELD_OUT = 5, 0
EVIDENCE = 14.0  # log likelihood ratio, against the share of toxic documents in all, that a term needs
PURITY = 0.8  # share of toxic documents among those with a term, smoothed
PREFIX = (4, 12)  # lengths of prefixes that are tried as terms
FUZZY_FROM = 5  # a whole term takes one edit from this length on
FIT_ROWS = 20_000  # bound of the labelled sample that the model is fitted to
WINDOW = 6  # words looked at on each side of a match
KEPT = 200_000  # words that a worker keeps
COUNTED = 500_000  # words and prefixes that a task counts before it passes them on

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: A digit or sign (of ASCII, but for the apostrophe) with a letter on both sides, and the letters before and after it.
INNER = re.compile(r"[!-&(-@\[-`{-~](?<=[^\W\d_].)(?=[^\W\d_])")
BEFORE, AFTER = re.compile(r"[^\W\d_]+\Z"), re.compile(r"[^\W\d_]+")
#: Fixed word lists: verbs of reporting, and words that address the reader, in the corpus' languages.
REPORT = frozenset("said says say wrote writes called calls quote quoted quotes term word words dit disait écrit appelé appelle mot sagte sagt schrieb nannte nennt wort dijo dice escribió llamó llama palabra".split())
ADDRESS = frozenset("you your youre u ur tu te toi vous votre du dich dir dein ihr euch tú usted ustedes eres sois".split())
OPEN, CLOSE = "\"“«„‘", "\"”»“’"

FEATURES = ("exact", "prefix", "fuzzy", "quoted", "addressed", "kinds", "density")


# -- lexicon --------------------------------------------------------------------------------------


def _with_gaps(word: str) -> set[str]:
    """The word, and the word with each of its letters left out."""
    return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}


def _starts_within_edit(word: str, term: str) -> bool:
    """Is a start of the word within one edit of the term? The edit can stand at the first letters that differ."""
    i = 0
    for a, b in zip(word, term, strict=False):
        if a != b:
            break
        i += 1
    rest = term[i + 1 :]
    return word.startswith(rest, i) or word.startswith(rest, i + 1) or word.startswith(term[i:], i + 1)


def inner_signs(text: str, longest: int) -> Iterator[tuple[int, int, int]]:
    """Words with one sign inside, among their first letters: (begin, sign, end)."""
    for m in INNER.finditer(text):
        at = m.start()
        left = BEFORE.search(text, max(0, at - longest), at)
        if left is not None and at - left.start() < longest:
            yield left.start(), at, AFTER.match(text, at + 1).end()


@dataclass
class Lexicon:
    """Terms (True: a prefix) and words known from clean documents.

    ``fuzzy``: what takes an edit besides whole terms, namely prefixes and whole words under a prefix.
    """

    terms: dict[str, bool]
    known: frozenset[str] = frozenset()
    fuzzy: frozenset[str] = frozenset()
    trie: dict = field(default_factory=dict, repr=False)
    gaps: set = field(default_factory=set, repr=False)
    longest: int = field(default=0, repr=False)
    whole: dict = field(default_factory=dict, repr=False)  # length of a word -> halves of the whole terms that are as long, or a letter more or less
    halves: tuple = field(default=(), repr=False)  # of the prefixes that take an edit: (length of the first, by first, length of the second, by second)

    def __post_init__(self) -> None:
        halves: dict[int, tuple[dict, dict]] = {}
        for term, prefix in [*((w, False) for w in self.fuzzy if w not in self.terms), *self.terms.items()]:
            if len(term) >= FUZZY_FROM:
                if not prefix:
                    self.gaps |= _with_gaps(term)
                    h = len(term) // 2
                    for n in range(len(term) - 1, len(term) + 2):
                        first, second = self.whole.setdefault(n, {}).setdefault((h, len(term) - h), (set(), set()))
                        first.add(term[:h])
                        second.add(term[h:])
                elif term in self.fuzzy:
                    h = len(term) // 2
                    first, second = halves.setdefault(len(term), ({}, {}))
                    first.setdefault(term[:h], []).append(term)
                    second.setdefault(term[h:], []).append(term)
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (term, prefix)
        # what takes an edit differs from a term in one letter at most, so of a longer word only its start counts
        self.longest = max(map(len, [*self.terms, *self.fuzzy]), default=0) + 2
        self.halves = tuple((n // 2, first, n - n // 2, second) for n, (first, second) in halves.items())

    def match(self, word: str) -> tuple[int, str] | None:
        """(kind, term) of the best match: 0 exact, 1 prefix, 2 misspelt; None if there is none."""
        node = self.trie
        best = None
        for k, c in enumerate(word):
            node = node.get(c)
            if node is None:
                break
            if "" in node:
                term, prefix = node[""]
                if k == len(word) - 1 and not prefix:
                    return best or (0, term)
                if prefix:
                    best = (1, term)
        if best is not None:
            return best
        if len(word) < FUZZY_FROM - 1 or word in self.known:
            return None
        word = word[: self.longest]
        return self._near(word) if self._may_be_near(word) else None

    def match_inner(self, word: str) -> tuple[int, str] | None:
        """The same for a word with a sign inside, which takes the one edit."""
        return self._near(word) if len(word) >= FUZZY_FROM and word not in self.known and self._may_be_near(word) else None

    def _may_be_near(self, word: str) -> bool:
        """What is one edit apart shares a string with one letter less; few words get to the automaton."""
        for (h, k), (first, second) in self.whole.get(len(word), {}).items():
            if (word[:h] in first or word[-k:] in second) and not self.gaps.isdisjoint(_with_gaps(word)):  # one half of a term is whole
                return True
        return self._starts_near(word)

    def _starts_near(self, word: str) -> bool:
        """Does the word start with a prefix that has one edit? One half of the prefix is then whole."""
        for h, first, k, second in self.halves:
            if word[:h] in first and any(_starts_within_edit(word, term) for term in first[word[:h]]):
                return True
            for at in (h - 1, h, h + 1):
                if word[at : at + k] in second and any(_starts_within_edit(word, term) for term in second[word[at : at + k]]):
                    return True
        return False

    def _near(self, word: str) -> tuple[int, str] | None:
        """Walk the trie with the automaton of ``word`` for one edit.

        ``zero`` and ``one`` have bit i set if i letters of the word can stand for the path so far
        with no edit and with at most one.
        """
        n = len(word)
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        end = 1 << n
        stack = [(self.trie, 1, 3, 0)]
        found: list[tuple[int, str]] = []
        while stack:
            node, zero, one, depth = stack.pop()
            for c, below in node.items():
                if c == "":
                    continue
                m = masks.get(c, 0)
                z = (zero & m) << 1
                # a match after an edit; a letter of the term too many; a letter changed; then a letter of the word skipped
                o = (one & m) << 1 | zero | zero << 1 | z | z << 1
                o &= (end << 1) - 1
                if not o:
                    continue
                if depth + 1 >= FUZZY_FROM and "" in below:
                    term, prefix = below[""]
                    if term in self.fuzzy if prefix else o & end:  # of a prefix, any start of the word will do
                        found.append((len(term), term))
                stack.append((below, z, o, depth + 1))
        return (2, max(found)[1]) if found else None


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task holds: for each word and prefix, the documents of either label that have it."""
    low, high = PREFIX
    held: dict[tuple[str, bool], list[int]] = {}

    def out() -> pa.RecordBatch:
        terms, prefixes = zip(*held, strict=True)
        bad, good = zip(*held.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(prefixes, pa.bool_()), pa.array(bad, pa.int64()), pa.array(good, pa.int64())], names=["term", "prefix", "bad", "good"])

    for b in batches:
        for toxic, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            words = set(WORD.findall(text.as_py().lower()))
            items = {(w, False) for w in words}
            items.update((w[:k], True) for w in words for k in range(low, min(high, len(w)) + 1))
            at = 0 if toxic else 1
            for i in items:
                held.setdefault(i, [0, 0])[at] += 1
        if len(held) > COUNTED:
            yield out()
            held.clear()
    if held:
        yield out()


def _near_words(lexicon: Lexicon):
    """Words that would be taken for misspelt terms, with their documents of either label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, held = Matcher(lexicon), {}
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py().lower()
                inner = {text[a : min(c, a + lexicon.longest)] for a, _, c in inner_signs(text, lexicon.longest)}
                near = [w for w in set(WORD.findall(text)) if (m := match.kept[w]) is not None and m[0] == 2]
                for w in {*near, *(w for w in inner if match.inner[w] is not None)}:
                    held.setdefault(w, [0, 0])[0 if toxic else 1] += 1
        if held:
            bad, good = zip(*held.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(bad, pa.int64()), pa.array(good, pa.int64())], names=["term", "bad", "good"])

    return run


def learn_lexicon(train: DataFrame) -> Lexicon:
    """``train(toxic, text)`` -> lexicon. Terms come from the rows learned from, which FIT_ROWS bounds; none is cut off."""
    low, high = PREFIX
    train = train.select("toxic", "text")
    counts = train.mapInArrow(_partial_counts, "term string, prefix boolean, bad long, good long").groupBy("term", "prefix").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # clean documents are more than toxic ones: rates, not counts, are held against each other
    totals = train.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    bad, good = totals["bad"] or 0, totals["good"] or 0
    if not bad:
        return Lexicon({})
    ratio = max(1.0, good / bad)
    pure = F.col("bad") / (F.col("bad") + (F.col("good") + 0.5) / F.lit(math.sqrt(ratio)))
    share, n = bad / max(1, bad + good), F.col("bad") + F.col("good")
    if share in (0.0, 1.0):
        return Lexicon({})
    evidence = F.col("bad") * F.log(F.col("bad") / n / share) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / n / (1 - share))).otherwise(0.0)
    top = counts.where((F.col("bad") > 1) & (F.col("bad") / n > share) & (evidence >= EVIDENCE) & (pure >= PURITY)).collect()
    whole = {r["term"]: r["bad"] for r in sorted(top) if not r["prefix"]}
    starts = {r["term"]: r["bad"] for r in sorted(top, key=lambda r: (-r["bad"], r["term"])) if r["prefix"]}
    longer: dict[str, list[str]] = {}
    for q in starts:
        longer.setdefault(q[:-1], []).append(q)
    terms: dict[str, bool] = {}
    for p, n in sorted(starts.items(), key=lambda x: (len(x[0]), x[0])):
        if any(p[:k] in terms for k in range(low, len(p))):
            continue  # a shorter prefix has it
        # go down to the longest prefix that still has nearly all of the documents
        while len(p) < high and (more := [q for q in longer.get(p, ()) if starts[q] >= 0.95 * n]):
            p = more[0]
        if whole.get(p, 0) >= 0.7 * n:
            continue  # a word, not the stem of many
        terms[p] = True
    for w in whole:
        if not any(terms.get(w[:k]) for k in range(low, len(w) + 1)):
            terms[w] = False
    under = (w for w in whole if any(terms.get(w[:k]) for k in range(low, len(w) + 1)))
    fuzzy = frozenset([*under, *(p for p, prefix in terms.items() if prefix)])
    lexicon = Lexicon(terms, fuzzy=fuzzy)
    # words within an edit of a term that clean documents have as often as toxic ones are words of their own
    near = train.mapInArrow(_near_words(lexicon), "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    seen = near.where(F.col("good") >= F.col("bad")).collect()
    return Lexicon(terms, frozenset(r["term"] for r in seen), fuzzy)


# -- features -------------------------------------------------------------------------------------


class _Kept(dict):
    """What a function gives for words, KEPT of them at most."""

    def __init__(self, of) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, word: str):
        if len(self) >= KEPT:
            self.clear()
        found = self[word] = self.of(word)
        return found


class Matcher:
    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.kept, self.inner = lexicon, _Kept(lexicon.match), _Kept(lexicon.match_inner)

    def __call__(self, word: str) -> tuple[int, str] | None:
        return self.kept[word]

    def features(self, text: str | None) -> list[float]:
        text = (text or "").lower()
        words, kept = WORD.findall(text), self.kept
        hits = {w: m for w in set(words) if (m := kept[w]) is not None}
        longest = self.lexicon.longest
        signs = [(a, c, m) for a, _, c in inner_signs(text, longest) if (m := self.inner[text[a : min(c, a + longest)]]) is not None]
        if not hits and not signs:
            return [0.0] * len(FEATURES)
        spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
        matches = {k: m for k, w in enumerate(words) if (m := hits.get(w)) is not None}
        begins = {a: k for k, (a, _) in enumerate(spans)} if signs else {}
        for a, c, m in signs:  # a word that is matched by itself does not count twice
            k = begins.get(a)
            if k is not None and k not in matches and k + 1 not in matches and k + 1 < len(spans) and spans[k + 1][1] == c:
                matches[k] = m
        if not matches:
            return [0.0] * len(FEATURES)
        kinds, quoted, addressed = [0, 0, 0], 0, 0
        for k, m in matches.items():
            around = words[max(0, k - WINDOW) : k + WINDOW + 1]
            left = text[spans[max(0, k - WINDOW)][0] : spans[k][0]]
            right = text[spans[k][1] : spans[min(len(words) - 1, k + WINDOW)][1] + 1]
            marks = any(c in OPEN for c in left) and any(c in CLOSE for c in right)
            if marks or (not ADDRESS.intersection(around) and REPORT.intersection(words[max(0, k - WINDOW) : k])):
                quoted += 1
            else:
                kinds[m[0]] += 1
                addressed += bool(ADDRESS.intersection(around))
        terms = len({m[1] for m in matches.values()})
        log = math.log1p
        return [log(kinds[0]), log(kinds[1]), log(kinds[2]), log(quoted), log(addressed), log(terms), log(100 * sum(kinds) / len(words))]


def _features(lexicon: Lexicon):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match = Matcher(lexicon)
        for texts in batches:
            yield pd.Series([match.features(t) for t in texts], index=texts.index, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")


# -- model ----------------------------------------------------------------------------------------


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # of the features, then the constant

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))

    def column(self, text: Column) -> Column:
        """Score of a text, from 0 to 1; null counts as empty."""
        lexicon, weights = self.lexicon, self.weights

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            match, model = Matcher(lexicon), Model(lexicon, weights)
            for texts in batches:
                x = np.array([match.features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
                yield pd.Series(model.score(x), index=texts.index)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "double")(F.coalesce(text.cast("string"), F.lit("")))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method with a ridge on all weights but the constant."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    pull = np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull) + 1e-9 * np.eye(len(w)), a.T @ (y - p) - pull * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit to the rows of ``docs`` that ``labels(id, label)`` marks, held-out fold left out.

    Null labels, null ids and ids without a document teach nothing; an id labelled twice counts for
    each different label once. With no toxic row at all every score is the smallest there is.
    """
    small_batches(docs.sparkSession)
    key, label = F.col(f"`{id_col}`"), F.col(f"`{label_col}`")
    marks = labels.where(label.isin(0, 1) & key.isNotNull() & (fold(key) != HELD_OUT)).select(key.alias("doc_id"), label.cast("int").alias("toxic")).distinct()
    n = marks.count()
    if n > FIT_ROWS:  # a little less than the bound, which chance then does not pass
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * 0.95 * FIT_ROWS / n))
    texts = docs.select(key.alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    train = stored(texts.join(marks, "doc_id").select("doc_id", "text", "toxic"), "labelled")
    lexicon = learn_lexicon(train)
    rows = train.select("toxic", _features(lexicon)("text").alias("x")).collect()  # bounded by the sample
    y = np.array([r["toxic"] for r in rows], float)
    if not len(y) or not y.any():
        return Model(lexicon, np.append(np.zeros(len(FEATURES)), -10.0))
    return Model(lexicon, fit_logistic(np.array([r["x"] for r in rows], float), y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row; a null id is in no fold (held_out false)."""
    small_batches(docs.sparkSession)
    key = F.col(f"`{id_col}`")
    scored = docs.select(key.alias("doc_id"), F.coalesce(fold(key) == HELD_OUT, F.lit(False)).alias("held_out"), model.column(F.col(f"`{text_col}`")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that score below one half, as they were."""
    small_batches(docs.sparkSession)
    (own,) = fresh("score")
    return docs.withColumn(own, model.column(F.col(f"`{text_col}`"))).where(F.col(own) < 0.5).drop(own)
