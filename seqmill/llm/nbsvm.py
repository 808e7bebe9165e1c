"""Quality: a linear classifier over n-gram indicators scaled by class log-count ratios.

Features. A text is read as two sequences: its words in lower case, and their shapes, where runs of
small letters, of capitals and of digits are one sign each, all else stands for itself, and a word
that repeats the one before is marked. N-grams of both are hashed into ``BUCKETS`` buckets; what counts
is whether a text has a bucket at all.

Ratios. For each bucket grouped aggregation counts the training texts of either class that have it,
over all labelled rows; each task adds up its own first. The ratio of the smoothed and normalised
counts, as a logarithm, scales the bucket. There are ``BUCKETS`` ratios at most, however many texts.

Model. Rows of scaled indicators, each brought to length one, are fitted by a linear support vector
machine: dual coordinate descent on the hinge loss, a random order in each round, at most ``FIT_ROWS``
rows and ``FIT_FEATURES`` of their features, taken by a hash of the id where there are more. The weights
are mixed with their mean size, as is usual for such models. Margins become probabilities by a
logistic curve, fitted to margins of rows that the model at hand did not see (two halves).

Texts do not move where the labels are counted few enough to be sent to every task (``AT_HAND``);
beyond, labels and labelled texts meet by id.

Scoring is one pass over all whole texts with the ``BUCKETS`` weights at hand.

Odd input: a null text is empty; an empty text has no features and gets the score of the constant.
Null labels and ids, and ids without a document, teach nothing; an id with both labels teaches both.
With rows of one class only, or none, every score is the share of that class, smoothed. Rows repeated
are scored each. An empty table gives no rows. Columns besides those named do not matter.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmill.session import fresh, small_batches, stored

FOLDS, HELD_OUT = 4, 2
BUCKETS = 1 << 18
WORD_GRAMS, SHAPE_GRAMS = (1, 2), (1, 2, 3, 6)
SMOOTHING = 1.0  # added to each bucket's count of either class
MIXING = 0.5  # share of a weight's own value, the rest is the mean size of all
COST = 4.0  # of a margin of nought
ROUNDS, CLOSE = 60, 0.01  # of coordinate descent: the most, and the gap of projected gradients that ends it
FIT_ROWS, FIT_FEATURES = 10_000, 8_000_000  # bounds of the labelled sample that the weights are fitted to
AT_HAND, AT_HAND_BYTES = 1_000_000, 32 << 20  # labels, and bytes of their ids, up to which every task gets them all
THRESHOLD = 0.7
KEPT = 200_000  # words that a worker keeps

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- features -------------------------------------------------------------------------------------


def shape(word: str) -> str:
    """Small letters, capitals and digits, a sign for each run; the rest as it is, runs once."""
    out, last = [], ""
    for c in word:
        s = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if s != last:
            out.append(s)
            last = s
    return "".join(out)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes; multiplication wraps around."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """Numbers of words, given out as they come; hashes of each word and of its shape by number."""

    def __init__(self) -> None:
        super().__init__()
        self.words, self.shapes = array("Q"), array("Q")

    def __missing__(self, word: str) -> int:
        self.words.append(xxhash.xxh64_intdigest(word.lower(), 1))
        self.shapes.append(xxhash.xxh64_intdigest(shape(word), 2))
        self[word] = number = len(self)
        return number


class Features:
    """Buckets of a text's n-grams; words are hashed once."""

    def __init__(self) -> None:
        self.kept = _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        """Ascending, each once, as 32-bit integers."""
        words = WORD.findall(text or "")
        if not words:
            return np.zeros(0, np.int32)
        if len(self.kept) > KEPT:
            self.kept = _Words()
        kept = self.kept
        at = np.array([kept[w] for w in words])
        plain, shapes = np.frombuffer(kept.words, np.uint64)[at], np.frombuffer(kept.shapes, np.uint64)[at]
        shapes[1:] += plain[1:] == plain[:-1]
        found = []
        for salt, sequence, sizes in ((11, plain, WORD_GRAMS), (12, shapes, SHAPE_GRAMS)):
            gram, size = sequence, 1
            for n in sizes:
                if n > len(words):
                    break
                while size < n:
                    gram = _mixed(gram[:-1], sequence[size:])
                    size += 1
                found.append(_mixed(gram, np.uint64(salt * 64 + n)) % np.uint64(BUCKETS))
        return np.unique(np.concatenate(found)).astype(np.int32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for b in batches:
        rows = [features(t.as_py()) for t in b.column(2)]
        buckets = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), buckets], names=["id", "label", "buckets"])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task holds: for each bucket, its texts of either class."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for b in batches:
        lists, label = b.column(1), b.column(0).to_numpy(zero_copy_only=False)
        rows = np.repeat(label, np.diff(lists.offsets.to_numpy()))
        for k in (0, 1):
            counts[k] += np.bincount(lists.flatten().to_numpy()[rows == k], minlength=BUCKETS)
    at = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at.astype(np.int32), counts[0, at], counts[1, at])], names=["bucket", "bad", "good"])


# -- model ----------------------------------------------------------------------------------------


def log_count_ratios(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Of counts by bucket; buckets that no training text has get nought."""
    p, q = good + SMOOTHING, bad + SMOOTHING
    ratios = np.log(p / p.sum()) - np.log(q / q.sum())
    ratios[(good == 0) & (bad == 0)] = 0.0
    return ratios


def coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = COST, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Weights, then the constant, of the linear machine with hinge loss; ``y`` is -1 or 1.

    The dual has one variable for each row, between nought and the cost. Each step solves for one
    variable exactly and moves the weights with it; a round goes through all in a random order. It ends
    when the projected gradients of a round are within ``CLOSE`` of each other.
    """
    w, alpha = np.zeros(BUCKETS + 1), np.zeros(len(rows))
    curvature = np.array([v @ v + 1.0 for v in values])  # the constant is a feature of one
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        low, high = np.inf, -np.inf
        for i in rng.permutation(len(rows)):
            at, v = rows[i], values[i]
            gradient = y[i] * (w[at] @ v + w[-1]) - 1.0
            projected = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == cost else gradient
            low, high = min(low, projected), max(high, projected)
            if projected:
                new = min(max(alpha[i] - gradient / curvature[i], 0.0), cost)
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[at] += step * v
                w[-1] += step
        if high - low < CLOSE:
            break
    return w


def logistic_curve(margins: np.ndarray, good: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and constant of the probability of ``good`` by margin; targets are drawn in a little, the slope is positive."""
    n1, n0 = good.sum(), (1 - good).sum()
    target = np.where(good == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.stack([margins, np.ones(len(margins))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(2), a.T @ (target - p))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


@dataclass
class Model:
    """Weights of buckets whose ratio they hold, ratios, the constant, and the curve from margins to scores."""

    weights: np.ndarray
    ratios: np.ndarray
    constant: float
    slope: float
    offset: float

    def margin(self, buckets: np.ndarray) -> float:
        scaled = self.ratios[buckets]
        size = np.sqrt(scaled @ scaled)
        return float(self.weights[buckets] @ scaled / size + self.constant) if size else self.constant

    def score(self, buckets: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(buckets) + self.offset, -30, 30))))

    def column(self, text: Column) -> Column:
        model = self

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            features = Features()
            for texts in batches:
                yield pd.Series([model.score(features(t)) for t in texts], index=texts.index, dtype=float)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "double")(F.coalesce(text.cast("string"), F.lit("")))


def _scaled(rows: list[np.ndarray], ratios: np.ndarray) -> list[np.ndarray]:
    values = [ratios[r] for r in rows]
    return [v / size if (size := np.sqrt(v @ v)) else v for v in values]


def fit(rows: list[np.ndarray], good: np.ndarray, ratios: np.ndarray) -> Model:
    """The machine of all rows, and the curve by two halves that are scored by each other's machine."""
    if not len(good) or good.all() or not good.any():
        share = (good.sum() + 1) / (len(good) + 2)
        return Model(np.zeros(BUCKETS), ratios, 0.0, 1.0, float(np.log(share / (1 - share))))
    values, y = _scaled(rows, ratios), 2.0 * good - 1.0

    def machine(which: np.ndarray) -> tuple[np.ndarray, float]:
        w = coordinate_descent([rows[i] for i in which], [values[i] for i in which], y[which])
        held = w[:-1][w[:-1] != 0]
        mean = np.abs(held).mean() if len(held) else 0.0
        # the mean pulls along the ratio's own sign: scaled indicators carry that sign already
        return np.where(ratios != 0, (1 - MIXING) * mean + MIXING * w[:-1], 0.0), float(w[-1])

    halves = np.random.default_rng(1).permutation(len(rows)) % 2
    margins = np.zeros(len(rows))
    for k in (0, 1):
        own, other = np.flatnonzero(halves != k), np.flatnonzero(halves == k)
        w, constant = machine(own)
        margins[other] = [w[rows[i]] @ values[i] + constant for i in other]
    w, constant = machine(np.arange(len(rows)))
    return Model(w, ratios, constant, *logistic_curve(margins, good))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _at_hand(marks: DataFrame) -> DataFrame:
    """Labels that were counted to be few go to the texts; of more, labels and texts meet by a shuffle of both."""
    size = marks.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.col("id").cast("string"))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(marks) if size["rows"] <= AT_HAND and size["bytes"] <= AT_HAND_BYTES else marks.hint("merge")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Ratios over all labelled rows, weights over a bounded part of them; the held-out fold is left out of both."""
    small_batches(docs.sparkSession)
    key, label = F.col(f"`{id_col}`"), F.col(f"`{label_col}`")
    marks = labels.where(label.isin(0, 1) & key.isNotNull() & (fold(key) != HELD_OUT)).select(key.alias("id"), label.cast("int").alias("label")).distinct()
    texts = docs.select(key.alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    read = texts.join(_at_hand(marks), "id").select(F.col("id").cast("string").alias("id"), "label", "text")
    train = stored(read.mapInArrow(_featured, "id string, label int, buckets array<int>"), "labelled")
    counts = train.select("label", "buckets").mapInArrow(_partial_counts, "bucket int, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    held = counts.toPandas()  # a row for each bucket at most
    bad, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bad[held["bucket"]], good[held["bucket"]] = held["bad"], held["good"]
    size = train.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("buckets").cast("long")).alias("features")).first()
    share = min(FIT_ROWS / max(1, size["rows"]), FIT_FEATURES / max(1, size["features"] or 0))
    if share < 1:  # a little less than the bound, which chance then does not pass
        train = train.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * 0.95 * share))
    rows = train.toArrow().sort_by("id").combine_chunks()
    buckets = [b for chunk in rows.column("buckets").chunks for b in np.split(chunk.flatten().to_numpy(), np.cumsum(np.diff(chunk.offsets.to_numpy()))[:-1])]
    return fit(buckets, rows.column("label").to_numpy().astype(float), log_count_ratios(bad, good))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row; a null id is in no fold (held_out false)."""
    small_batches(docs.sparkSession)
    key = F.col(f"`{id_col}`")
    scored = docs.select(key.alias("doc_id"), F.coalesce(fold(key) == HELD_OUT, F.lit(False)).alias("held_out"), model.column(F.col(f"`{text_col}`")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that score ``THRESHOLD`` or more, as they were."""
    small_batches(docs.sparkSession)
    (own,) = fresh("score")
    return docs.withColumn(own, model.column(F.col(f"`{text_col}`"))).where(F.col(own) >= THRESHOLD).drop(own)
