"""Runs of repeated words: block matching by an automaton over integers, then exact extension.

A document is the sequence of its words, each a number of its own. A run is a stretch of length
``max(LEAST, 2 * q)`` or more with smallest period ``q`` that cannot grow on either side.

Seeds. A run of period q holds, for some power of two b, a block of b words that starts at a multiple
of b and recurs q words on within the run: any q of ``[2b - 1, 4b - 2]`` will do (of ``[1, 14]`` but for
6 where b is 4, and 6 where it is 2). So each scale has its blocks, and distances that go with them.
Blocks whose words do not all recur within such a distance cannot match and are left out; the others
are keys of an Aho-Corasick automaton over integer sequences, which is run across the document. An
automaton node looks through its edges one by one, so that a word goes in as digits to the base of
``BASE``: a key costs no more in a document of many different words.

Extension. An occurrence at a distance that goes with its block seeds the comparison of the document
with itself q words on, to the left and to the right until it ends. Stretches of one distance never
overlap, so a seed inside one is passed over. Periods go upwards; a seed at a multiple of p within a
run of period p is that run again and is passed over too, and blocks deep within a run of a period
that is no longer than they are no keys at larger scales. Nothing else is left out: all runs are found.

Distribution: documents are independent. One text has to fit into a task, which takes some hundred
bytes a word for it.

Odd input: a null text has no words, hence no runs, and collapses to the empty string; rows repeated
are rows of their own; an empty table gives no rows. Columns besides id and text do not matter.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmill.session import small_batches

LEAST = 12  # words of a run; the scales below rely on it
BASE = 64  # digits of a word's number
WORD = re.compile(r"[^\x20\x09-\x0D]+")

Run = tuple[int, int, int]  # start, length, period


def scales(n: int) -> Iterator[list[tuple[int, int, int]]]:
    """(block, least distance, largest distance) by ascending distances; what overlaps comes together."""
    yield [(2, 6, 6), (4, 1, 14)]
    b = 8
    while 2 * (2 * b - 1) <= n:
        yield [(b, 2 * b - 1, 4 * b - 2)]
        b *= 2


def _recurs_after(ids: np.ndarray) -> np.ndarray:
    """Distance of each word to its next occurrence; beyond the document where there is none."""
    order = np.argsort(ids, kind="stable")
    gap = np.full(len(ids), 2 * len(ids) + LEAST, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][same]] = np.diff(order)[same]
    return gap


def _digits(ids: np.ndarray) -> list[int]:
    """Digits of all words; those of each place have symbols of their own."""
    most, places = int(ids.max()), 1
    while most >= BASE**places:
        places += 1
    return (ids[:, None] // BASE ** np.arange(places) % BASE + BASE * np.arange(places)).ravel().tolist()


def _same_from(ids: np.ndarray, i: int, q: int) -> int:
    """The first position from i on where the document differs from itself q words on."""
    end, step = len(ids) - q, 16
    while i < end:
        m = min(step, end - i)
        differs = ids[i : i + m] != ids[i + q : i + q + m]
        if differs.any():
            return i + int(differs.argmax())
        i, step = i + m, 2 * step
    return end


def _same_to(ids: np.ndarray, i: int, q: int) -> int:
    """The first position of the stretch that ends before i and is the same q words on."""
    step = 16
    while i > 0:
        m = min(step, i)
        differs = ids[i - m : i] != ids[i - m + q : i + q]
        if differs.any():
            return i - int(differs[::-1].argmax())
        i, step = i - m, 2 * step
    return 0


class _Found:
    """Runs by period, each period's by start."""

    def __init__(self) -> None:
        self.starts: dict[int, list[int]] = {}
        self.ends: dict[int, list[int]] = {}

    def add(self, start: int, end: int, q: int) -> None:
        self.starts.setdefault(q, []).append(start)
        self.ends.setdefault(q, []).append(end)

    def of_divisors(self, q: int) -> list[tuple[list[int], list[int]]]:
        return [(s, self.ends[p]) for p, s in self.starts.items() if p < q and q % p == 0]

    def within(self, b: int) -> Iterator[tuple[int, int]]:
        for p, starts in self.starts.items():
            if p <= b:
                yield from zip(starts, self.ends[p], strict=True)

    def rows(self) -> list[Run]:
        return sorted((s, e - s, q) for q, starts in self.starts.items() for s, e in zip(starts, self.ends[q], strict=True))


def _seeds(ids: np.ndarray, digits: list[int], gap: np.ndarray, found: _Found, b: int, low: int, high: int, seeds: dict[int, list[int]]) -> None:
    """Aligned blocks of b words and where they recur at a distance of [low, high]: starts by distance."""
    n = len(ids)
    blocks = gap[: n // b * b].reshape(-1, b).max(1) <= high
    if not blocks.any():
        return
    for start, end in found.within(b):  # deep within: what recurs there does so by multiples of the run's period
        if end - start >= high + b:
            blocks[-(-start // b) : max(0, (end - high - b) // b + 1)] = False
    at = np.flatnonzero(blocks) * b
    if not len(at):
        return
    places = len(digits) // n
    keys: dict[tuple[int, ...], list[int]] = {}
    for j in at.tolist():
        keys.setdefault(tuple(digits[j * places : (j + b) * places]), []).append(j)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, starts in keys.items():
        automaton.add_word(key, starts)
    automaton.make_automaton()
    first = int(at[0])
    for end, starts in automaton.iter(tuple(digits[first * places : (int(at[-1]) + high + b) * places])):
        i = first + (end + 1) // places - b
        k = bisect_left(starts, i - high)
        while k < len(starts) and starts[k] <= i - low:
            seeds.setdefault(i - starts[k], []).append(starts[k])
            k += 1


def find_runs(ids: np.ndarray) -> list[Run]:
    """All runs of a sequence of numbers from 0 on, by start, length and period."""
    if len(ids) < LEAST:
        return []
    found, gap, digits = _Found(), _recurs_after(ids), None
    for group in scales(len(ids)):
        seeds: dict[int, list[int]] = {}
        for b, low, high in group:
            if (gap <= high).any():
                digits = digits or _digits(ids)
                _seeds(ids, digits, gap, found, b, low, high, seeds)
        for q in sorted(seeds):
            over, divisors = 0, found.of_divisors(q)
            for j in sorted(seeds[q]):
                if j < over or any((k := bisect_right(starts, j)) and j + q < ends[k - 1] for starts, ends in divisors):
                    continue
                start, over = _same_to(ids, j, q), _same_from(ids, j, q)
                if over + q - start >= max(LEAST, 2 * q):
                    found.add(start, over + q, q)
    return found.rows()


def collapse(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    s, length, q = np.array(runs, np.int64).T
    np.add.at(depth, s + q, 1)
    np.add.at(depth, s + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def loop_tail(words: list[str], row_id: object) -> list[str]:
    """Every tenth document, by the checksum of its id, ends in a loop: known runs among real texts."""
    if row_id is None or not words:
        return words
    h, n = zlib.crc32(str(row_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


Alter = Callable[[list[str], object], list[str]]


def _mapper(alter: Alter | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, texts = [], []
            for row_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = WORD.findall(text.as_py() or "")
                words = alter(words, row_id) if alter else words
                ids = pd.factorize(np.array(words, object))[0] if len(words) >= LEAST else np.zeros(0, np.int64)
                own = find_runs(ids)
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                texts.append(" ".join(collapse(words, own)))
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, kind), pa.array(texts, pa.string())], names=[b.schema.names[0], "runs", "collapsed"])

    return run


def repetitions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alter: Alter | None = None) -> DataFrame:
    """``(id, runs array<struct<start, length, period>>, collapsed)``: all runs of each text, and its text without them.

    ``alter`` (words, id) -> words is applied to the words first.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(_mapper(alter), f"`{id_col}` {id_type}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the longest (ties: by start, then period), and digests of runs and collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    length, start, period = longest["length"], -longest["s"], -longest["q"]
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    columns: list[Column] = [
        F.col(f"`{id_col}`"),
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * longest.length div -longest.q").alias("exponent_milli"),
        sha(lines).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    ]
    return found.withColumn("longest", longest).select(*columns)
