"""Best-fit packing of documents into fixed windows, by bin completion over a length histogram.

Tokenise, cut only what is longer than a window, and pack the pieces into as few windows as can be
found. All that packing needs of a piece is its length, so the search runs over the histogram of
lengths: at most ``window`` numbers, however many documents there are. It yields patterns (a multiset
of lengths and how often it is used); pieces then find their place from their rank among those of
equal length, which is a local rank in the task plus an offset by task. No task sees all pieces.

The search is bin completion: take the largest length left and fill up its window. A filling counts
only if no piece left out fits into the rest (it is maximal) and no piece left out could stand for
some of its pieces and leave no more room (it is not dominated). A filling is laid as often as can be, half as often, and so on down
to once, and once suffices to reach every packing. The waste of a whole
packing is fixed by its number of windows, so a branch whose waste exceeds what the best packing so
far less one window allows is cut. Best-fit decreasing gives the first packing, and each completed
branch a better one; at the lower bound the search ends. It goes over the tree in passes of two
options a level, four, eight and so on, until a pass leaves none out: then nothing is better. The
only limit is ``STEPS``; what is best when they are used up is returned.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.llm.bpe import codec
from seqmill.session import small_batches, stored

WINDOW = 1024
END = 2
STEPS = 2_000_000  # windows tried and fillings looked at before the search returns the best packing so far
FIRST = 20_000  # steps of the first pass of the search; each further pass has four times as many
TOGETHER = 4  # fillings that come at a time, of which those with few pieces go first; all come in the end

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, copies), ...), times


# -- the search -----------------------------------------------------------------------------------


def lower_bound(counts: Sequence[int] | np.ndarray, window: int) -> int:
    """Windows that pieces need at least; ``counts[n]`` pieces have length n.

    The larger of all tokens over the window and, for any k up to half a window: pieces over window-k
    go alone, those over half a window go one in each, and of those from k to half a window only so
    much fits beside them.
    """
    c = np.asarray(counts, np.int64)
    n = np.arange(window + 1)
    half = window // 2
    pieces, tokens = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * n)])
    k = np.arange(half + 1)
    large = pieces[-1] - pieces[half + 1]
    high = np.maximum(window - k, half) + 1  # lengths from half+1 to high-1 leave room for some of length k
    room = window * (pieces[high] - pieces[half + 1]) - (tokens[high] - tokens[half + 1])
    small = tokens[half + 1] - tokens[k]
    return int(max(-(-int(tokens[-1]) // window), large + max(0, int(np.max(-(-(small - room) // window))))))


class _Pieces:
    """The pieces left: how many of each length, which lengths, and a sum that tells states apart."""

    def __init__(self, histogram: dict[int, int], window: int) -> None:
        self.counts = [0] * (window + 1)
        for n, c in histogram.items():
            self.counts[n] = c
        self.array = np.array(self.counts, np.int64)
        self.lengths = [n for n, c in enumerate(self.counts) if c]
        draw = random.Random(window)
        self.marks = [draw.getrandbits(160) for _ in self.counts]
        self.state = sum(m * c for m, c in zip(self.marks, self.counts, strict=True))

    def take(self, items: Iterable[tuple[int, int]], times: int) -> None:
        """Remove so many of each length; a negative number puts them back."""
        for n, k in items:
            before, after = self.counts[n], self.counts[n] - k * times
            self.counts[n] = self.array[n] = after
            self.state -= self.marks[n] * k * times
            if not after:
                del self.lengths[bisect_left(self.lengths, n)]
            elif not before:
                insort(self.lengths, n)


class _Spent(Exception):
    """The search has used up its steps."""


class _Search:
    def __init__(self, histogram: dict[int, int], window: int, steps: int | None) -> None:
        self.histogram, self.window, self.steps, self.looked = histogram, window, steps, 0
        self.pieces = _Pieces(histogram, window)

    def step(self) -> None:
        self.looked += 1
        if self.steps is not None and self.looked > self.steps:
            raise _Spent

    def reach(self, room: int) -> list[int]:
        """For each length left: the sums up to ``room`` that it and those below it can have, as bits."""
        out, sums, all_bits = [], 1, (1 << room + 1) - 1
        for n in self.pieces.lengths:
            if n > room:
                break
            copies, some = min(self.pieces.counts[n], room // n), 1
            while copies:
                some = min(some, copies)
                sums |= sums << some * n & all_bits
                copies, some = copies - some, 2 * some
            out.append(sums)
        return out

    def fillings(self, room: int) -> Iterator[tuple[int, dict[int, int]]]:
        """All undominated fillings of the room with the room they leave, in order of that; then those with large pieces first."""
        counts, lengths = self.pieces.counts, self.pieces.lengths
        reach = self.reach(room)

        def go(filling: dict[int, int], goal: int, left: int, at: int) -> Iterator[tuple[int, dict[int, int]]]:
            # the filling grows by lengths in descending order, each as often as is tried, while the goal is within reach
            self.step()
            if not goal:
                if not self.dominated(filling, left):
                    yield left, filling
                return
            if counts[goal + left] > filling.get(goal + left, 0):  # what fills up the rest dominates all else that goes there
                if not left and at >= 0 and goal <= lengths[at]:
                    filling = {**filling, goal: 1}
                    if not self.dominated(filling, 0):
                        yield 0, filling
                return
            for k in range(min(at, bisect_right(lengths, goal) - 1), -1, -1):
                n = lengths[k]
                if not reach[k] >> goal & 1:
                    return
                below = reach[k - 1] if k else 1
                for copies in range(min(counts[n], goal // n), 0, -1):
                    if below >> goal - n * copies & 1:
                        yield from go({**filling, n: copies}, goal - n * copies, left, k - 1)

        for left in range(room + 1):
            if (reach[-1] if reach else 1) >> room - left & 1:
                yield from go({}, room - left, left, len(reach) - 1)

    def dominated(self, filling: dict[int, int], left: int) -> bool:
        """Does a piece left out fit into the rest, or could one stand for one or two of the filling?

        The pieces that it stands for then take its place elsewhere, so no packing is lost. Fillings
        that gain by it fill more, or as much with fewer pieces, so the chain of better ones ends.
        """
        counts, lengths = self.pieces.counts, self.pieces.lengths
        for n in lengths:
            if n > left:
                break
            if counts[n] > filling.get(n, 0):
                return True
        own = sorted(filling)
        singles = set(own)
        pairs = {a + b for k, a in enumerate(own) for b in own[k:] if a != b or filling[a] > 1}
        for s in singles | pairs:
            if s in pairs and s <= self.window and counts[s] > filling.get(s, 0):
                return True
            if left:
                k = bisect_right(lengths, s + left) - 1
                if k >= 0 and lengths[k] > s and counts[lengths[k]] > filling.get(lengths[k], 0):
                    return True
        return False

    def options(self, fit_first: bool, few: int = 1) -> Iterator[tuple[tuple[tuple[int, int], ...], int]]:
        """Windows around the largest piece left and how often to lay them: as often as can be, half as often, ..., once.

        Fillings come from the enumeration a few at a time, and of these the one that leaves least first;
        as all come in the end, and each is tried once, the search misses nothing. Of those that leave as
        much, those of few pieces come first, or with ``few`` -1 those of many.
        """
        top = self.pieces.lengths[-1]

        def around() -> Iterator[dict[int, int]]:
            own = ((top, 1),)
            self.pieces.take(own, 1)
            found = self.fillings(self.window - top)
            while True:
                some = list(islice(found, TOGETHER))
                self.pieces.take(own, -1)
                yield from (f for _, f in sorted(some, key=lambda x: (x[0], few * sum(x[1].values()), sorted(x[1].items(), reverse=True))))
                if not some:
                    return
                self.pieces.take(own, 1)

        fits = self.fit()
        for filling in chain((fits,), (f for f in around() if f != fits)) if fit_first else around():
            whole = dict(filling)
            whole[top] = whole.get(top, 0) + 1
            items = tuple(sorted(whole.items(), reverse=True))
            times = min(self.pieces.counts[n] // k for n, k in items)
            while times:
                yield items, times
                times //= 2

    def fit(self) -> dict[int, int]:
        """What best fit puts beside the largest piece: again and again the largest that fits."""
        counts, lengths = self.pieces.counts, self.pieces.lengths
        out: dict[int, int] = {}
        top = lengths[-1]
        left, at = self.window - top, len(lengths) - 1
        while at >= 0 and left:
            n = lengths[at]
            if k := min(counts[n] - (n == top), left // n):
                out[n] = k
                left -= k * n
            at = min(at - 1, bisect_right(lengths, left) - 1)
        return out

    def best_fit(self) -> list[Pattern]:
        """Best-fit decreasing, which takes all pieces."""
        out: list[Pattern] = []
        while self.pieces.lengths:
            whole, top = self.fit(), self.pieces.lengths[-1]
            whole[top] = whole.get(top, 0) + 1
            items = tuple(sorted(whole.items(), reverse=True))
            out.append((items, min(self.pieces.counts[n] // k for n, k in items)))
            self.pieces.take(*out[-1])
        return out

    def dive(self, few: int) -> list[Pattern] | None:
        """A packing that always takes the first option, which leaves least; None if the steps do not suffice."""
        out: list[Pattern] = []
        try:
            while self.pieces.lengths:
                out.append(next(self.options(False, few)))
                self.pieces.take(*out[-1])
        except _Spent:
            return None
        return out

    def run(self) -> tuple[list[Pattern], int]:
        """Iterative broadening: depth first with two options a level, then four, and so on, until none is left out.

        Each breadth has two passes: with what best fit would lay tried first, and with what leaves least first.
        """
        bound, steps = lower_bound(self.pieces.array, self.window), self.steps
        size = lambda patterns: sum(t for _, t in patterns)
        best = self.best_fit()
        for few in (1, -1):  # two more packings to begin with, for a quarter of the steps each at most
            if size(best) > bound:
                self.steps = None if steps is None else self.looked + steps // 4
                self.pieces = _Pieces(self.histogram, self.window)
                best = min(best, self.dive(few) or best, key=size)
        breadth, limit = 2, FIRST
        while size(best) > bound and (steps is None or self.looked < steps):
            for fit_first in (True, False):
                self.steps = self.looked + limit if steps is None else min(steps, self.looked + limit)
                self.pieces = _Pieces(self.histogram, self.window)
                best, whole = self.broad(best, bound, breadth, fit_first)
                if whole:
                    return best, size(best)
            breadth, limit = 2 * breadth, 4 * limit
        return best, bound

    def broad(self, best: list[Pattern], bound: int, breadth: int, fit_first: bool) -> tuple[list[Pattern], bool]:
        """Branch and bound with so many options a level: the best found, and whether nothing was left out."""
        pieces, window, cut = self.pieces, self.window, False
        fewest = sum(t for _, t in best)
        seen: dict[int, int] = {}  # a state and the windows laid when it was met
        packed: list[Pattern] = []  # laid so far: a pattern for each open level but the last
        laid, left = 0, sum(n * pieces.counts[n] for n in pieces.lengths)
        levels: list[tuple[Iterator, Iterator]] = []

        def down() -> None:
            options = self.options(fit_first)
            levels.append((islice(options, breadth), options))

        def back() -> None:
            nonlocal laid, left
            items, times = packed.pop()
            pieces.take(items, -times)
            laid, left = laid - times, left + times * sum(n * k for n, k in items)

        try:
            down()
            while levels and fewest > bound:
                option = next(levels[-1][0], None)
                if option is None:
                    cut = cut or next(levels[-1][1], None) is not None
                    levels.pop()
                    if packed:
                        back()
                    continue
                self.step()
                items, times = option
                size = sum(n * k for n, k in items)
                if laid + times + -(-(left - times * size) // window) >= fewest:
                    continue  # too much is wasted to do better than the best so far
                pieces.take(items, times)
                packed.append(option)
                laid, left = laid + times, left - times * size
                if not pieces.lengths:
                    best, fewest = list(packed), laid
                elif laid < seen.get(pieces.state, laid + 1) and laid + lower_bound(pieces.array, window) < fewest:
                    seen[pieces.state] = laid
                    down()
                    continue
                back()
        except _Spent:
            cut = True
        return best, not cut or fewest == bound


def solve(histogram: dict[int, int], window: int = WINDOW, steps: int | None = STEPS) -> tuple[list[Pattern], int]:
    """Patterns that hold each length as often as it occurs, and a lower bound on the windows.

    ``steps`` bounds the work (windows tried and fillings looked at); what is best by then is returned.
    With None, or if the search ends before, the packing is the best there is and the bound is its size.
    """
    counts = {int(n): int(c) for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= window for n in counts):
        raise ValueError("lengths must lie between 1 and the window")
    return _Search(counts, window, steps).run()


class Places:
    """From a length and a rank among the pieces of that length to a window and an offset in it."""

    def __init__(self, patterns: list[Pattern], window: int = WINDOW) -> None:
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        base = 0
        for items, times in patterns:
            offset = 0
            for n, copies in items:
                # ranks from used[n] on, ``copies`` for each of the windows base, base+1, ...
                runs.setdefault(n, []).append((used.get(n, 0), base, offset, copies))
                used[n] = used.get(n, 0) + copies * times
                offset += n * copies
            base += times
        self.runs = {n: np.array(r, np.int64) for n, r in runs.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            runs = self.runs[n]
            first, base, begin, copies = runs[np.searchsorted(runs[:, 0], ranks[at], "right") - 1].T
            k = ranks[at] - first
            seq[at], offset[at] = base + k // copies, begin + k % copies * n
        return seq, offset


# -- in Spark -------------------------------------------------------------------------------------

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def _cut(path: str, window: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(path, library=True)
        stop = np.array([end], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens.encode_bytes(text.as_py()) + stop
                n = len(ids) // 4
                at, first = 0, n % window or window
                for piece in range(-(-n // window)):
                    size = window if piece else first
                    rows.append((doc_id, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), part, int(seen[size])))
                    seen[size] += 1
                    at += size
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                names = [x.split()[0] for x in _PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _place(places: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, offset = places.find(b.column("length").to_numpy(), b.column("rank").to_numpy())
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(seq), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, steps: int | None = STEPS) -> DataFrame:
    """A row for each piece: where it lies in its document and in which window at what offset.

    Null and empty texts are one end token. Rows that repeat an id are packed each. The first piece of
    a document takes what the others, all full, leave over. No rows give no rows. ``steps`` bounds the
    search for the fewest windows, as in solve(); None searches until the packing is the best there is.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    pieces = stored(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_cut(tokenizer, window, end), _PIECES), "pieces")
    counted = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``window`` rows at most
    patterns, _ = solve(histogram, window, steps)
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counted.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before")
    return ranked.mapInArrow(_place(Places(patterns, window)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

