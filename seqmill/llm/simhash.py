"""SimHash near duplicates: fingerprints, and a binary-trie self-join for those that differ in few bits.

A fingerprint is 64 bits. Two that differ in at most ``BUDGET`` bits are linked; a component is what
links reach. The work goes over *distinct* fingerprints, so exact copies cost one row, however many.

Distribution. Of ``BUDGET + 1`` bands of bits, two linked fingerprints agree on one at least, so all
links show up among those that agree on the first bits of some band, moved to the top of the word.
Where there are so many fingerprints that one band's bits no longer keep groups small, there are one
or two bands more, of which two or three agree.
Each task packs what it holds of such a group into one row; the group's task then walks the binary
trie over its sorted words against itself: node pairs go down together, the bits in which their
prefixes differ are added up, and a pair beyond the budget is dropped. Out come the edges of a
spanning forest, never all pairs. A group of more than ``TILE`` words is dealt out by a hash to
tiles, and each pair of tiles is a group of its own: exact, and bounded in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from seqmill.llm.graph import components
from seqmill.session import fresh, small_batches, stored

SEED = 42
WORDS = 4
BUDGET = 4
BITS = 64
TILE = 1 << 16  # distinct fingerprints that one task joins with themselves or with as many others
AIM = 1 << 11  # distinct fingerprints that an even group should hold
HOT_SHARE, SALTS = 100, 64  # a fingerprint with a hundredth of all rows (there are a hundred at most) is joined in so many parts
LEAF = 1 << 14  # node pairs of at most so many word pairs are compared directly
FRONT = 1 << 15  # node pairs that go down together


# -- fingerprints ---------------------------------------------------------------------------------


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, repeats included (fewer words: of them all)."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \x20 \x09-\x0D alone
    if not tokens:
        return np.zeros(0, np.uint64)
    whole = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[: 1 - words].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(begins, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(begins))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes; no words: 0."""
    h = shingle_hashes(text, words)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: int(np.uint64(fingerprint(t)).astype(np.int64))).astype("int64")


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed long of the same bits; null text counts as empty."""
    return _fingerprints(F.coalesce(text.cast("string"), F.lit("")))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# -- the trie join on one machine -----------------------------------------------------------------


class Forest:
    """Union of numbered elements, many pairs at a time; the smallest element is the root."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n, dtype=np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root[:] = up


def trie_links(words: np.ndarray, budget: int = BUDGET, left: np.ndarray | None = None) -> np.ndarray:
    """Root of each of the sorted distinct ``words`` under links of at most ``budget`` differing bits.

    With ``left`` (a mask) only pairs of a word under the mask and one outside it count.
    """
    n = len(words)
    forest = Forest(n)
    one = np.uint64(1)
    # columns: the range of the first node, the range of the second, differing bits so far; top: bit to look at next
    stack = [(BITS, np.array([[0, n, 0, n, 0]], np.int64))] if n > 1 else []
    while stack:
        top, pairs = stack.pop()
        a0, a1, b0, b1, spent = pairs.T
        small = (a1 - a0) * (b1 - b0) <= LEAF
        if top == 0:
            small[:] = True
        leaf = pairs[small]
        if len(leaf):
            _compare(words, leaf, budget, forest, left)
        pairs = pairs[~small]
        if not len(pairs):
            continue
        a0, a1, b0, b1, spent = pairs.T
        bit = one << np.uint64(top - 1)

        def middle(lo: np.ndarray, bit: np.uint64 = bit, top: int = top) -> np.ndarray:
            prefix = words[np.minimum(lo, n - 1)] >> np.uint64(top) << np.uint64(top) if top < BITS else np.zeros(len(lo), np.uint64)
            return np.searchsorted(words, prefix | bit)

        am, bm = np.clip(middle(a0), a0, a1), np.clip(middle(b0), b0, b1)
        same = a0 == b0  # a node against itself: its halves, and one half against the other
        down = [
            np.stack([a0, am, b0, bm, spent], 1),
            np.stack([am, a1, bm, b1, spent], 1),
            np.stack([a0, am, bm, b1, spent + 1], 1),
            np.stack([am, a1, b0, bm, spent + 1], 1)[~same],
        ]
        down = np.concatenate(down)
        down = down[(down[:, 4] <= budget) & (down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3])]
        if len(down):  # both nodes in one component already: nothing new can come of them
            down = down[_apart(forest.root, down)]
        stack += [(top - 1, down[at : at + FRONT]) for at in range(0, len(down), FRONT)]
    return forest.root


def _apart(root: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Which node pairs hold more than one component."""
    low, high = _span(root, pairs[:, 0], pairs[:, 1])
    low_b, high_b = _span(root, pairs[:, 2], pairs[:, 3])
    return (low != high) | (low_b != high_b) | (low != low_b)


def _span(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest of values[lo:hi], for many non-empty ranges."""
    padded = np.append(values, values[-1])
    at = np.stack([lo, hi], 1).ravel()
    return np.minimum.reduceat(padded, at)[::2], np.maximum.reduceat(padded, at)[::2]


def _compare(words: np.ndarray, leaf: np.ndarray, budget: int, forest: Forest, left: np.ndarray | None) -> None:
    """Every word of the first node with every word of the second, block by block."""
    while len(leaf):
        found, n, at = [], 0, 0
        while at < len(leaf) and n < 1 << 18:
            a0, a1, b0, b1, _ = leaf[at].tolist()
            i, j = np.nonzero(np.bitwise_count(words[a0:a1, None] ^ words[None, b0:b1]) <= budget)
            found.append((i + a0, j + b0))
            n += len(i)
            at += 1
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = i != j if left is None else left[i] != left[j]
        forest.join(i[keep], j[keep])
        leaf = leaf[at:]
        if n >= 1 << 18 and len(leaf):
            leaf = leaf[_apart(forest.root, leaf)]


# -- the same in Spark ----------------------------------------------------------------------------


class Layouts:
    """Orders of the bands of a word's bits, each with other bands in front.

    Of ``parts`` bands at least ``parts - budget`` agree in two linked words, so the words agree in the
    front of one of the layouts that put so many bands there, whichever they are.
    """

    def __init__(self, parts: int, budget: int) -> None:
        edges = [round(k * BITS / parts) for k in range(parts + 1)]
        bands = [(BITS - hi, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]  # place of the lowest bit, bits
        self.moves: list[list[tuple[int, int, int]]] = []  # by layout: bits from where to where
        self.front = BITS
        for chosen in combinations(range(parts), parts - budget):
            order = [*chosen, *(k for k in range(parts) if k not in chosen)]
            at, moves = BITS, []
            for k in order:
                low, bits = bands[k]
                at -= bits
                moves.append((low, at, bits))
            self.moves.append(moves)
            self.front = min(self.front, sum(bands[k][1] for k in chosen))

    @staticmethod
    def _carry(words: np.ndarray, moves: list[tuple[int, int, int]]) -> np.ndarray:
        out = np.zeros(len(words), np.uint64)
        for low, at, bits in moves:
            out |= (words >> np.uint64(low) & np.uint64((1 << bits) - 1)) << np.uint64(at)
        return out

    def lay(self, words: np.ndarray, k: int) -> np.ndarray:
        return self._carry(words, self.moves[k])

    def back(self, words: np.ndarray, k: int) -> np.ndarray:
        return self._carry(words, [(at, low, bits) for low, at, bits in self.moves[k]])


def layouts(n: int, budget: int, aim: int = AIM) -> tuple[Layouts, int]:
    """For ``n`` words: layouts, and the bits of their fronts by which words are grouped.

    The more words, the more bands, so that groups keep their size; a layout more is a copy more of
    each word, and there are 5, 15 or 35 of them for a budget of four.
    """
    needed = max(6, (max(n, 1) // aim).bit_length())
    for parts in range(budget + 1, budget + 4):
        found = Layouts(parts, budget)
        if needed <= found.front:
            break
    return found, min(found.front, needed)


def _pack(shift: int, laid: Layouts):
    """Rows (band, prefix, n, words): what this task holds of each group, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _chunks(batches, 1 << 20):
            for k in range(len(laid.moves)):
                words = np.sort(laid.lay(some, k))
                prefix = words >> np.uint64(BITS - shift)
                values, at = np.unique(prefix, return_index=True)
                parts = np.split(words, at[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), k, np.int32)), pa.array(values.astype(np.int64)), pa.array([len(p) for p in parts], pa.int64()), pa.array([p.astype("<u8").tobytes() for p in parts], pa.binary())],
                    names=["band", "prefix", "n", "words"],
                )

    return run


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[np.ndarray]:
    held, n = [], 0
    for b in batches:
        held.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        n += len(held[-1])
        if n >= most:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hot group's words go to tiles by hash, and each tile to all its pairs."""
    for b in batches:
        out: list[tuple] = []
        for band, prefix, words, t in zip(*(b.column(c).to_pylist() for c in ("band", "prefix", "words", "tiles")), strict=True):
            if t == 1:
                out.append((band, prefix, 0, 0, 0, words))
                continue
            w = np.frombuffer(words, "<u8")
            tile = (w * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(t)
            for k in np.unique(tile).tolist():
                own = w[tile == k].tobytes()
                out += [(band, prefix, min(k, m), max(k, m), k, own) for m in range(t)]
        if out:
            cols = list(zip(*out, strict=True))
            types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["band", "prefix", "i", "j", "tile", "words"])


def _forest_of(laid: Layouts, budget: int):
    """Grouped: the words of one group -> edges of a spanning forest of its links."""

    def run(table: pa.Table) -> pa.Table:
        band, i, j = (table.column(c)[0].as_py() for c in ("band", "i", "j"))
        tile = table.column("tile").to_numpy()
        packed = [np.frombuffer(x.as_py(), "<u8") for x in table.column("words")]
        words = np.concatenate(packed)
        left = np.repeat(tile == i, [len(p) for p in packed]) if i != j else None
        words, first = np.unique(words, return_index=True)
        root = trie_links(words, budget, left[first] if left is not None else None)
        own = laid.back(words, band)
        moved = root != np.arange(len(root))
        a, b = own.view(np.int64)[moved], own.view(np.int64)[root[moved]]
        return pa.table({"u": pa.array(np.minimum(a, b), pa.int64()), "v": pa.array(np.maximum(a, b), pa.int64())})

    return run


def link_forest(prints: DataFrame, budget: int = BUDGET, tile: int = TILE, aim: int = AIM) -> DataFrame:
    """``prints(fp)``, distinct -> edges ``(u, v)`` that connect what links of the budget connect."""
    laid, shift = layouts(prints.count(), budget, aim)
    packed = prints.select("fp").mapInArrow(_pack(shift, laid), "band int, prefix long, n long, words binary")
    packed = stored(packed, "packed")
    sizes = packed.groupBy("band", "prefix").agg(F.sum("n").alias("m")).where(F.col("m") > tile)
    if sizes.isEmpty():
        groups = packed.select("band", "prefix", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("tile"), "words")
    else:
        hot = sizes.select("band", "prefix", F.ceil(F.col("m") / tile).cast("int").alias("tiles"))
        joined = packed.join(hot, ["band", "prefix"], "left").select("band", "prefix", "words", F.coalesce("tiles", F.lit(1)).alias("tiles"))
        groups = joined.mapInArrow(_tiles, "band int, prefix long, i int, j int, tile int, words binary")
    return groups.groupBy("band", "prefix", "i", "j").applyInArrow(_forest_of(laid, budget), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row: component_id is the smallest id that links reach.

    Null text counts as empty; texts without words have fingerprint 0 and link like any other. Rows
    that repeat an id each get a row. A null id gets a row, but is never a component's id unless the
    component has no other. No rows give no rows; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    rows = stored(docs.select(F.col(f"`{id_col}`").alias("doc_id"), fingerprint_column(F.col(f"`{text_col}`")).alias("fp")), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    roots = components(link_forest(prints, budget))
    placed = prints.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = placed.join(ids, "root").select("fp", "component_id")
    # fingerprints of many of all rows, such as those of mass copies, are joined in parts
    total = prints.agg(F.sum("n")).first()[0] or 0
    hot = [r["fp"] for r in prints.where(F.col("n") >= max(2.0, total / HOT_SHARE)).select("fp").collect()]
    part = F.when(F.col("fp").isin(hot), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int")
    parts = F.when(F.col("fp").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("part", part).join(labels.withColumn("part", F.explode(parts)), ["fp", "part"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its component's: one for each component, all columns as they were.

    Where rows repeat that id, the one whose columns sort first stays. A component of null ids keeps one.
    """
    found = near_duplicates(docs, id_col, text_col)
    row, key, keep, n = fresh("row", "id", "keep", "n")
    keepers = found.select(F.col("component_id").alias(keep)).distinct()
    ours = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(f"`{id_col}`").alias(key))
    kept = ours.join(keepers, F.col(key).eqNullSafe(F.col(keep)), "left_semi")
    first = kept.withColumn(n, F.row_number().over(W.partitionBy(key).orderBy(row)))
    return first.where(F.col(n) == 1).select(f"{row}.*")
