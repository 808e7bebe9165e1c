"""Approximate nearest neighbours by shifted space-filling curves.

Each ordering turns the vectors by a random rotation, keeps a few coordinates (orderings that share a
rotation keep different ones), maps them to quantiles (of a bounded sample), shifts the grid and
numbers its cells along a Hilbert curve. Spark sorts the keys of all orderings by range; a row's rank
in its ordering is its place in its partition plus the rows of the partitions before. Ranks are cut
into blocks of a bounded size, whatever the keys: many equal vectors, or many in one cell, make no
large block. A query looks at the members whose ranks are within a reach of its own, in each block
that they lie in; the lists of all blocks and orderings are merged and scored again from the original
vectors. Where many queries come by, they are dealt to several tasks, so both sides are bounded.

Orderings and reach are chosen together by measurement: a bounded number of the queries are answered
exactly, in one pass over all vectors, and their true neighbours' distances in rank give, for each
number of orderings, the smallest reach that finds the share ``RECALL`` of them. Of all numbers the one
is taken whose windows, and rows moved for them, cost least.

For inner products the vectors get one more coordinate that makes all norms equal (that of a query
is zero), so that near on the curve means a large product. Equal vectors are searched as one class:
of its ids the ``top + 1`` smallest suffice, as ties go to the smaller id, so nothing is lost.

Neighbours in high dimensions without structure are near in few projections only; there the reach
comes out as a share of all rows, and the cost grows with rows times queries, a little below that of
comparing all. Where vectors have structure the reach is a few ranks, and the cost grows with the
rows. A pair that lies in several windows is multiplied again in each: to look up whether it was costs
more than the product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.session import small_batches, stored

TOP = 20
ORDERINGS = 16  # at most
RECALL = 0.92  # share of true neighbours that the reach is chosen for
TRIED = 256  # queries that the reach is measured with
BLOCK = 1 << 15  # rows of a block at most
LEAST_BLOCK = 1 << 10  # and at least, unless the table is smaller
MOVED = 16.0  # inner products that a row costs that is moved to one more ordering
ASKED = 1 << 14  # queries that a task compares with a block, about
DIMS, DEPTH = 6, 10  # coordinates kept and bits of each
MERGED = 256  # queries whose lists a task merges at once, about
SAMPLE = 20_000  # vectors that the quantiles are taken from
SEED = 7


def hilbert_keys(cells: np.ndarray, depth: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of non-negative cell numbers below 2**depth.

    From the top bit down, each level's orthant is read off, and what lies below is mirrored and
    swapped so that the curve leaves one orthant where it enters the next. The Gray code of the
    orthants gives their order.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(depth - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(depth - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(depth - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> level & 1
    return key


@dataclass
class Curves:
    """What turns vectors into keys: for each ordering a projection, quantiles by coordinate, and a shift."""

    norm: float
    kind: str  # the vectors' bytes: <f4 or <f8
    projections: list[np.ndarray]
    quantiles: list[np.ndarray]
    shifts: list[np.ndarray]

    def lift(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """One more coordinate: all members get the norm 1; queries are scaled to it and get zero."""
        v = vectors.astype(np.float64)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        if query:
            return np.hstack([v / np.maximum(size, 1e-300), np.zeros_like(size)])
        v, size = v / self.norm, size / self.norm
        return np.hstack([v, np.sqrt(np.maximum(0, 1 - size**2))])

    def keys(self, lifted: np.ndarray, ordering: int) -> np.ndarray:
        y = lifted @ self.projections[ordering]
        cells = np.empty(y.shape, np.int64)
        most = 1 << DEPTH
        for k, q in enumerate(self.quantiles[ordering].T):
            place = np.searchsorted(q, y[:, k]) / len(q)
            cells[:, k] = np.minimum(most - 1, (place + self.shifts[ordering][k]) / 1.5 * most)
        return hilbert_keys(cells, DEPTH)


def fit(sample: np.ndarray, norm: float, kind: str, orderings: int = ORDERINGS, seed: int = SEED) -> Curves:
    rng = np.random.default_rng(seed)
    n = sample.shape[1] + 1
    curves = Curves(norm, kind, [], [], [])
    lifted = curves.lift(sample, False)
    dims = min(DIMS, n)
    for k in range(orderings):
        at = k % (n // dims) * dims  # the next coordinates of the rotation, or of a new one
        rotation = np.linalg.qr(rng.normal(size=(n, n)))[0] if at == 0 else rotation
        turn = rotation[:, at : at + dims]
        curves.projections.append(turn)
        curves.quantiles.append(np.quantile(lifted @ turn, np.linspace(0, 1, 1 << DEPTH), axis=0))
        curves.shifts.append(rng.random(turn.shape[1]) / 2)
    return curves


# -- classes of equal vectors ---------------------------------------------------------------------


def _vectors(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data = b"".join(column.to_pylist())
    n = len(column)
    return np.frombuffer(data, kind).reshape(n, -1) if n else np.zeros((0, 1), kind)


def _partial(kind: str, every: int, most: int):
    """What a task holds of each vector: its smallest ids, and whether a query is among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def out() -> pa.RecordBatch:
            vecs = list(held)
            ids = [sorted(held[v][0])[:most] for v in vecs]
            return pa.RecordBatch.from_arrays([pa.array(vecs, pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array([held[v][1] for v in vecs], pa.bool_())], names=["vec", "ids", "asks"])

        for b in batches:
            flat = (np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), kind).reshape(b.num_rows, -1) + 0.0).astype(kind)  # -0.0 is 0.0
            for i, v in zip(b.column(0).to_pylist(), flat, strict=True):
                own = held.setdefault(v.tobytes(), [set(), False])
                own[0].add(i)
                own[1] |= i % every == 0
                if len(own[0]) > 8 * most:
                    own[0] = set(sorted(own[0])[:most])
            if len(held) > 50_000:
                yield out()
                held.clear()
        if held:
            yield out()

    return run


def _keyed(curves: Curves):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = _vectors(b.column("vec"), curves.kind)
            cid = b.column("cid").to_numpy()
            asks = b.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            member, query = curves.lift(vectors, False), curves.lift(vectors[asks], True)
            for k in range(len(curves.projections)):
                keys = np.concatenate([curves.keys(member, k), curves.keys(query, k)])
                ids = np.concatenate([cid, cid[asks]])
                role = np.repeat([False, True], [len(member), len(query)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), k, np.int32)), pa.array(keys), pa.array(ids), pa.array(role)], names=["ordering", "key", "cid", "query"])

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, and the row's place among those of its ordering there."""
    part, seen = TaskContext.get().partitionId(), {}
    for b in batches:
        ordering = b.column("ordering").to_numpy()
        place = np.empty(len(ordering), np.int64)
        for k in np.unique(ordering).tolist():
            at = np.flatnonzero(ordering == k)
            place[at] = seen.get(k, 0) + np.arange(len(at))
            seen[k] = seen.get(k, 0) + len(at)
        yield pa.RecordBatch.from_arrays([b.column("ordering"), b.column("cid"), b.column("query"), pa.array(np.full(len(ordering), part, np.int32)), pa.array(place)], names=["ordering", "cid", "query", "part", "place"])


# -- search ---------------------------------------------------------------------------------------


def _exact(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products row by row, in double precision, always summed in the same order."""
    return np.add.reduce(q.astype(np.float64) * m.astype(np.float64), axis=1)


def _best(score: np.ndarray, least: np.ndarray, top: int) -> np.ndarray:
    return np.lexsort((least, -score))[:top]


def _search(kind: str, top: int, reach: int, compared: Accumulator | None):
    """Grouped: a block's members and the queries that come by -> a short list for each query.

    Both go by rank, so what a few queries look at is one stretch of the members.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        query = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        vectors, rank = _vectors(table.column("vec"), kind), table.column("rank").to_numpy()
        cid, least = table.column("cid").to_numpy(), table.column("least").to_numpy()
        members, asked = vectors[~query], vectors[query]
        mr, qr, mc, ml, qc = rank[~query], rank[query], cid[~query], least[~query], cid[query]
        out: dict[str, list] = {"cid": [], "found": [], "scores": [], "least": []}
        upto = 0
        while (at := upto) < len(asked):  # queries at much the same place go together
            upto = min(at + 64, int(np.searchsorted(qr, qr[at] + reach // 8, "right")))
            some = asked[at:upto]
            begin = int(np.searchsorted(mr, qr[at] - reach))
            end = int(np.searchsorted(mr, qr[at + len(some) - 1] + reach, "right"))
            k = min(end - begin, 2 * top)
            if not k:
                continue
            if compared is not None:
                compared.add(len(some) * (end - begin))
            rough = some @ members[begin:end].T
            near = np.argpartition(-rough, k - 1, axis=1)[:, :k] if k < end - begin else np.tile(np.arange(k), (len(some), 1))
            for c, q, own in zip(qc[at:upto].tolist(), some, near + begin, strict=True):
                score = _exact(q[None, :], members[own])
                keep = _best(score, ml[own], top)
                out["cid"].append(c)
                out["found"].append(mc[own][keep])
                out["scores"].append(score[keep])
                out["least"].append(ml[own][keep])
        longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
        return pa.table({"cid": pa.array(out["cid"], pa.int64()), "found": pa.array(out["found"], longs), "scores": pa.array(out["scores"], doubles), "least": pa.array(out["least"], longs)})

    return run


def _merge(top: int):
    """Grouped: the lists of some queries -> the best of each."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cid").combine_chunks()
        asker = table.column("cid").to_numpy()
        lists = [table.column(c).chunk(0) for c in ("found", "scores", "least")]
        at = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
        found, scores, least = (x.flatten().to_numpy() for x in lists)
        begins = np.flatnonzero(np.append(True, asker[1:] != asker[:-1]))
        askers, cids, best = [], [], []
        for a, b in zip(begins, np.append(begins[1:], len(asker)), strict=True):
            own = slice(at[a], at[b])
            ids, first = np.unique(found[own], return_index=True)
            keep = _best(scores[own][first], least[own][first], top)
            askers.append(np.full(len(keep), asker[a]))
            cids.append(ids[keep])
            best.append(scores[own][first][keep])
        return pa.table({"asker": pa.array(np.concatenate(askers)), "cid": pa.array(np.concatenate(cids)), "score": pa.array(np.concatenate(best))})

    return run


def _exactly(kind: str, cids: np.ndarray, asked: np.ndarray, top: int):
    """The nearest of a task's vectors for each query that was asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, found = np.full((len(cids), 0), 0.0), np.full((len(cids), 0), 0, np.int64)
        for b in batches:
            members = _vectors(b.column(1), kind).astype(np.float64)
            own = asked @ members.T
            own[cids[:, None] == b.column(0).to_numpy()[None, :]] = -np.inf
            score = np.hstack([score, own])
            found = np.hstack([found, np.broadcast_to(b.column(0).to_numpy(), own.shape)])
            if score.shape[1] > top:
                near = np.argpartition(-score, top - 1, axis=1)[:, :top]
                score, found = np.take_along_axis(score, near, 1), np.take_along_axis(found, near, 1)
        k = score.shape[1]
        if k:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cids, k)), pa.array(found.ravel()), pa.array(score.ravel())], names=["asker", "cid", "score"])

    return run


def _plan(classes: DataFrame, ranked: DataFrame, kind: str, top: int, recall: float, rows: int, queries: int, orderings: int) -> tuple[int, int]:
    """(orderings, reach): ranks to either side within which the share ``recall`` of the true neighbours is found in some of the orderings.

    Measured with at most TRIED of the classes that ask, taken by a hash; their neighbours are found by
    comparing them with every vector.
    """
    asks = classes.where("asks").select("cid", "vec")
    some = asks.orderBy(F.xxhash64("vec"), "cid").limit(TRIED).toArrow()
    if not some.num_rows:
        return 1, 0
    cids, asked = some.column("cid").to_numpy(), _vectors(some.column("vec"), kind).astype(np.float64)
    near = classes.select("cid", "vec").mapInArrow(_exactly(kind, cids, asked, top), "asker long, cid long, score double").where("score > double('-inf')")
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("cid"))))  # at most ``top`` from each task
    best = near.groupBy("asker").agg(F.slice(order, 1, top).alias("best")).select("asker", F.explode("best.cid").alias("cid"))
    places = ranked.where("not query").select("ordering", "cid", "rank").join(F.broadcast(best), "cid")  # TRIED x top rows
    of_askers = ranked.where(F.col("query") & F.col("cid").isin(cids.tolist())).select("ordering", F.col("cid").alias("asker"), F.col("rank").alias("from"))
    gaps = places.join(of_askers, ["ordering", "asker"]).select("asker", "cid", "ordering", F.abs(F.col("rank") - F.col("from")).alias("gap")).toPandas()  # TRIED x top x orderings
    if gaps.empty:
        return 1, 0
    by_ordering = gaps.pivot(index=["asker", "cid"], columns="ordering", values="gap").reindex(columns=range(orderings)).to_numpy()
    least = np.sort(np.minimum.accumulate(by_ordering, axis=1), axis=0)
    reach = least[min(len(least) - 1, int(np.ceil(recall * len(least))))].astype(int)
    n = np.arange(1, orderings + 1)
    cost = n * (queries * np.minimum(2 * reach + 1, rows) + MOVED * (rows + queries))
    best_n = int(cost.argmin())
    return best_n + 1, int(reach[best_n])


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, top: int = TOP, orderings: int = ORDERINGS, recall: float = RECALL, block: int = BLOCK, compared: Accumulator | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its ``top`` nearest found, nearest first.

    Queries are the rows whose id is divisible by ``every``; candidates all rows but the query's own.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids
    and vectors of another length than most (of equally many, the longer) have. Rows that repeat both
    id and vector count once. No rows give no rows. ``recall`` is what the reach is chosen for;
    ``compared`` adds up the inner products that the windows take.
    """
    spark = df.sparkSession
    small_batches(spark)
    v = F.col(f"`{vector_col}`")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    kind = "<f4" if df.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    valid = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<float>" if kind == "<f4" else "array<double>").alias("v")).where(fine & F.col("id").isNotNull())
    sizes = valid.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    valid = valid.where(F.size("v") == sizes["n"])
    partial = valid.mapInArrow(_partial(kind, every, top + 1), "vec binary, ids array<long>, asks boolean")
    grouped = partial.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, top + 1).alias("ids"), F.max("asks").alias("asks"))
    classes = stored(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    norm = valid.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("m")).first()["m"] ** 0.5
    share = min(1.0, 0.95 * SAMPLE / n)
    sample = classes.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) <= int((1 << 20) * share)).select("vec").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        sample = classes.select("vec").limit(SAMPLE).toArrow()
    curves = fit(_vectors(sample.column("vec"), kind), norm * (1 + 1e-12), kind, orderings)

    # ranks
    keyed = classes.select("cid", "vec", "asks").mapInArrow(_keyed(curves), "ordering int, key long, cid long, query boolean")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = keyed.repartitionByRange(parts, "ordering", "key", "cid", "query").sortWithinPartitions("ordering", "key", "cid", "query")
    placed = stored(in_order.mapInArrow(_placed, "ordering int, cid long, query boolean, part int, place long"), "places")
    counted = placed.groupBy("ordering", "part").agg(F.count("*").alias("n"))
    before = counted.select("ordering", "part", F.coalesce(F.sum("n").over(W.partitionBy("ordering").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = placed.where("ordering = 0").count()
    ranked = stored(placed.join(before, ["ordering", "part"]).select("ordering", "cid", "query", (F.col("place") + F.col("before")).alias("rank")), "ranks")
    asking = total - n
    orderings, reach = _plan(classes, ranked, kind, top, recall, n, asking, orderings)
    size = min(block, max(LEAST_BLOCK, 2 * reach))
    blocks = -(-total // size)
    # queries that come by a block, about; where they are many, the block is copied to several tasks
    salts = max(1, -(-int(asking * min(1.0, (2 * reach + size) / total)) // ASKED))
    ranked = ranked.where(F.col("ordering") < orderings)
    place = lambda rank: F.floor(rank / size).cast("int")
    window = F.sequence(place(F.greatest(F.lit(0), F.col("rank") - reach)), place(F.least(F.lit(total - 1), F.col("rank") + reach)))
    to = F.when(F.col("query"), window).otherwise(F.array(place(F.col("rank"))))
    salt = F.when(F.col("query"), F.array(F.pmod(F.xxhash64("cid"), F.lit(salts)))).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    dealt = ranked.join(classes.select("cid", "vec", F.element_at("ids", 1).alias("least")), "cid").select("ordering", F.explode(to).alias("block"), "cid", "query", "rank", "vec", "least")
    dealt = dealt.withColumn("salt", F.explode(salt)) if salts > 1 else dealt.withColumn("salt", F.lit(0).cast("long"))

    lists = dealt.groupBy("ordering", "block", "salt").applyInArrow(_search(kind, top + 1, reach, compared), "cid long, found array<long>, scores array<double>, least array<long>")
    some = F.pmod(F.xxhash64("cid"), F.lit(max(1, -(-asking // MERGED))))
    merged = lists.withColumn("some", some).groupBy("some").applyInArrow(_merge(top + 1), "asker long, cid long, score double")
    # from classes to ids: of each list the first top + 1 ids, one of which may be the query's own
    entries = merged.join(classes.select("cid", "ids"), "cid").select("asker", F.explode("ids").alias("vec_id"), "score")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("id"))))
    best = entries.groupBy("asker").agg(F.slice(ordered, 1, top + 1).alias("best"))
    askers = valid.where(F.col("id") % every == 0).select("id", "v").mapInArrow(_asked(kind), "query_id long, vec binary").distinct()
    results = askers.join(classes.where("asks").select("vec", "cid"), "vec").join(best, F.col("cid") == F.col("asker"))
    own = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, top)
    listed = results.select("query_id", F.posexplode(own).alias("k", "x"))
    return listed.select("query_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _asked(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = (np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), kind).reshape(b.num_rows, -1) + 0.0).astype(kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in flat], pa.binary())], names=["query_id", "vec"])

    return run
