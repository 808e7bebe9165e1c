"""Corpus preparation: dedup, splits, hold-outs, quality gates, vocabularies, lookups, diagnostics."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.functions.text import hash_bucket, normal_name, split_names

PAD, BOS, EOS, UNK = 0, 1, 2, 3
BROADCAST, BROADCAST_BYTES = 200_000, 32 << 20  # rows and bytes up to which a dimension is sent to every task


def small(dim: DataFrame, most: int = BROADCAST, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A dimension to join with: broadcast if its rows and their bytes are counted small, else left to a shuffled join."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in dim.columns]))))
    seen = dim.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(size, F.lit(0)).alias("bytes")).first()
    return F.broadcast(dim) if seen["n"] <= most and seen["bytes"] <= most_bytes else dim


def first_wins(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """One row for each key, the first in ``order``.

    The winner comes from an aggregate, which combines before the shuffle: a key with very many rows
    is no more work for one task than another.
    """
    keyed = df.withColumn("__key", key)
    first = keyed.groupBy("__key").agg(F.min(F.struct(*order)).alias("__first")).select("__key", "__first")
    return keyed.join(first, "__key").where(F.struct(*order).eqNullSafe(F.col("__first"))).drop("__key", "__first")


def hash_split(df: DataFrame, key: str, validation: float = 0.05) -> DataFrame:
    """``split``: val for the keys whose hash falls below the share, else train; the same in every run."""
    return df.withColumn("split", F.when(hash_bucket(F.col(key)) < int(validation * 10_000), "val").otherwise("train"))


def hold_out(df: DataFrame, group: str, skip: int = 5, take: int = 8) -> DataFrame:
    """``group, n, held_out``: the groups ranked after the ``skip`` largest, ``take`` of them, by size and name.

    Unknown groups (null or empty) are never held out. Groups are ranked from their counts alone.
    """
    sizes = df.where(F.col(group).isNotNull() & (F.col(group) != "")).groupBy(group).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.col("n").desc(), group).limit(skip + take).withColumn("__r", F.row_number().over(W.orderBy(F.col("n").desc(), group)))
    held = top.where(F.col("__r") > skip).select(group, F.lit(True).alias("held_out"))
    return sizes.join(F.broadcast(held), group, "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def gate(*rules: tuple[Column, str]) -> Column:
    """The first rule that rejects a row, or null: rules in order."""
    out = F.lit(None).cast("string")
    for test, reason in reversed(rules):
        out = F.when(test, reason).otherwise(out)
    return out


def vocabulary(tokens: DataFrame, token: str, least: int = 2, most: int | None = None, offset: int = 4) -> DataFrame:
    """``token, n, id``: tokens that occur ``least`` times, most frequent first, ids after the special ones.

    Ids follow a global order, so they come from a sort by range and counts by partition, as positions
    of packed sequences do; without a cap nothing is ranked in one task.
    """
    from seqmill.session import stored

    counts = tokens.groupBy(F.col(token).alias("token")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    if most is not None:
        counts = counts.orderBy(F.col("n").desc(), "token").limit(most)
    ranked = counts.repartitionByRange(F.col("n").desc(), F.col("token")).withColumn("__part", F.spark_partition_id())
    ranked = stored(ranked, "vocabulary")
    sums = ranked.groupBy("__part").agg(F.count("*").alias("c"))
    before = sums.select("__part", F.coalesce(F.sum("c").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"))  # a row for each partition
    local = F.row_number().over(W.partitionBy("__part").orderBy(F.col("n").desc(), "token"))
    return ranked.withColumn("__l", local).join(F.broadcast(before), "__part").select("token", "n", (F.col("b") + F.col("__l") - 1 + offset).cast("long").alias("id"))


def encode(tokens: DataFrame, token: str, vocab: DataFrame, unknown: int = UNK) -> DataFrame:
    """Adds ``id``; tokens outside the vocabulary get ``unknown``."""
    known = small(vocab.select(F.col("token").alias(token), "id"))
    return tokens.join(known, token, "left").withColumn("id", F.coalesce("id", F.lit(unknown)))


def decode(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    return ids.join(small(vocab.select("id", "token")), "id", "left")


def top_names(df: DataFrame, name: str, k: int) -> DataFrame:
    """The k most frequent single names of compound credits; ties by name; ids from 0."""
    exploded = df.select(F.explode(split_names(F.col(name))).alias("name"))
    top = exploded.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(k)
    return top.select("name", "n", (F.row_number().over(W.orderBy(F.col("n").desc(), "name")) - 1).cast("long").alias("id"))  # k rows


def look_up(df: DataFrame, key: str, name: str, dim: DataFrame, unknown: int) -> DataFrame:
    """``key, id``: of the whole name, else of its first part that is known, else ``unknown``."""
    whole = df.select(key, F.col(name).alias("name"), F.lit(0).alias("pos"))
    parts = df.select(key, F.posexplode(split_names(F.col(name))).alias("p", "name")).select(key, "name", (F.col("p") + 1).alias("pos"))
    hits = whole.unionByName(parts).join(small(dim.select("name", "id")), "name").groupBy(key).agg(F.min_by("id", "pos").alias("id"))
    return df.select(key).join(hits, key, "left").select(key, F.coalesce("id", F.lit(unknown)).alias("id"))


def curated(df: DataFrame, name: str, listed: DataFrame) -> DataFrame:
    """``name, n, listed``: names of either side after normalising, how often the corpus has them, and whether they are listed."""
    own = df.groupBy(normal_name(F.col(name)).alias("name")).agg(F.count("*").alias("n"))
    want = listed.select(normal_name(F.col("name")).alias("name")).distinct().withColumn("listed", F.lit(True))
    return own.join(want, "name", "full").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("listed", F.lit(False)).alias("listed"))


def tally(items: Column) -> Column:
    """Of an array, in one pass over it when sorted: ``n``, ``distinct``, ``repeated`` (distinct ones that occur more than once), ``bits`` of entropy.

    All within a row: nothing is shuffled.
    """
    weight = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
    long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")

    def state(last: Column, run: Column, distinct: Column, repeated: Column, s: Column) -> Column:
        return F.struct(last.alias("last"), run.alias("run"), distinct.alias("distinct"), repeated.alias("repeated"), s.alias("s"))

    def step(a: Column, x: Column) -> Column:
        same = (a["run"] > 0) & x.eqNullSafe(a["last"])
        again = state(a["last"], a["run"] + 1, a["distinct"], a["repeated"] + F.when(a["run"] == 1, long(1)).otherwise(long(0)), a["s"])
        return F.when(same, again).otherwise(state(x, long(1), a["distinct"] + 1, a["repeated"], a["s"] + weight(a["run"])))

    def done(a: Column) -> Column:
        n, s = F.size(items).cast("long"), a["s"] + weight(a["run"])
        return F.struct(n.alias("n"), a["distinct"].alias("distinct"), a["repeated"].alias("repeated"), F.when(n > 0, F.log2(n) - s / n).otherwise(0.0).alias("bits"))

    first = F.get(items, F.lit(0))
    return F.aggregate(F.array_sort(items), state(F.when(F.lit(False), first), long(0), long(0), long(0), F.lit(0.0)), step, done)


def gram_repeats(df: DataFrame, key: str, tokens: str, n: int) -> DataFrame:
    """Share of a sequence's distinct n-grams that occur more than once; counted within the row. A row for each sequence of n tokens at least."""
    t = F.col(tokens)
    grams = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda k: F.array_join(F.slice(t, k, n), "\u0001"))
    counted = df.where(F.size(t) >= n).select(key, grams.alias("grams")).select(key, tally(F.col("grams")).alias("c"))
    return counted.select(key, F.col("c.distinct").alias("grams"), F.col("c.repeated").alias("repeated"), F.round(F.col("c.repeated") / F.col("c.distinct"), 6).alias("share"))


def row_entropy(df: DataFrame, key: str, tokens: str, least: int = 10) -> DataFrame:
    """Shannon entropy of a sequence's tokens in bits, within the row; under ``least`` tokens 0."""
    counted = df.select(key, tally(F.col(tokens)).alias("c"))
    return counted.select(key, "c.n", "c.distinct", F.round(F.when(F.col("c.n") < least, 0.0).otherwise(F.col("c.bits")), 6).alias("bits"))


def entropy(df: DataFrame, key: str, token: str, least: int = 10) -> DataFrame:
    """Shannon entropy of a key's tokens in bits; under ``least`` tokens 0."""
    counts = df.groupBy(key, token).agg(F.count("*").alias("c"))
    sums = counts.groupBy(key).agg(F.sum("c").alias("n"), F.count("*").alias("distinct"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    h = F.when(F.col("n") < least, 0.0).otherwise(F.log2("n") - F.col("s") / F.col("n"))
    return sums.select(key, "n", "distinct", F.round(h, 6).alias("bits"))


def coverage(df: DataFrame, group: str) -> DataFrame:
    """Groups by size with the share of all rows that the groups up to each one have."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    # groups of a size are alike: the running sums go over sizes, of which there are few
    by_size = sizes.groupBy("n").agg(F.count("*").alias("groups"))
    w = W.orderBy(F.col("n").desc()).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(F.col("n") * F.col("groups")).over(W.partitionBy())
    run = by_size.select("n", "groups", F.sum("groups").over(w).alias("groups_so_far"), F.round(F.sum(F.col("n") * F.col("groups")).over(w) / total, 6).alias("covered"))
    return run


def window_report(windows: DataFrame, ids: str, pad: int = PAD, vocabulary_size: int = 1024, every: int = 1) -> DataFrame:
    """One row for each looked-at window: out-of-range ids, padding, distinct ids, entropy, and flags."""
    seen = windows.where(F.pmod("window", F.lit(every)) == 0)
    t = F.col(ids)
    plain = seen.select(
        "window", F.size(F.filter(t, lambda x: (x < 0) | (x >= vocabulary_size))).cast("long").alias("out_of_range"),
        F.round(F.size(F.filter(t, lambda x: x == pad)) / F.size(t), 6).alias("padding"), F.size(F.array_distinct(t)).cast("long").alias("distinct"), F.filter(t, lambda x: x != pad).alias("own"),
    )
    counted = plain.withColumn("c", tally(F.col("own")))
    joined = counted.withColumn("bits", F.round(F.when(F.col("c.n") < 10, 0.0).otherwise(F.col("c.bits")), 6))
    return joined.select("window", "out_of_range", "padding", "distinct", "bits", (F.col("distinct") <= 2).alias("degenerate"), (F.col("padding") > 0.9).alias("mostly_padding"), (F.col("bits") < 1).alias("low_entropy"))


def nearest_l1(df: DataFrame, key: str, vector: str, library: DataFrame) -> DataFrame:
    """``key, lib, distance``: the library row ``(lib, vec)`` nearest in L1; of equal ones the first.

    The library is a dictionary of bounded size (at most 128 entries): it becomes a literal array, so
    each row is a projection and nothing is joined.
    """
    rows = library.orderBy("lib").limit(129).collect()
    if len(rows) > 128:
        raise ValueError("a library holds at most 128 vectors")
    if not rows:
        return df.select(key, F.lit(None).cast("long").alias("lib"), F.lit(None).cast("double").alias("distance"))
    listed = [{"lib": int(r["lib"]), "vec": [float(x) for x in r["vec"]]} for r in rows]
    lib = F.from_json(F.lit(json.dumps(listed)), "array<struct<lib: bigint, vec: array<double>>>")  # folds to a constant
    apart = lambda e: F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), e["vec"], lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform(lib, lambda e: F.struct(F.round(apart(e), 9).alias("d"), e["lib"].alias("lib"))))
    return df.withColumn("__b", best).select(key, F.col("__b.lib").alias("lib"), F.round("__b.d", 6).alias("distance"))


def nucleus(df: DataFrame, key: str, logit: str, token: str, p: float, k: int) -> DataFrame:
    """Softmax over each key's logits: the k best (ties at the last place stay), then the fewest that reach p."""
    w = W.partitionBy(key)
    ranked = df.withColumn("__r", F.rank().over(w.orderBy(F.col(logit).desc()))).where(F.col("__r") <= k)
    e = F.exp(F.col(logit) - F.max(logit).over(w))
    probs = ranked.withColumn("__e", e).withColumn("p", F.col("__e") / F.sum("__e").over(w))
    run = F.coalesce(F.sum("p").over(w.orderBy(F.col("p").desc(), token).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return probs.withColumn("__c", run).where(F.round("__c", 9) < p).select(key, token, F.round("p", 6).alias("p"))


def penalised(df: DataFrame, key: str, logit: str, token: str, recent: DataFrame, penalty: float, temperature: float = 1.0) -> DataFrame:
    """Adds ``scaled``: logits of recent tokens (key, token) divided by the penalty, or multiplied if not positive, over the temperature."""
    seen = recent.select(key, token).distinct().withColumn("__seen", F.lit(True))
    x = F.col(logit)
    pulled = F.when(F.col("__seen") & (x > 0), x / penalty).when(F.col("__seen"), x * penalty).otherwise(x)
    return df.join(seen, [key, token], "left").withColumn("scaled", pulled / temperature).drop("__seen")


# -- samples, orders and searches -----------------------------------------------------------------


def _shuffled(key: str, seed: int) -> Column:
    """A fixed pseudo-random order of keys; equal hashes go by key."""
    return F.struct(F.xxhash64(F.lit(seed), F.col(key)).alias("h"), F.col(key).alias("k"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, the same in every run."""
    return df.orderBy(_shuffled(key, seed)).limit(n)


def split_share(df: DataFrame, key: str, share: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds ``split``: of distinct keys max(1, floor(share * n)) are val, taken in a fixed order.

    Only the bound is looked for in order (a top-k over keys); rows compare with it.
    """
    keys = df.select(key).distinct()
    n = keys.count()
    take = max(1, int(share * n))
    last = keys.select(_shuffled(key, seed).alias("s")).orderBy("s").limit(take).agg(F.max("s").alias("s")).first()["s"] if n else None
    if last is None:
        return df.withColumn("split", F.lit("train"))
    bound = F.struct(F.lit(last["h"]).alias("h"), F.lit(last["k"]).alias("k"))
    return df.withColumn("split", F.when(_shuffled(key, seed) <= bound, "val").otherwise("train"))


def resume(df: DataFrame, key: str, start: int, seed: int = 42) -> DataFrame:
    """Rows in a fixed order, from the ``start``-th on: to go on where an earlier pass stopped."""
    return df.orderBy(_shuffled(key, seed)).offset(start)


def by_hints(df: DataFrame, name: str, game: str, track: str) -> DataFrame:
    """The best row for two hints: both in its name, else the game's alone without first tracks, else any of the game; by name."""
    import re

    has = lambda hint: F.col(name).rlike("(?i)" + re.escape(hint))
    rank = F.when(has(game) & has(track), 0).when(has(game) & ~F.contains(F.col(name), F.lit("_01_")), 1).when(has(game), 2)
    return df.withColumn("__rank", rank).where("__rank IS NOT NULL").orderBy("__rank", name).limit(1).drop("__rank")


def search(df: DataFrame, name: str, part: str) -> DataFrame:
    return df.where(F.contains(F.lower(name), F.lit(part.lower())))
