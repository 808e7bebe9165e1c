"""Augmenting, repeating and cutting token sequences. Token layouts are parameters with fixed defaults."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.functions.music import wait_bins
from seqmill.session import fresh, stored

WAIT_BINS = wait_bins()
#: Fixed values of the token layout: first id and number of ids.
TEMPO, KEY, PITCH, VELOCITY = (4, 181), (185, 24), (379, 88), (467, 16)
SHIFTS = tuple(range(12))  # of the variants: up by less than an octave
BOTH_WAYS = (-5, -4, -3, -2, -1, 0, 1, 2, 3, 4, 5, 6)  # of note lists that are held to a range
TEMPI = (0.85, 0.92, 1.08, 1.15)
VELOCITIES = (-1, 1)
REPEATS = {1: 1, 2: 5, 3: 1, 4: 1, 5: 10}


def _within(t: Column, span: tuple[int, int]) -> Column:
    return (t >= span[0]) & (t < span[0] + span[1])


def transpose(tokens: Column, by: Column | int) -> Column:
    """Pitches move and stop at the ends of their range; keys turn within their mode."""
    by = F.lit(by) if isinstance(by, int) else by
    k = F.lit(KEY[0])

    def one(t: Column) -> Column:
        pitch = F.greatest(F.lit(PITCH[0]), F.least(F.lit(PITCH[0] + PITCH[1] - 1), t + by))
        mode = F.floor((t - k) / 12) * 12
        key = k + mode + F.pmod(t - k - mode + by, F.lit(12))
        return F.when(_within(t, PITCH), pitch).when(_within(t, KEY), key).otherwise(t).cast("int")

    return F.transform(tokens, one)


def shift_tempo(tokens: Column, factor: Column | float) -> Column:
    """Tempo tokens go to the nearest tempo of the scaled one, within the range."""
    factor = F.lit(factor) if isinstance(factor, float) else factor
    bpm = lambda t: (t - TEMPO[0] + 60) * factor
    return F.transform(tokens, lambda t: F.when(_within(t, TEMPO), TEMPO[0] + F.greatest(F.lit(0), F.least(F.lit(TEMPO[1] - 1), F.ceil(bpm(t) - 0.5) - 60))).otherwise(t).cast("int"))


def shift_velocity(tokens: Column, by: Column | int) -> Column:
    by = F.lit(by) if isinstance(by, int) else by
    return F.transform(tokens, lambda t: F.when(_within(t, VELOCITY), F.greatest(F.lit(VELOCITY[0]), F.least(F.lit(VELOCITY[0] + VELOCITY[1] - 1), t + by))).otherwise(t).cast("int"))


#: Variants of a sequence: name, what is changed, by how much.
VARIANTS = (
    [(f"key{s:+d}", "key", float(s)) for s in SHIFTS] + [(f"tempo{f}", "tempo", f) for f in TEMPI] + [(f"velocity{v:+d}", "velocity", float(v)) for v in VELOCITIES]
)


def _changed(tokens: Column, kind: Column, by: Column) -> Column:
    return F.when(kind == "key", transpose(tokens, by.cast("int"))).when(kind == "tempo", shift_tempo(tokens, by)).otherwise(shift_velocity(tokens, by.cast("int")))


def fan_out(df: DataFrame, tokens: str) -> DataFrame:
    """Eighteen variants of a sequence, each changed in one way: keys (0 included), tempi, velocities.

    What each does to every token that it can change is worked out once, as a table; a row is then
    multiplied by the tables, which are constants, and each token looked up. So one sequence is changed
    at a time, and each token costs a look into an array.
    """
    ids = VELOCITY[0] + VELOCITY[1]  # no variant changes the tokens from here on
    all_ids = df.sparkSession.range(1).select(F.sequence(F.lit(0), F.lit(ids - 1)).alias("t"))
    how = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(k).alias("kind"), F.lit(by).alias("by")) for n, k, by in VARIANTS]))
    tables = all_ids.withColumn("x", how).select("x.variant", _changed(F.col("t"), F.col("x.kind"), F.col("x.by")).alias("table")).collect()
    listed = F.from_json(F.lit(json.dumps([r.asDict() for r in tables])), "array<struct<variant: string, table: array<int>>>")  # folds to a constant
    (own,) = fresh("how")
    rest = [F.col(f"`{c}`") for c in df.columns if c != tokens]
    looked_up = F.transform(F.col(f"`{tokens}`"), lambda t: F.coalesce(F.get(F.col(f"{own}.table"), t), t))
    return df.withColumn(own, F.explode(listed)).select(*rest, F.col(f"{own}.variant").alias("variant"), looked_up.alias(tokens))


def transpose_checked(df: DataFrame, notes: str, shifts: tuple[int, ...] = BOTH_WAYS, low: int = 21, high: int = 108) -> DataFrame:
    """Every shift of a note list whose notes all stay in range."""
    moved = df.withColumn("shift", F.explode(F.array(*map(F.lit, shifts)))).withColumn(notes, F.transform(notes, lambda n: n + F.col("shift")))
    return moved.where(F.forall(notes, lambda n: n.between(low, high)))


def repeat_by(df: DataFrame, cluster: Column, repeats: dict[int, int] = REPEATS) -> DataFrame:
    """Each row as often as its cluster says; unknown clusters once. ``copy`` counts from 0."""
    times = F.lit(1)
    for k, n in repeats.items():
        times = F.when(cluster == k, n).otherwise(times)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))


def positions(lengths: DataFrame, order: str, length: str) -> tuple[DataFrame, int]:
    """``order, length, start``: where each sequence starts in the whole, by ``order``; and the length of the whole.

    A prefix sum in two levels over ``order`` and ``length`` alone: rows are sorted by range, into as
    many parts as the session shuffles to; sums within a part and the sums of the parts before add up,
    so no task sees all rows. ``order`` must be unique.
    """
    placed = lengths.select(order, length).repartitionByRange(order).withColumn("__part", F.spark_partition_id())
    placed = stored(placed, "positions")  # the ranges are drawn once
    sums = stored(placed.groupBy("__part").agg(F.sum(length).alias("n")), "sums")
    before = sums.select("__part", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each partition
    local = F.coalesce(F.sum(length).over(W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = placed.withColumn("__local", local).join(F.broadcast(before), "__part").select(order, length, (F.col("__before") + F.col("__local")).cast("long").alias("start"))
    return starts, sums.agg(F.sum("n").alias("n")).first()["n"] or 0


def windows(df: DataFrame, order: str, tokens: str, size: int, pad: int = 0) -> DataFrame:
    """Concatenate all sequences and cut into windows of size + 1: inputs, and labels one ahead (padding: -100).

    The tail that fills no window goes. Too few tokens for one window are a ValueError.
    """
    step = size + 1
    starts, total = positions(df.select(order, F.coalesce(F.size(tokens), F.lit(0)).alias("__n")), order, "__n")
    if total < step:
        raise ValueError(f"{total} tokens do not fill a window of {step}")
    first, last = F.floor(F.col("start") / step), F.floor((F.col("start") + F.col("__n") - 1) / step)
    cut = df.select(order, tokens).join(starts.where("__n > 0"), order).withColumn("window", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("window") * step - F.col("start"), F.lit(0))
    end = F.least((F.col("window") + 1) * step - F.col("start"), F.col("__n"))
    parts = cut.select("window", (F.col("start") + begin).alias("at"), F.slice(tokens, (begin + 1).cast("int"), (end - begin).cast("int")).alias("part"))
    joined = parts.groupBy("window").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("all"))
    whole = joined.where(F.size("all") == step)
    labels = F.transform(F.slice("all", 2, size), lambda t: F.when(t == pad, -100).otherwise(t).cast("int"))
    return whole.select(F.col("window").cast("long").alias("window"), F.slice("all", 1, size).alias("input_ids"), labels.alias("labels"))
