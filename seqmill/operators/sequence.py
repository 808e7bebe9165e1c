"""Operators over ordered logs: every one takes a track key and an order that is total within it.

All are window functions partitioned by track, so a plan shuffles once by track and reuses that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _w(keys: list[str], order: list[str]):
    return W.partitionBy(*keys).orderBy(*order)


def running_clock(df: DataFrame, track: str, order: list[str], wait: str) -> DataFrame:
    """Clock at which each row happens: the waits of all rows before it."""
    before = _w([track], order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("clock", F.coalesce(F.sum(wait).over(before), F.lit(0)).cast("long"))


def merge_runs(df: DataFrame, track: str, order: list[str], is_wait: Column, amount: str) -> DataFrame:
    """Rows for which ``is_wait`` holds join those directly before them: first row's key, summed amount."""
    w = _w([track], order)
    island = F.sum(F.when(is_wait, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = df.withColumns({"__wait": is_wait, "__island": island})
    first = F.min(F.struct(*order))
    grouped = marked.where("__wait").groupBy(track, "__island").agg(first.alias("f"), F.sum(amount).cast("long").alias("amount"), F.count("*").alias("merged"))
    return grouped.select(track, *[F.col(f"f.{c}").alias(c) for c in order], "amount", "merged")


def changes(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is not that of the row before (nulls compare as values); the first always counts."""
    w = _w(keys, order)
    marked = df.withColumns({"previous": F.lag(value).over(w), "__n": F.row_number().over(w)})
    return marked.where((F.col("__n") == 1) | ~F.col("previous").eqNullSafe(F.col(value))).drop("__n")


def as_of(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "state") -> DataFrame:
    """The last known value at each row, the row itself included."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_w(keys, order).rowsBetween(W.unboundedPreceding, 0)))


def intervals(df: DataFrame, keys: list[str], order: list[str], clock: str, opens: Column, closes: Column) -> DataFrame:
    """Opened until the next opening (retrigger) or closing; without one still open (null end).

    Only the transitions matter, so rows of neither kind are gone before the window.
    """
    w = _w(keys, order)
    edges = df.withColumn("__on", F.when(opens, 1).when(closes, 0)).where("__on is not null")
    following = edges.withColumns({"end": F.lead(clock).over(w), "retriggered": F.lead("__on").over(w) == 1})
    return following.where("__on = 1").withColumn("retriggered", F.coalesce("retriggered", F.lit(False))).drop("__on")


def sessions(df: DataFrame, keys: list[str], order: list[str], clock: str, gap: int) -> DataFrame:
    """Onsets: rows more than ``gap`` after the one before start a new session."""
    w = _w(keys, order)
    start = F.when(F.col(clock) - F.lag(clock).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("__s", start).withColumn("session", F.sum("__s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__s")


def active_time(df: DataFrame, keys: list[str], order: list[str], clock: str, on: Column, end: Column) -> DataFrame:
    """Time from each row to the next (the last: to ``end``), summed by key where ``on`` holds, and all of it."""
    w = _w(keys, order)
    span = F.coalesce(F.lead(clock).over(w), end) - F.col(clock)
    return df.withColumns({"__span": span, "__on": on}).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("__on"), F.col("__span"))), F.lit(0)).cast("long").alias("active"), F.sum("__span").cast("long").alias("total")
    )


def longest_run(df: DataFrame, keys: list[str], order: list[str], holds: Column) -> DataFrame:
    """The largest number of rows in a row for which ``holds`` is true; 0 if none."""
    w = _w(keys, order).rowsBetween(W.unboundedPreceding, 0)
    marked = df.withColumns({"__h": F.when(holds, 1).otherwise(0)}).withColumn("__i", F.sum(1 - F.col("__h")).over(w))
    return marked.groupBy(*keys, "__i").agg(F.sum("__h").alias("n")).groupBy(*keys).agg(F.max("n").cast("long").alias("longest"))


def grid(clock: Column, bar: int, beats: int = 16) -> tuple[Column, Column]:
    """Bar and beat of a clock: beats round half up, and the last half beat belongs to the next bar."""
    beat_len = bar / beats
    whole = F.floor(clock / bar)
    beat = F.floor((clock - whole * bar) / beat_len + 0.5)
    return F.when(beat >= beats, whole + 1).otherwise(whole).cast("long"), F.when(beat >= beats, 0).otherwise(beat).cast("long")


def grid_marks(df: DataFrame, keys: list[str], order: list[str], bar: str, beat: str, half: int = 8) -> DataFrame:
    """What a row puts out before itself: bars passed since the row before, whether the beat is new, a half bar hit."""
    w = _w(keys, order)
    last_bar, last_beat = F.coalesce(F.lag(bar).over(w), F.lit(-1)), F.lag(beat).over(w)
    passed = F.greatest(F.col(bar) - last_bar, F.lit(0))
    new_beat = (passed > 0) | ~last_beat.eqNullSafe(F.col(beat))
    below = F.when(passed > 0, F.lit(0)).otherwise(F.coalesce(last_beat, F.lit(0)))
    return df.withColumns({"bars": passed.cast("long"), "new_beat": new_beat, "half_beat": new_beat & (F.col(beat) == half) & (below < half)})


def split_envelope(points: DataFrame, keys: list[str], order: list[str], clock: str, bucket: str, end: str, most: int = 8) -> DataFrame:
    """Cut an interval where the bucket of its waypoints changes; at most ``most`` parts, the last to the end."""
    w = _w(keys, order)
    changed = changes(points, keys, order, bucket).drop("previous")
    kept = changed.withColumn("part", F.row_number().over(w)).where(F.col("part") <= most)
    return kept.withColumn("until", F.coalesce(F.lead(clock).over(w), F.col(end)))


def steps(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Difference of each row's value to the one before."""
    return df.withColumn("step", F.col(value) - F.lag(value).over(_w(keys, order)))


def reorders(df: DataFrame, keys: list[str], order: list[str], other: str) -> DataFrame:
    """Rows whose counterpart comes after that of the next row."""
    return df.withColumn("reordered", F.coalesce(F.lead(other).over(_w(keys, order)) < F.col(other), F.lit(False)))


def last_before(left: DataFrame, right: DataFrame, key: str, clock: str, start: str, end: str) -> DataFrame:
    """Point in interval: the last interval of the key that starts at or before the point, if it still lasts.

    Both sides go through one sort by key and clock; no pair of rows is built.
    """
    a = left.select(F.col(key), F.col(clock).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.schema[end].dataType).alias("__end"))
    b = right.select(F.col(key), F.col(start).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(end).alias("__end"))
    both = a.unionByName(b)
    w = W.partitionBy(key).orderBy("__t", "__side", F.col("__end").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("__last", F.last(F.when(F.col("__side") == 0, F.struct(F.col("__t").alias("s"), F.col("__end").alias("e"))), ignorenulls=True).over(w))
    hits = F.col("__last").isNotNull() & (F.col("__last.e").isNull() | (F.col("__t") < F.col("__last.e")))
    return seen.where("__side = 1").select("__row.*", hits.alias("inside"))
