"""Two versions of a track's notes, channel by channel: pairs, a summary, and both as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.operators import sequence
from seqmill.operators.report import channel_name

KEYS = ["track_id", "channel"]
_DRIFTS = {"on": "d_on", "dur": "d_dur"}


def _numbered(notes: DataFrame, side: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy(*KEYS).orderBy("sample_on", "emit"))
    return notes.select(*KEYS, n.alias("k"), *[F.col(c).alias(f"{c}_{side}") for c in ("pitch", "velocity", "sample_on", "sample_off")])


def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Notes in equal places of a channel, and how they differ; ``reorder`` where b's next note begins before this one."""
    joined = _numbered(a, "a").join(_numbered(b, "b"), [*KEYS, "k"])
    length = lambda s: F.col(f"sample_off_{s}") - F.col(f"sample_on_{s}")
    apart = joined.withColumns({"d_pitch": F.col("pitch_b") - F.col("pitch_a"), "d_velocity": F.col("velocity_b") - F.col("velocity_a"), "d_on": F.col("sample_on_b") - F.col("sample_on_a"), "d_dur": length("b") - length("a")})
    return sequence.reorders(apart, KEYS, ["k"], "sample_on_b").withColumnRenamed("reordered", "reorder")


def _late(sizes, share: float):
    """The value at that share of an ascending array, by rank."""
    return F.get(sizes, F.least(F.floor(F.lit(share) * F.size(sizes)), F.size(sizes) - 1).cast("int"))


def summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """A row for each channel of either version: notes, what one has more than the other, drifts, mismatches."""
    counts = [n.groupBy(*KEYS).agg(F.count("*").alias(f"count_{s}")) for n, s in ((a, "a"), (b, "b"))]
    both = counts[0].join(counts[1], KEYS, "full").na.fill(0, ["count_a", "count_b"])
    p = pairs(a, b)
    drift = p.groupBy(*KEYS).agg(
        F.count_if("reorder").alias("reorders"), *[F.round(F.avg(c), 2).alias(f"mean_{n}") for n, c in _DRIFTS.items()], F.round(F.median("d_on"), 2).alias("median_on"),
        *[_late(F.array_sort(F.collect_list(F.abs(c))), 0.95).alias(f"p95_{n}") for n, c in _DRIFTS.items()], F.max(F.abs("d_on")).alias("max_on"),
        F.count_if(F.col("d_pitch") != 0).alias("pitch_mismatches"), F.count_if(F.col("d_velocity") != 0).alias("velocity_mismatches"),
    )
    missing = lambda x, y: F.greatest(F.col(f"count_{x}") - F.col(f"count_{y}"), F.lit(0))
    return both.join(drift, KEYS, "left").withColumns({"dropped": missing("a", "b"), "inserted": missing("b", "a"), "name": channel_name(F.col("channel"))})


def write(a: DataFrame, b: DataFrame, path: str) -> None:
    """``path/pairs``: CSV with a header, in a folder for each track and channel; ``path/summary``: JSON, an object for each channel."""
    ms = lambda c: F.format_string("%.2f", F.col(c) * (1000.0 / 44100)).alias(f"{c}_ms")
    p = pairs(a, b)
    named = p.select("track_id", channel_name(F.col("channel")).alias("channel"), "k", "pitch_a", "pitch_b", "d_pitch", "sample_on_a", "sample_on_b", "d_on", ms("d_on"), "sample_off_a", "sample_off_b", "d_dur", ms("d_dur"), "d_velocity", F.col("reorder").cast("int").alias("reorder"))
    named.repartition(*KEYS).sortWithinPartitions(*KEYS, "k").write.mode("overwrite").partitionBy(*KEYS).option("header", "true").csv(f"{path}/pairs")
    summary(a, b).write.mode("overwrite").json(f"{path}/summary")
