"""Tempo, key, meter, roles and profiles of tracks, from histograms and grouped statistics."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The Krumhansl-Kessler key profiles, major and minor.
PROFILES = (
    (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88),
    (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17),
)


def histogram(df: DataFrame, track: str, clock: Column, width: int) -> DataFrame:
    """Onsets by bin of ``width``, empty bins left out: a tumbling window."""
    return df.groupBy(track, F.floor(clock / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def autocorrelation(hist: DataFrame, track: str, low: int, high: int) -> DataFrame:
    """Sum of products of bins ``lag`` apart, for lags from low to high, where it is not zero.

    Each bin is joined with the bins it can meet by equality: the lags are unfolded on one side, so a
    track's bins are never all paired.
    """
    ahead = hist.select(track, F.explode(F.sequence(F.col("bin") + low, F.col("bin") + high)).alias("at"), "bin", "n")
    met = ahead.join(hist.select(track, F.col("bin").alias("at"), F.col("n").alias("m")), [track, "at"])
    return met.groupBy(track, (F.col("at") - F.col("bin")).alias("lag")).agg(F.sum(F.col("n") * F.col("m")).cast("long").alias("acf"))


def peak(acf: DataFrame, track: str, low: int, high: int) -> DataFrame:
    """The first largest lag, and the top of the parabola through it and its neighbours."""
    w = W.partitionBy(track).orderBy(F.col("acf").desc(), "lag")
    by_lag = W.partitionBy(track).orderBy("lag").rangeBetween(-1, -1), W.partitionBy(track).orderBy("lag").rangeBetween(1, 1)
    y0, y2 = (F.coalesce(F.max("acf").over(x), F.lit(0)) for x in by_lag)
    top = acf.withColumns({"k": F.row_number().over(w), "y0": y0, "y2": y2}).where("k = 1")
    curve = F.col("y0") - 2 * F.col("acf") + F.col("y2")
    shift = F.when((curve < 0) & (F.col("lag") > low) & (F.col("lag") < high), F.lit(0.5) * (F.col("y0") - F.col("y2")) / curve).otherwise(F.lit(0.0))
    return top.select(track, F.col("lag").alias("peak"), "acf", F.round(F.col("lag") + shift, 6).alias("period"))


def meter(hist: DataFrame, acf: DataFrame, track: str, beat: int, least: int = 12, sure: float = 1.5, guard: float = 0.7) -> DataFrame:
    """Beats in a bar from the strength at 2, 3 and 4 beats: the best must stand out, and 2 must beat 4 clearly."""
    onsets = hist.groupBy(track).agg(F.sum("n").alias("onsets"))
    at = [F.coalesce(F.max(F.when(F.col("lag") == k * beat, F.col("acf"))), F.lit(0)).alias(f"s{k}") for k in (2, 3, 4)]
    s = onsets.join(acf.groupBy(track).agg(*at), track, "left").na.fill(0, ["s2", "s3", "s4"])
    s2, s3, s4 = (F.col(c) for c in ("s2", "s3", "s4"))
    unsure = lambda best, a, b: (F.greatest(a, b) > 0) & (best < sure * F.greatest(a, b))
    beats = (
        F.when(F.col("onsets") < least, 4)
        .when((s2 >= s3) & (s2 >= s4), F.when(unsure(s2, s3, s4) | (s4 > guard * s2), 4).otherwise(2))
        .when(s3 >= s4, F.when(unsure(s3, s2, s4), 4).otherwise(3))
        .otherwise(4)
    )
    return s.select(track, "s2", "s3", "s4", beats.alias("beats"))


def beat_phase(hist: DataFrame, track: str, period: int) -> DataFrame:
    """The phase of a comb of ``period`` bins that meets most onsets; the first of equals."""
    scores = hist.groupBy(track, F.pmod("bin", F.lit(period)).alias("phase")).agg(F.sum("n").cast("long").alias("score"))
    w = W.partitionBy(track).orderBy(F.col("score").desc(), "phase")
    return scores.withColumn("k", F.row_number().over(w)).where("k = 1").select(track, "phase", "score")


def pitch_classes(df: DataFrame, track: str, pitch: Column, duration: Column) -> DataFrame:
    """Time by pitch class; every note counts one at least."""
    return df.groupBy(track, F.pmod(pitch, F.lit(12)).alias("pc")).agg(F.sum(F.greatest(F.lit(1), duration)).cast("long").alias("weight"))


def key(classes: DataFrame, track: str) -> DataFrame:
    """The best of 24 keys by correlation of the full 12-bin histogram with the turned profiles.

    The twelve sums of a track are one row; the profiles are constants, so nothing is joined.
    """
    h = classes.groupBy(track).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("pc") == k, F.col("weight"))), F.lit(0)).cast("double") for k in range(12)]).alias("h"))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    h = h.withColumn("d", F.transform("h", lambda x: x - add(F.col("h")) / 12)).withColumn("spread", F.sqrt(F.nullif(add(F.transform("d", lambda x: x * x)), F.lit(0.0))))
    tries = []
    for root in range(12):
        for minor, profile in enumerate(PROFILES):
            centre = sum(profile) / 12
            turned = [profile[(k - root) % 12] - centre for k in range(12)]
            tries.append({"root": -root, "minor": -minor, "v": turned, "norm": sum(x * x for x in turned) ** 0.5})
    keys = F.from_json(F.lit(json.dumps(tries)), "array<struct<root: int, minor: int, v: array<double>, norm: double>>")  # folds to a constant
    r = lambda t: F.round(add(F.zip_with("d", t["v"], lambda x, y: x * y)) / (F.col("spread") * t["norm"]), 9)
    best = h.withColumn("b", F.array_max(F.transform(keys, lambda t: F.struct(r(t).alias("r"), t["root"].alias("root"), t["minor"].alias("minor")))))
    return best.select(track, (-F.col("b.root")).alias("key_index"), (F.col("b.minor") == -1).alias("is_minor"), F.round("b.r", 6).alias("score"))


def channel_stats(df: DataFrame, channel: str, pitch: str, clock: str, unit: int) -> DataFrame:
    """Count, mean and population spread of pitches (null: none), and notes by unit of time (0 for one note)."""
    span = F.greatest(F.lit(1.0), (F.max(clock) - F.min(clock)) / F.lit(float(unit)))
    return df.groupBy(channel).agg(
        F.count("*").alias("n"), F.avg(pitch).alias("mean"), F.coalesce(F.stddev_pop(pitch), F.lit(0.0)).alias("spread"), F.when(F.count("*") <= 1, 0.0).otherwise(F.count("*") / span).alias("density")
    )


def role(drums: Column, noise: Column, mean: Column, density: Column, low: float = 48, high: float = 60, dense: float = 3.0) -> Column:
    """First rule that holds: drums, percussion, unknown, bass, lead, counter melody, harmony."""
    return (
        F.when(drums, "DRUMS").when(noise, "PERC").when(mean.isNull(), "UNK").when(mean < low, "BASS").when((mean >= high) & (density >= dense), "LEAD").when(mean >= high, "COUNTER").otherwise("HARM")
    )


#: Strict bounds beyond which a track belongs to a cluster.
LIMITS = {"pan_rate": 1.0, "lfo_frac": 0.10, "ch3_frac": 0.05, "ic_rate": 0.5, "dac_frac": 0.40, "psg_frac": 0.35}


def cluster(limits: dict[str, float] = LIMITS) -> Column:
    """Hardware profile by ordered rules over the feature columns."""
    over = lambda c: F.col(c) > limits[c]
    return (
        F.when(over("pan_rate") | over("lfo_frac") | over("ch3_frac"), 5).when(over("ic_rate") | (F.col("ssg_eg") > 0), 4).when(over("dac_frac"), 3).when(over("psg_frac"), 2).otherwise(1)
    )


def ema(df: DataFrame, track: str, order: list[str], value: str, keep: float, spike: float) -> DataFrame:
    """Exponential mean over each track's rows so far, and rows beyond ``spike`` times the mean before them.

    A weighted sum of the rows seen: the weights fall by ``keep`` with each row. It is taken in one
    streaming pass over sorted rows, so a long track never sits in memory.
    """
    import pandas as pd

    def run(batches):
        state: dict = {"track": None, "mean": None}
        for b in batches:
            means, spikes = [], []
            for t, v in zip(b[track], b[value], strict=True):
                if t != state["track"] or state["mean"] is None:
                    state.update(track=t, mean=v)
                    spikes.append(False)
                else:
                    spikes.append(bool(v > spike * state["mean"]))
                    state["mean"] = keep * state["mean"] + (1 - keep) * v
                means.append(state["mean"])
            yield pd.DataFrame({track: b[track], order[0]: b[order[0]], "ema": means, "spike": spikes})

    kinds = {c: t for c, t in df.dtypes}
    in_order = df.select(track, *order, value).repartition(track).sortWithinPartitions(track, *order)
    return in_order.mapInPandas(run, f"{track} {kinds[track]}, {order[0]} {kinds[order[0]]}, ema double, spike boolean").withColumn("ema", F.round("ema", 9))
