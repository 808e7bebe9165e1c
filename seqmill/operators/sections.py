"""Sections of a track: which notes lie in them, their own beat phases, and stretches in which a mode is on."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.operators import tracks
from seqmill.operators.chips import DRUM, NOISE, TONE0

RATE = 44100


def boundaries(rhythm: DataFrame, headers: DataFrame) -> DataFrame:
    """``track_id, section, begin, end, tempo`` in samples, from the tempo maps of rhythm(); each ends where the next begins, the last with the track."""
    flat = rhythm.select("track_id", F.posexplode("sections").alias("section", "s")).select("track_id", "section", F.floor(F.col("s.second") * RATE + 1e-6).cast("long").alias("begin"), F.col("s.tempo").alias("tempo"))
    following = F.lead("begin").over(W.partitionBy("track_id").orderBy("section"))
    return flat.withColumn("end", following).join(headers.select("track_id", "total_samples"), "track_id").select("track_id", "section", "begin", F.coalesce("end", "total_samples").alias("end"), "tempo")


def assign(notes: DataFrame, sections: DataFrame) -> DataFrame:
    """Notes with the ``section`` that they start in (begin included, end not); those in none are left out.

    A range join on the track: a track has a few sections.
    """
    s = sections.select("track_id", "section", F.col("begin").alias("__begin"), F.col("end").alias("__end"))
    return notes.join(s, "track_id").where("sample_on >= __begin AND sample_on < __end").drop("__begin", "__end")


def overlapping(notes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Notes that sound within a range (``track_id, channel, start, stop``) of their channel, each once for every such range."""
    joined = notes.join(ranges, ["track_id", "channel"])
    return joined.where((F.col("sample_off") > F.col("start")) & (F.col("sample_on") < F.col("stop")))


def tempo_maps(notes: DataFrame, sections: DataFrame) -> DataFrame:
    """``track_id, section, second, tempo, first_beat``: of each section the beat's phase by its own onsets, from the track's begin on."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        on = rows["sample_on"].dropna().to_numpy(np.int64) - int(r["begin"])
        phase = tracks.phase(tracks.Onsets(on, int(r["end"] - r["begin"])), float(r["tempo"]))
        return pd.DataFrame([{"track_id": r["track_id"], "section": r["section"], "second": r["begin"] / RATE, "tempo": r["tempo"], "first_beat": r["begin"] / RATE + phase}])

    own = assign(notes.where(F.col("channel") < DRUM).select("track_id", "sample_on"), sections).select("track_id", "section", "sample_on")
    rows = sections.join(own, ["track_id", "section"], "left")
    return rows.groupBy("track_id", "section").applyInPandas(run, "track_id string, section int, second double, tempo double, first_beat double")


def modes(lfo_on: Column | None = None) -> dict[str, Column]:
    """For each mode whether a note (NOTE_SCHEMA) has it. ``lfo_on``: whether the LFO runs when it starts (default: never)."""
    at = lambda k: F.element_at("patch", k + 1)
    fm = (F.col("channel") < 6) & F.col("patch").isNotNull()
    lfo = lfo_on if lfo_on is not None else F.lit(False)
    of_operators = lambda k, test: F.greatest(*[test(at(5 + 11 * op + k)).cast("int") for op in range(4)]) == 1
    bends = F.transform("bends", lambda b: b["a"])
    steps = F.transform(F.sequence(F.lit(1), F.size(bends) - 1), lambda k: F.get(bends, k) - F.get(bends, k - 1))
    tone = F.col("channel").between(TONE0, TONE0 + 2) & (F.size(bends) >= 4)
    wobbles = F.when(tone, F.exists(steps, lambda d: d > 0) & F.exists(steps, lambda d: d < 0)).otherwise(F.lit(False))
    noise = (F.col("channel") == NOISE) & F.col("noise_mode").isNotNull()
    return {
        "VIB": fm & lfo & (at(3) > 0) | wobbles, "TRE": fm & lfo & (at(2) > 0) & of_operators(10, lambda x: x != 0), "SSG": fm & of_operators(9, lambda x: x.bitwiseAND(8) != 0),
        "L": fm & (at(4) == 1), "R": fm & (at(4) == 2), "PERIO": noise & (F.col("noise_mode").bitwiseAND(4) == 0), "CH2": noise & (F.col("noise_mode").bitwiseAND(3) == 3),
    }


def mode_ranges(notes: DataFrame, lfo_on: Column | None = None) -> DataFrame:
    """``track_id, channel, mode, ranges``: starts and ends of the notes that have a mode, in order; a null column counts as not on."""
    on = modes(lfo_on)
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for m, c in on.items()]), lambda m: m.isNotNull())
    rows = notes.select("track_id", "channel", F.explode(found).alias("mode"), F.struct(F.col("sample_on").alias("on"), F.col("sample_off").alias("off")).alias("r"))
    return rows.groupBy("track_id", "channel", "mode").agg(F.array_sort(F.collect_list("r")).alias("ranges"))
