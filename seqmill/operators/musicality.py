"""How musical token streams are: one row of measures for each track, group means, the gap between two groups, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.functions.music import name_to_midi
from seqmill.operators import corpus, sequence

MEASURES = ("unique_pitches", "pitch_class_entropy", "melodic", "stepwise", "bigram_repeat", "trigram_repeat", "channels", "longest_waits", "note_share", "wait_share", "raw_share")
#: What a group's means must exceed, some as a share of the real group's, and channels at least.
VERDICTS = {"pitch_class_entropy": ("share", 0.8), "melodic": ("over", 0.6), "stepwise": ("over", 0.15), "bigram_repeat": ("share", 0.3), "channels": ("least", 2.0)}


def measures(tokens: DataFrame) -> DataFrame:
    """``track_id`` and MEASURES of note tokens (track_id, seq, token); tracks without a named note have no row.

    Intervals and n-grams run along a channel's notes and bends; equal n-grams of different channels count together.
    """
    part = F.split("token", ":")
    kind = F.when(part[1] == "ON", "on").when(part[1] == "PITCH", "bend").when(part[1] == "OFF", "off").when(part[0].isin("WAIT", "<WAIT"), "wait").otherwise("raw")
    t = tokens.select("track_id", "seq", kind.alias("kind"), part[0].alias("channel"), F.when(kind.isin("on", "bend"), part[2]).alias("note"))
    share = lambda *k: F.count_if(F.col("kind").isin(*k)) / F.count("*")
    whole = t.groupBy("track_id").agg(share("on", "off", "bend").alias("note_share"), share("wait").alias("wait_share"), share("raw").alias("raw_share"))
    waits = sequence.longest_run(t, ["track_id"], ["seq"], F.col("kind") == "wait").withColumnRenamed("longest", "longest_waits")
    along = W.partitionBy("track_id", "channel").orderBy("seq")
    named = t.where(F.col("note").isNotNull() & (F.col("note") != "X"))
    back = [F.lag("note", k).over(along) for k in (1, 2)]
    notes = named.withColumns({"step": name_to_midi(F.col("note")) - name_to_midi(back[0]), "two": F.concat_ws(" ", back[0], "note"), "three": F.concat_ws(" ", back[1], back[0], "note")})
    notes = notes.withColumns({"two": F.when(F.size(F.split("two", " ")) == 2, F.col("two")), "three": F.when(F.size(F.split("three", " ")) == 3, F.col("three"))})
    of_steps = lambda c: F.coalesce(F.count_if(c) / F.nullif(F.count("step"), F.lit(0)), F.lit(0.0))
    lists = notes.groupBy("track_id").agg(
        F.countDistinct("note").alias("unique_pitches"), F.countDistinct("channel").alias("channels"), of_steps(F.abs("step") <= 12).alias("melodic"), of_steps(F.abs("step").isin(1, 2)).alias("stepwise"),
        F.collect_list(F.regexp_replace("note", r"-?\d+$", "")).alias("classes"), F.collect_list("two").alias("twos"), F.collect_list("three").alias("threes"),
    )
    counted = lists.withColumns({c: corpus.tally(F.col(c)) for c in ("classes", "twos", "threes")})
    repeated = lambda c: F.coalesce(F.col(f"{c}.repeated") / F.nullif(F.col(f"{c}.distinct"), F.lit(0)), F.lit(0.0))
    own = counted.withColumns({"pitch_class_entropy": F.col("classes.bits"), "bigram_repeat": repeated("twos"), "trigram_repeat": repeated("threes")})
    return own.join(whole, "track_id").join(waits, "track_id").select("track_id", *[F.round(F.col(m).cast("double"), 3).alias(m) for m in MEASURES])


def means(rows: DataFrame, label: str) -> DataFrame:
    """``label, n`` and the mean of each measure by group."""
    return rows.groupBy(label).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 3).alias(m) for m in MEASURES])


def gap(grouped: DataFrame, label: str, real: str, other: str) -> DataFrame:
    """``measure, real, other, gap, fine`` of two groups of means(); ``fine`` is null where nothing is asked."""
    pick = lambda m, g: F.max(F.when(F.col(label) == g, F.col(m)))
    one = grouped.where(F.col(label).isin(real, other)).agg(*[f for m in MEASURES for f in (pick(m, real).alias(f"r_{m}"), pick(m, other).alias(f"o_{m}"))])
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"r_{m}").alias("real"), F.col(f"o_{m}").alias("other")) for m in MEASURES])
    flat = one.select(F.explode(rows).alias("x")).select("x.*").withColumn("gap", F.round(F.col("other") - F.col("real"), 3))
    fine = F.lit(None).cast("boolean")
    for m, (how, least) in VERDICTS.items():
        other, bound = F.col("other"), least * F.col("real") if how == "share" else F.lit(least)
        fine = F.when(F.col("measure") == m, other >= bound if how == "least" else other > bound).otherwise(fine)
    return flat.withColumn("fine", fine)
