"""The two older encodings of notes, without hardware states: voices in full or by a library, a finer or a coarser grid.

Version 6 shares the layout of score.py: voices are forty tokens (no SSG-EG), times go to the nearest of
sixteen places in a bar, and each bar that passes is a token. Version 4 has a layout of its own: voices
are entries of a library, times go down to the place before, and a jump over bars is one token.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.operators import library, score, sequence
from seqmill.operators.chips import DRUM, NOISE, TONE0


@dataclass(frozen=True)
class Layout:
    """First token ids."""

    tempo: int
    key: int
    bar: int
    beat: int
    fm: int
    dac: int
    psg: int
    role: int
    on: int
    off: int
    pitch: int
    velocity: int
    drum: int
    noise: int
    composer: int
    unknown_composer: int
    meters: tuple[tuple[int, int], ...]
    voice: int | None = None  # entries of a voice library


V6 = Layout(4, 185, 213, 214, 231, 237, 238, 241, 376, 377, 379, 467, 483, 491, 492, 620, ((4, 209), (3, 210), (6, 211), (2, 212)))
V4 = Layout(4, 20, 48, 49, 66, 72, 73, 76, 211, 212, 214, 302, 318, 326, 327, 455, ((4, 44),), 83)


def _channel(layout: Layout, channel: Column) -> Column:
    return F.when(channel < 6, layout.fm + channel).when(channel == DRUM, layout.dac).when(channel.between(TONE0, TONE0 + 2), layout.psg + channel - TONE0).cast("int")


def _places(layout: Layout, sample: Column, tempo: Column, beats: Column) -> tuple[Column, Column]:
    """Bar and place in it."""
    length = score.RATE * 60.0 / tempo * beats
    bar = F.floor(sample / length)
    place = (sample - bar * length) / (length / 16)
    if layout is V4:
        return bar.cast("long"), F.least(F.floor(place), F.lit(15)).cast("long")
    near = F.floor(place + 0.5)
    return F.when(near >= 16, bar + 1).otherwise(bar).cast("long"), F.when(near >= 16, 0).otherwise(near).cast("long")


def encode(notes: DataFrame, tracks: DataFrame, roles: DataFrame, drums: DataFrame | None = None, layout: Layout = V6, voices: DataFrame | None = None) -> DataFrame:
    """``track_id, tokens`` from unsplit notes; the other tables as score.encode() has them.

    Version 4 wants ``tempo`` in ``tracks`` (its grid goes by the tempo found, not by the whole one) and
    ``voices``, a voice_library(); it has no meter but four, and no game, context or loop.
    """
    old = layout is V4
    none = F.array().cast("array<int>")
    patches = library.final_patches(notes) if old else score.dominant_patches(notes)
    role = (F.array_position(F.array(*map(F.lit, score.ROLES)), F.col("role")) - 1).cast("int")
    if old:
        entries = library.to_library(patches.withColumn("k", F.struct("track_id", "channel")), "k", "patch", voices).select("k.track_id", "k.channel", "lib")
        listed = roles.join(entries, ["track_id", "channel"], "left")
        voice = F.array((layout.voice + F.coalesce("lib", F.lit(0))).cast("int"))
    else:
        listed = roles.join(patches, ["track_id", "channel"], "left")
        silent = F.array(*[F.lit(x) for x in [score.ALG, score.P8, score.P4, score.FMS] + [b + (127 if b == score.TL else 0) + (1 if k == 6 else 0) for _ in range(4) for k, b in enumerate(score.OP_BASES[:9])]])
        voice = F.when(F.col("channel") < 6, F.coalesce(score.patch_tokens(F.col("patch"), False), silent)).otherwise(none)
    own = _channel(layout, F.col("channel"))
    entry = F.concat(F.array(own, layout.role + role), voice)
    channels = listed.where(own.isNotNull()).groupBy("track_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("channel", entry.alias("t")))), lambda x: x["t"])).alias("channels"))
    meter = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in layout.meters for x in kv]), F.col("beats")), F.lit(layout.meters[0][1]))
    head = [F.lit(score.BOS), layout.tempo + F.col("bpm") - 60, layout.key + F.when(F.col("is_minor"), 12).otherwise(0) + F.col("key_index"), meter, F.coalesce("composer", F.lit(layout.unknown_composer))]
    if not old:
        head += [F.coalesce("game", F.lit(score.UNK_GAME)), F.coalesce("context", F.lit(score.CONTEXTS["level"])), F.when(F.col("has_loop"), score.LOOP).otherwise(score.NO_LOOP)]
    # the stream; ends of drums and noise put out no token, but move the grid on
    slots = notes.join(drums.select("dac_sample_id", "slot"), "dac_sample_id", "left") if drums is not None else notes.withColumn("slot", F.lit(0))
    ch, loud = F.col("channel"), ~F.col("channel").isin(DRUM, NOISE)
    sound = (
        F.when(ch == DRUM, F.array(layout.drum + F.coalesce("slot", F.lit(0)))).when(ch == NOISE, F.array(F.lit(layout.noise)))
        .when(F.col("pitch").between(score.LOW_PITCH, score.LOW_PITCH + score.PITCHES - 1), F.array(own, F.lit(layout.on), layout.pitch + F.col("pitch") - score.LOW_PITCH, layout.velocity + F.col("velocity"))).otherwise(none)
    )
    numbered = slots.withColumn("n", F.row_number().over(W.partitionBy("track_id").orderBy("sample_on", "channel", "emit")))
    ons = numbered.select("track_id", F.col("sample_on").alias("sample"), F.lit(1).alias("prio"), "n", sound.alias("tokens"))
    offs = numbered.where("sample_off IS NOT NULL").select("track_id", F.col("sample_off").alias("sample"), F.lit(0).alias("prio"), "n", F.when(loud, F.array(own, F.lit(layout.off))).otherwise(none).alias("tokens"))
    stream = ons.unionByName(offs).join(tracks.select("track_id", (F.col("tempo") if old else F.col("bpm").cast("double")).alias("tempo"), (F.lit(4) if old else F.col("beats")).alias("beats")), "track_id")
    bar, place = _places(layout, F.col("sample"), F.col("tempo"), F.col("beats"))
    marked = sequence.grid_marks(stream.withColumns({"bar": bar, "beat": place}), ["track_id"], ["sample", "prio", "n"], "bar", "beat")
    bars = F.least(F.col("bars"), F.lit(1)) if old else F.col("bars")
    marks = F.concat(F.array_repeat(F.lit(layout.bar), bars.cast("int")), F.when(F.col("new_beat"), F.array((layout.beat + F.col("beat")).cast("int"))).otherwise(none))
    body = marked.groupBy("track_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sample", "prio", "n", F.concat(marks, "tokens").alias("t")))), lambda x: x["t"])).alias("body"))
    joined = tracks.join(channels, "track_id", "left").join(body, "track_id", "left")
    return joined.select("track_id", F.concat(F.array(*[x.cast("int") for x in head]), F.coalesce("channels", none), F.coalesce("body", none), F.array(F.lit(score.EOS))).alias("tokens"))
