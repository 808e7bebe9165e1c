"""Queries over made notes: each event is a note, and what is written, encoded and counted of them is known.

A user is a track. An event starts a note on the channel that its value says, at the user's clock; the
note ends where the next one of the channel begins, or a frame after the last event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.functions import music
from seqmill.functions.text import event_key, safe_file_name
from seqmill.operators import align, analysis, augment, chips, corpus, diff, library, musicality, report, score, score_plain, sections, synth, tokens, tracks
from seqmill.plans.logs import EV, events
from seqmill.plans.registry import query
from seqmill.session import stored, table
from seqmill.sources import flat, vgm

#: A note's channel by its value: six FM channels, three tones, noise, drums.
CHANNELS = (0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 6)

SCORE = f"""{EV}, cl AS (SELECT *, CAST(sum(735 * (1 + event_id % 5)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS clock,
    [{", ".join(map(str, CHANNELS))}][cents % 11 + 1] AS channel FROM ev),
  sc AS (SELECT event_id, 'user' || user_id AS track_id, CAST(channel AS INTEGER) AS channel, clock AS sample_on,
    coalesce(lead(clock) OVER (PARTITION BY user_id, channel ORDER BY event_id), max(clock) OVER (PARTITION BY user_id) + 735) AS sample_off,
    CASE WHEN channel NOT IN (6, 10) THEN 48 + CAST(cents % 36 AS INTEGER) END AS pitch, CAST(cents % 100 AS INTEGER) AS tl, CAST(cents % 8 AS INTEGER) AS alg, CAST(cents % 4 AS INTEGER) AS pan, CAST(1 + cents % 15 AS INTEGER) AS loud,
    CASE WHEN channel = 6 THEN cents % 20 END AS drum, CASE WHEN channel = 10 THEN CAST(cents % 8 AS INTEGER) ELSE 7 END AS noise_mode FROM cl)"""
#: Velocity of so many decibels below the loudest.
LOUD = "CASE WHEN {0} >= 60 THEN 0 ELSE CAST(greatest(0, least(15, floor(15 * (1 - {0} / 60) + 0.5))) AS INTEGER) END"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made notes, in NOTE_SCHEMA."""
    e = events(spark, sf_dir)
    w = W.partitionBy("user_id").orderBy("event_id")
    channel = F.element_at(F.array(*map(F.lit, CHANNELS)), (F.col("cents") % 11 + 1).cast("int"))
    e = e.withColumns({"clock": F.sum(735 * (1 + F.col("event_id") % 5)).over(w), "channel": channel})
    ends = F.coalesce(F.lead("clock").over(W.partitionBy("user_id", "channel").orderBy("event_id")), F.max("clock").over(W.partitionBy("user_id")) + 735)
    cents, ch = F.col("cents"), F.col("channel")
    tl = (cents % 100).cast("int")
    operator = [tl, *map(F.lit, (31, 1, 2, 3, 4, 1, 0, 0, 0, 0))]
    patch = F.array(*[x.cast("int") for x in (cents % 8, F.lit(3), F.lit(0), F.lit(0), cents % 4, *operator * 4)])
    pitched = ~ch.isin(chips.DRUM, chips.NOISE)
    none = {"bends": "array<struct<sample: long, a: int, b: int>>", "levels": "array<struct<sample: long, tl: array<int>>>", "volumes": "array<struct<sample: long, a: int>>", "pans": "array<struct<sample: long, a: int>>"}
    return e.select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("track_id"), F.col("event_id").cast("int").alias("emit"), ch.alias("channel"), F.when(pitched, 48 + (cents % 36).cast("int")).alias("pitch"), (1 + cents % 15).cast("int").alias("velocity"),
        F.col("clock").alias("sample_on"), ends.alias("sample_off"), F.when(ch < 6, patch).alias("patch"), F.when(ch == chips.DRUM, cents % 20).alias("dac_sample_id"), F.when(ch == chips.NOISE, (cents % 8).cast("int")).otherwise(7).alias("noise_mode"),
        *[F.array().cast(t).alias(c) for c, t in none.items()],
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the made tracks: their length, and a loop over the last third for every second of them."""
    n = notes(spark, sf_dir).groupBy("track_id").agg(F.max("sample_off").alias("total_samples"))
    loops = F.substring("track_id", 5, 10).cast("int") % 2 == 0
    return n.select("track_id", "total_samples", (F.col("total_samples") / 44100).alias("seconds"), F.when(loops, F.floor(F.col("total_samples") / 3)).otherwise(0).cast("long").alias("loop_samples"), F.lit(None).cast("string").alias("error"))


@query(f"""WITH {SCORE} SELECT track_id, channel, pitch, CASE WHEN channel = 10 OR channel BETWEEN 7 AND 9 THEN {LOUD.format('(2 * (15 - loud))')} ELSE {LOUD.format('(0.75 * tl)')} END AS velocity, sample_on, sample_off,
  CASE WHEN channel < 6 THEN alg END AS algorithm, CASE WHEN channel < 6 THEN tl END AS level, CASE WHEN channel < 6 THEN pan END AS pan, noise_mode FROM sc WHERE channel <> 6""")
def log_synth(spark, sf_dir):
    """Notes to register writes, to bytes, to writes, to notes: all channels of both chips come back."""
    back = chips.decode_notes(vgm.read_events(synth.synthesise(notes(spark, sf_dir).where(F.col("channel") != chips.DRUM))))
    at = lambda k: F.when(F.col("channel") < 6, F.element_at("patch", k + 1))
    return back.select("track_id", "channel", "pitch", "velocity", "sample_on", "sample_off", at(0).alias("algorithm"), at(5).alias("level"), at(4).alias("pan"), "noise_mode")


DRUMS = f"""{SCORE}, dc AS (SELECT drum AS dac_sample_id, count(*) AS n FROM sc WHERE drum IS NOT NULL GROUP BY 1),
  sl AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, dac_sample_id) - 1 AS INTEGER) AS slot FROM dc QUALIFY slot < 8)"""


@query(f"WITH {DRUMS} SELECT dac_sample_id, n, slot FROM sl")
def drum_dictionary(spark, sf_dir):
    return library.drum_slots(notes(spark, sf_dir))


@query(f"""WITH {DRUMS} SELECT track_id, sample_on, coalesce(slot, 0) AS slot FROM sc LEFT JOIN sl ON dac_sample_id = drum WHERE channel = 6""")
def drum_slots(spark, sf_dir):
    """The slot of each drum hit in the encoded order of hits: unknown samples are slot 0."""
    n = notes(spark, sf_dir)
    return n.where(F.col("channel") == chips.DRUM).join(corpus.small(library.drum_slots(n).select("dac_sample_id", "slot")), "dac_sample_id", "left").select("track_id", "sample_on", F.coalesce("slot", F.lit(0)).alias("slot"))


@query(f"""WITH {SCORE}, d AS (SELECT *, sample_off - sample_on AS len FROM sc), g AS (SELECT track_id, channel, count(*) AS notes, min(pitch) AS lowest, max(pitch) AS highest, list_sort(list(len)) AS l,
    count(DISTINCT CASE WHEN channel < 6 THEN alg * 1000 + tl * 10 + pan END) AS voices FROM d GROUP BY 1, 2),
  m AS (SELECT *, l[len(l) // 2 + 1] AS median FROM g), b AS (SELECT *, list_filter([0.5, 1.0, 2.0], lambda x: 60 * x * 44100 / median BETWEEN 40 AND 300) AS beats FROM m)
  SELECT track_id, CASE WHEN channel < 6 THEN 'FM' || channel + 1 WHEN channel = 6 THEN 'DAC' WHEN channel = 10 THEN 'NOISE' ELSE 'PSG' || channel - 6 END AS channel, notes, lowest, highest, CAST(median AS BIGINT) AS median, voices, CAST(0 AS BIGINT) AS fades,
  CASE WHEN len(beats) > 0 THEN array_to_string(list_transform(beats, lambda x: CAST(CAST(round_even(60 * x * 44100 / median, 0) AS INTEGER) AS VARCHAR)), ' / ') END AS tempi FROM b""")
def track_summary(spark, sf_dir):
    return report.track_summary(notes(spark, sf_dir))


@query(f"""WITH {SCORE}, h AS (SELECT track_id, max(sample_off) / 44100 AS seconds FROM sc GROUP BY 1), c AS (SELECT track_id, count(DISTINCT channel) FILTER (pitch IS NOT NULL AND channel < 6) AS channels, count(DISTINCT pitch) AS pitches FROM sc GROUP BY 1)
  SELECT track_id, CASE WHEN seconds < 8 THEN 'short' WHEN channels < 2 THEN 'few_channels' WHEN pitches < 5 THEN 'few_pitches' END AS reason FROM h JOIN c USING (track_id)""")
def track_gate(spark, sf_dir):
    return tracks.gate(notes(spark, sf_dir), headers(spark, sf_dir))


LOOPS = "hd AS (SELECT track_id, max(sample_off) AS total, CASE WHEN CAST(substr(track_id, 5) AS INTEGER) % 2 = 0 THEN max(sample_off) // 3 ELSE 0 END AS loop FROM sc GROUP BY 1)"


@query(f"""WITH {SCORE}, {LOOPS} SELECT track_id, channel, sample_on, sample_off FROM sc UNION ALL
  SELECT track_id, channel, sample_on + loop, sample_off + loop FROM sc JOIN hd USING (track_id) WHERE loop > 0 AND sample_on >= total - loop""")
def loop_unroll(spark, sf_dir):
    return synth.unroll_loop(notes(spark, sf_dir), headers(spark, sf_dir)).select("track_id", "channel", "sample_on", "sample_off")


@query(f"""WITH {SCORE}, p AS (SELECT track_id, max(sample_off) // 4 AS until FROM sc GROUP BY 1), k AS (SELECT track_id, sample_on - until AS sample_on, sample_off - until AS sample_off FROM sc JOIN p USING (track_id) WHERE sample_on >= until)
  SELECT track_id, count(*) AS notes, min(sample_on) AS first, max(sample_off) + 44100 AS samples FROM k GROUP BY 1""")
def prompt_cut(spark, sf_dir):
    """Notes after a prompt of a quarter of the track, and how long they last with a second's tail."""
    n = notes(spark, sf_dir)
    until = n.groupBy("track_id").agg(F.floor(F.max("sample_off") / 4).alias("until"))
    kept = synth.strip_prompt(n, until)
    counts = kept.groupBy("track_id").agg(F.count("*").alias("notes"), F.min("sample_on").alias("first"))
    return counts.join(synth.lengths(kept), "track_id").select("track_id", "notes", "first", "samples")


@query(f"""WITH {SCORE}, s AS (SELECT 'user' || user_id AS track_id, CAST(unnest([0, 1]) AS INTEGER) AS section, user_id FROM (SELECT DISTINCT user_id FROM ev)), t AS (SELECT track_id, max(sample_off) AS total FROM sc GROUP BY 1),
  b AS (SELECT track_id, section, CASE section WHEN 0 THEN 0 ELSE total // 2 END AS b, CASE section WHEN 0 THEN total // 2 ELSE total END AS e FROM s JOIN t USING (track_id))
  SELECT track_id, section, count(*) AS notes, min(sample_on) AS first FROM sc JOIN b USING (track_id) WHERE sample_on >= b AND sample_on < e GROUP BY 1, 2""")
def section_notes(spark, sf_dir):
    n, h = notes(spark, sf_dir), headers(spark, sf_dir)
    half = F.floor(F.col("total_samples") / 2)
    rhythm = h.select("track_id", F.array(F.struct(F.lit(0.0).alias("second"), F.lit(120.0).alias("tempo")), F.struct((half / 44100).alias("second"), F.lit(140.0).alias("tempo"))).alias("sections"))
    own = sections.assign(n, sections.boundaries(rhythm, h))
    return own.groupBy("track_id", "section").agg(F.count("*").alias("notes"), F.min("sample_on").alias("first"))


@query(f"""WITH {SCORE}, r AS (SELECT track_id, channel, max(sample_off) * 2 // 5 AS a, max(sample_off) * 3 // 5 AS b FROM sc GROUP BY 1, 2)
  SELECT track_id, channel, count(*) AS notes FROM sc JOIN r USING (track_id, channel) WHERE sample_off > a AND sample_on < b GROUP BY 1, 2""")
def note_overlap(spark, sf_dir):
    n = notes(spark, sf_dir)
    end = F.max("sample_off")
    ranges = n.groupBy("track_id", "channel").agg(F.floor(end * 2 / 5).alias("start"), F.floor(end * 3 / 5).alias("stop"))
    return sections.overlapping(n, ranges).groupBy("track_id", "channel").agg(F.count("*").alias("notes"))


@query(f"""WITH {SCORE}, m AS (SELECT track_id, channel, sample_on, sample_off, unnest(list_filter([CASE WHEN channel < 6 AND pan = 1 THEN 'L' END, CASE WHEN channel < 6 AND pan = 2 THEN 'R' END,
    CASE WHEN channel = 10 AND noise_mode & 4 = 0 THEN 'PERIO' END, CASE WHEN channel = 10 AND noise_mode & 3 = 3 THEN 'CH2' END], lambda x: x IS NOT NULL)) AS mode FROM sc)
  SELECT track_id, channel, mode, count(*) AS ranges, min(sample_on) AS first, CAST(sum(sample_off - sample_on) AS BIGINT) AS samples FROM m GROUP BY 1, 2, 3""")
def mode_ranges(spark, sf_dir):
    found = sections.mode_ranges(notes(spark, sf_dir))
    total = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["off"] - r["on"])
    return found.select("track_id", "channel", "mode", F.size("ranges").cast("long").alias("ranges"), F.get("ranges", F.lit(0))["on"].alias("first"), total.alias("samples"))


FINAL = f"""{SCORE}, la AS (SELECT track_id, channel, arg_max(alg, sample_on) AS alg, arg_max(tl, sample_on) AS tl, arg_max(pan, sample_on) AS pan FROM sc WHERE channel < 6 GROUP BY 1, 2),
  lc AS (SELECT alg, tl, pan, count(*) AS n FROM la GROUP BY 1, 2, 3), li AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, alg, pan, tl) - 1 AS INTEGER) AS lib FROM lc QUALIFY lib < 128)"""


@query(f"WITH {FINAL} SELECT lib, alg AS algorithm, tl AS level, pan, n FROM li")
def voice_library(spark, sf_dir):
    """The voices that most channels end with."""
    lib = library.voice_library(library.final_patches(notes(spark, sf_dir)))
    at = lambda k: F.element_at("patch", k + 1)
    return lib.select("lib", at(0).alias("algorithm"), at(5).alias("level"), at(4).alias("pan"), "n")


@query(f"""WITH {FINAL}, pt AS (SELECT DISTINCT alg, tl, pan FROM sc WHERE channel < 6), ex AS (SELECT pt.*, lib FROM pt LEFT JOIN li USING (alg, tl, pan)),
  nn AS (SELECT x.alg, x.tl, x.pan, arg_min(l.lib, round((CASE WHEN x.alg = l.alg THEN 0 ELSE 8 END) + 4 * abs(x.tl - l.tl) / 127, 9) * 1000000 + l.lib) AS near FROM pt x, li l GROUP BY 1, 2, 3)
  SELECT ex.alg AS algorithm, ex.tl AS level, ex.pan, coalesce(ex.lib, near) AS lib FROM ex JOIN nn USING (alg, tl, pan)""")
def voice_lookup(spark, sf_dir):
    """Each voice's entry in the library, or the nearest one."""
    n = notes(spark, sf_dir)
    lib = stored(library.voice_library(library.final_patches(n)), "voices")
    own = n.where("channel < 6").select("patch").distinct().withColumn("key", F.struct(F.element_at("patch", 1).alias("algorithm"), F.element_at("patch", 6).alias("level"), F.element_at("patch", 5).alias("pan")))
    return library.to_library(own, "key", "patch", lib).select("key.algorithm", "key.level", "key.pan", "lib")


@query(f"""WITH {SCORE}, v AS (SELECT DISTINCT alg, tl, pan FROM sc WHERE channel < 6), o AS (SELECT *, list_transform([tl / 127, 1.0, 1 / 31, 2 / 31, 3 / 15, 4 / 15, 1 / 15, 0.0, 0.0], lambda x: round(x, 6)) AS op FROM v)
  SELECT alg AS algorithm, tl AS level, pan, list_concat(list_transform(range(0, 8), lambda k: CASE WHEN k = alg THEN 4.0 ELSE 0.0 END), [round(3 / 7, 6)], op, op, op, op, [0.0, 0.0]) AS vec FROM o""")
def patch_vectors(spark, sf_dir):
    """47 numbers of each voice."""
    at = lambda k: F.element_at("patch", k + 1)
    own = notes(spark, sf_dir).where("channel < 6").select("patch").distinct()
    return own.select(at(0).alias("algorithm"), at(5).alias("level"), at(4).alias("pan"), F.transform(score.patch_vector(F.col("patch")), lambda x: F.round(x, 6)).alias("vec"))


@query(f"""WITH {SCORE}, c AS (SELECT track_id, channel, alg, tl, pan, count(*) AS n, min(event_id) AS first FROM sc WHERE channel < 6 GROUP BY ALL)
  SELECT track_id, channel, alg AS algorithm, tl AS level, pan FROM c QUALIFY row_number() OVER (PARTITION BY track_id, channel ORDER BY n DESC, first) = 1""")
def dominant_patch(spark, sf_dir):
    """The voice that each channel uses most; all are audible here."""
    at = lambda k: F.element_at("patch", k + 1)
    return score.dominant_patches(notes(spark, sf_dir)).select("track_id", "channel", at(0).alias("algorithm"), at(5).alias("level"), at(4).alias("pan"))


@query(f"""WITH {SCORE}, n AS (SELECT track_id, list(pitch ORDER BY event_id) AS p FROM sc WHERE pitch IS NOT NULL GROUP BY 1), s AS (SELECT track_id, p, CAST(unnest([-5, -4, -3, -2, -1, 0, 1, 2, 3, 4, 5, 6]) AS INTEGER) AS shift FROM n)
  SELECT track_id, shift, len(p) AS notes, CAST(list_sum(p) + shift * len(p) AS BIGINT) AS total FROM s WHERE list_min(p) + shift >= 50 AND list_max(p) + shift <= 84""")
def transpose_range(spark, sf_dir):
    """Shifts at which all of a track's notes stay in range."""
    own = notes(spark, sf_dir).where("pitch IS NOT NULL").groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("emit", "pitch"))), lambda x: x["pitch"]).alias("p"))
    moved = augment.transpose_checked(own, "p", low=50, high=84)
    return moved.select("track_id", "shift", F.size("p").cast("long").alias("notes"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"""WITH {SCORE}, a AS (SELECT track_id, pitch, sample_on, sample_on + (event_id * 37 % 601) - 300 AS moved, event_id FROM sc WHERE channel = 0)
  SELECT track_id, CAST(pitch AS BIGINT) AS pitch, CASE WHEN event_id % 7 <> 3 THEN sample_on END AS on_a, CASE WHEN event_id % 5 <> 2 THEN moved END AS on_b FROM a WHERE event_id % 7 <> 3 AND event_id % 5 <> 2
  UNION ALL SELECT track_id, pitch, sample_on, NULL FROM a WHERE event_id % 7 <> 3 AND event_id % 5 = 2 UNION ALL SELECT track_id, pitch, NULL, moved FROM a WHERE event_id % 7 = 3 AND event_id % 5 <> 2""")
def tolerance_match(spark, sf_dir):
    """Two versions of a channel's notes, each with some missing, matched within a tolerance."""
    n = notes(spark, sf_dir).where("channel = 0").select("track_id", F.col("pitch").cast("long").alias("pitch"), "sample_on", "emit")
    a = n.where("emit % 7 <> 3").select("track_id", "pitch", F.col("sample_on").alias("on"))
    b = n.where("emit % 5 <> 2").select("track_id", "pitch", (F.col("sample_on") + F.col("emit") * 37 % 601 - 300).alias("on"))
    return align.greedy(a, b, "track_id", 300)


@query("""WITH t AS (SELECT event_id, abs(CAST(round(value * 100) AS BIGINT)) AS c FROM events), u AS (SELECT event_id, c % 128 AS level, c % 16 AS att, 24 + c % 84 AS midi, 1 + c % 1023 AS period, 60 + (c % 3600) / 20 AS bpm, c % 8 AS alg, c % 127 AS tl FROM t)
  SELECT event_id, CAST(least(7, floor(level * 7 / 127)) AS INTEGER) AS bucket, CASE WHEN att = 15 THEN 0 ELSE CAST(floor(15 * (1 - 2 * att / 60) + 0.5) AS INTEGER) END AS psg_velocity,
    ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][midi % 12 + 1] || (midi // 12 - 1) AS name, CAST(round_even(69 + 12 * log2(3579545.0 / (32 * period) / 440), 0) AS INTEGER) AS psg_pitch,
    CAST(greatest(1, least(1023, round_even(3579545 / (32 * 440 * pow(2, (midi - 69) / 12)), 0))) AS INTEGER) AS psg_period, CAST(greatest(60, least(240, ceil(bpm - 0.5))) AS INTEGER) AS tempo,
    CASE WHEN 0.75 * tl >= 60 THEN 0 ELSE CAST(greatest(0, floor(15 * (1 - 0.75 * tl / 60) + 0.5)) AS INTEGER) END AS fm_velocity,
    'P0:' || format('{:02X}', level) || ':' || format('{:02X}', tl) AS key, regexp_replace('a b/' || midi || '.vgz', '[^A-Za-z0-9_.-]', '_', 'g') AS file FROM u""")
def chip_arithmetic(spark, sf_dir):
    """Pitches, levels, periods and names, by the functions that the decoders and encoders share."""
    c = F.abs(F.round(F.col("value") * 100).cast("long"))
    u = table(spark, sf_dir, "events").select("event_id", (c % 128).alias("level"), (c % 16).alias("att"), (24 + c % 84).alias("midi"), (1 + c % 1023).alias("period"), (60 + (c % 3600) / 20).alias("bpm"), (c % 8).alias("alg"), (c % 127).cast("int").alias("tl"))
    four = F.array(*[F.col("tl")] * 4)
    return u.select(
        "event_id", music.level_bucket(F.col("level")).alias("bucket"), music.psg_velocity(F.col("att")).alias("psg_velocity"), music.midi_name(F.col("midi")).alias("name"), music.psg_pitch(F.col("period")).alias("psg_pitch"),
        music.psg_period(F.col("midi")).alias("psg_period"), music.snap_tempo(F.col("bpm")).alias("tempo"), music.fm_velocity(F.col("alg"), four).alias("fm_velocity"), event_key(F.lit("P0"), F.col("level"), F.col("tl")).alias("key"), safe_file_name(F.concat(F.lit("a b/"), F.col("midi").cast("string"), F.lit(".vgz"))).alias("file"),
    )


@query("""WITH t AS (SELECT event_id, abs(CAST(round(value * 100) AS BIGINT)) AS c FROM events), u AS (SELECT event_id, 24 + c % 84 AS midi FROM t), f AS (SELECT event_id, midi, list_transform(range(8), lambda b: {'b': b, 'f': round_even(440 * pow(2, (midi - 69) / 12) * 144 * pow(2, 20 - b) / 7670454, 0)}) AS l FROM u),
  g AS (SELECT event_id, midi, list_filter(l, lambda x: x.f <= 2047 AND x.f > 0)[1] AS x FROM f) SELECT event_id, CAST(midi AS INTEGER) AS midi, CAST(x.b AS INTEGER) AS block, CAST(x.f AS INTEGER) AS fnum, CAST(midi AS INTEGER) AS back FROM g""")
def fm_tuning(spark, sf_dir):
    """The block with the finest F-number, the F-number, and the pitch that comes back of them."""
    c = F.abs(F.round(F.col("value") * 100).cast("long"))
    u = table(spark, sf_dir, "events").select("event_id", (24 + c % 84).cast("int").alias("midi")).withColumn("block", music.best_block(F.col("midi")))
    u = u.withColumn("fnum", music.midi_to_fnumber(F.col("midi"), F.col("block")))
    return u.select("event_id", "midi", F.col("block").cast("int").alias("block"), "fnum", music.fnumber_to_midi(F.col("fnum"), F.col("block")).alias("back"))


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made notes encoded with drums, at 120 to the minute, in C major; hardware states are left out."""
    n = notes(spark, sf_dir).withColumn("part", F.lit(0))
    heads = headers(spark, sf_dir)
    cards = heads.select("track_id", F.lit(120).alias("bpm"), F.lit(0).alias("key_index"), F.lit(False).alias("is_minor"), F.lit(4).alias("beats"), *[F.lit(None).cast("int").alias(c) for c in ("composer", "game", "context")], (F.col("loop_samples") > 0).alias("has_loop"))
    roles = n.select("track_id", "channel").distinct().withColumn("role", F.lit("UNK"))
    loops = heads.where("loop_samples > 0").select("track_id", (F.col("total_samples") - F.col("loop_samples")).alias("sample"), F.lit(-1).alias("place"), F.array(F.lit(score.LOOP_POINT)).alias("tokens"))
    return score.encode(n, loops, cards, roles, library.drum_slots(n))


@query(f"""WITH {SCORE}, {LOOPS}, c AS (SELECT track_id, count(*) FILTER (pitch IS NOT NULL) AS ons, count(*) FILTER (channel = 6) AS drums, count(*) FILTER (channel = 10) AS noise, count(DISTINCT channel) FILTER (channel <> 10) AS roles FROM sc GROUP BY 1)
  SELECT track_id, [1, 64, 185, 209, 620, 889, 890, CASE WHEN loop > 0 THEN 895 ELSE 896 END] AS head, ons, ons AS offs, drums, noise, roles, CASE WHEN loop > 0 THEN 1 ELSE 0 END AS loop_points FROM c JOIN hd USING (track_id)""")
def score_tokens(spark, sf_dir):
    """The header of each encoded track, and how many tokens of each kind it has."""
    t = _encoded(spark, sf_dir)
    n = lambda *x: F.size(F.filter("tokens", lambda y: y.isin(*x))).cast("long")
    between = lambda low, k: F.size(F.filter("tokens", lambda y: y.between(low, low + k - 1))).cast("long")
    return t.select("track_id", F.slice("tokens", 1, 8).alias("head"), n(score.NOTE_ON).alias("ons"), n(score.NOTE_OFF).alias("offs"), between(score.DAC_HIT, 8).alias("drums"), n(score.NOISE_HIT).alias("noise"), between(score.ROLE, 7).alias("roles"), n(score.LOOP_POINT).cast("int").alias("loop_points"))


@query(f"""WITH {SCORE} SELECT track_id, channel, pitch, count(*) AS notes FROM sc GROUP BY 1, 2, 3""")
def score_decode(spark, sf_dir):
    """Notes that come back of the tokens, drums and noise included, by pitch."""
    return score.decode(_encoded(spark, sf_dir)).groupBy("track_id", "channel", "pitch").agg(F.count("*").alias("notes"))


@query(f"""WITH {SCORE}, o AS (SELECT track_id, count(*) FILTER (pitch IS NOT NULL) AS original FROM sc GROUP BY 1) SELECT track_id, unnest(['v6', 'v7']) AS version, original, original AS kept, CASE WHEN original > 0 THEN CAST(100 AS DOUBLE) END AS retention FROM o""")
def roundtrip_fidelity(spark, sf_dir):
    t, old = stored(_encoded(spark, sf_dir), "encoded"), stored(_plain(spark, sf_dir, score_plain.V6), "encoded")
    return report.fidelity(notes(spark, sf_dir), {"v7": (t, score.decode(t)), "v6": (old, score.decode(old, ssg=False))}).select("track_id", "version", "original", "kept", "retention")


def _plain(spark: SparkSession, sf_dir: str, layout: score_plain.Layout) -> DataFrame:
    n = notes(spark, sf_dir)
    cards = headers(spark, sf_dir).select("track_id", F.lit(120).alias("bpm"), F.lit(110.0).alias("tempo"), F.lit(5).alias("key_index"), F.lit(True).alias("is_minor"), F.lit(4).alias("beats"), *[F.lit(None).cast("int").alias(c) for c in ("composer", "game", "context")], F.lit(False).alias("has_loop"))
    roles = n.select("track_id", "channel").distinct().withColumn("role", F.lit("LEAD"))
    voices = stored(library.voice_library(library.final_patches(n)), "voices") if layout.voice is not None else None
    return score_plain.encode(n, cards, roles, library.drum_slots(n), layout, voices)


def _stream(bar: float, place: str, jumps: str) -> str:
    """Tokens of the grid by track: bars passed and places in them, from notes in their order."""
    return f"""nu AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY sample_on, channel, event_id) AS n FROM sc),
  ro AS (SELECT track_id, sample_on AS s, 1 AS p, n FROM nu UNION ALL SELECT track_id, sample_off, 0, n FROM nu), q AS (SELECT *, floor(s / {bar}) AS b0, {place} AS t0 FROM (SELECT *, (s - floor(s / {bar}) * {bar}) / ({bar} / 16) AS r FROM ro)),
  g AS (SELECT track_id, s, p, n, CASE WHEN t0 >= 16 THEN b0 + 1 ELSE b0 END AS bar, CASE WHEN t0 >= 16 THEN 0 ELSE t0 END AS beat FROM q),
  m AS (SELECT *, bar - lag(bar, 1, -1) OVER w AS bars, lag(beat) OVER w AS before FROM g WINDOW w AS (PARTITION BY track_id ORDER BY s, p, n)),
  gr AS (SELECT track_id, sum({jumps}) AS bars, count(*) FILTER (bars > 0 OR before IS DISTINCT FROM beat) AS beats FROM m GROUP BY 1)"""


PLAIN = "SELECT track_id, {head} AS head, CAST(bars AS BIGINT) AS bars, beats, ons, CAST({size} + fm * {fm} + (roles - fm) * {other} + bars + beats + ons * 6 + drums + noise + 1 AS BIGINT) AS n FROM gr JOIN c USING (track_id)"
KINDS = "c AS (SELECT track_id, count(*) FILTER (pitch IS NOT NULL) AS ons, count(*) FILTER (channel = 6) AS drums, count(*) FILTER (channel = 10) AS noise, count(DISTINCT channel) FILTER (channel <> 10) AS roles, count(DISTINCT channel) FILTER (channel < 6) AS fm FROM sc GROUP BY 1)"


def _counted(t: DataFrame, layout: score_plain.Layout, head: int) -> DataFrame:
    rest = F.slice("tokens", head + 1, F.size("tokens"))
    n = lambda low, k=1: F.size(F.filter(rest, lambda y: y.between(low, low + k - 1))).cast("long")
    return t.select("track_id", F.slice("tokens", 1, head).alias("head"), n(layout.bar).alias("bars"), n(layout.beat, 16).alias("beats"), n(layout.on).alias("ons"), F.size("tokens").cast("long").alias("n"))


@query(f"WITH {SCORE}, {KINDS}, {_stream(88200.0, 'floor(r + 0.5)', 'bars')} " + PLAIN.format(head="[1, 64, 202, 209, 620, 889, 890, 896]", size=8, fm=42, other=2))
def score_tokens_v6(spark, sf_dir):
    """The sixth version: header, bars, places, notes and the number of all tokens."""
    return _counted(_plain(spark, sf_dir, score_plain.V6), score_plain.V6, 8)


@query(f"WITH {SCORE}, {KINDS}, {_stream(44100 * 60 / 110.0 * 4, 'least(floor(r), 15)', 'least(bars, 1)')} " + PLAIN.format(head="[1, 64, 37, 44, 455]", size=5, fm=3, other=3))
def score_tokens_v4(spark, sf_dir):
    """The fourth version, on the grid of the tempo found."""
    return _counted(_plain(spark, sf_dir, score_plain.V4), score_plain.V4, 5)


WRITES = f"""{EV}, cl AS (SELECT *, CAST(sum(735 * (1 + event_id % 5)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS clock FROM ev),
  st AS (SELECT 'user' || user_id AS track_id, event_id, clock, event_type AS k, cents, max(clock) OVER (PARTITION BY user_id) AS total FROM cl)"""


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs whose events are keys on and off, voices and pans, the LFO, and the third channel's mode."""
    e = events(spark, sf_dir)
    c = F.col("cents")
    row = lambda k, r, v: F.struct(F.lit(k).alias("k"), F.lit(vgm.WAIT if r is None else vgm.PORT0).cast("tinyint").alias("type"), F.lit(r or 0).cast("smallint").alias("register"), v.cast("int").alias("value"))
    wait = row(0, None, 735 * (1 + F.col("event_id") % 5))
    rows = (
        F.when(F.col("event_type") == "click", F.array(wait, row(1, 0x28, F.lit(0xF0)))).when(F.col("event_type") == "view", F.array(wait, row(1, 0x28, F.lit(0))))
        .when(F.col("event_type") == "error", F.array(wait, row(1, 0xB0, c % 8 * 8 + c % 5), row(2, 0xB4, c % 4 * 64 + c % 3 * 16)))
        .when(F.col("event_type") == "signup", F.array(wait, row(1, 0x22, c % 2 * 8 + c % 7))).otherwise(F.array(wait, row(1, 0x27, F.when(c % 3 == 0, 0x40).otherwise(0)), row(2, 0x90, F.when(c % 5 == 0, 8).otherwise(0))))
    )
    flat_rows = e.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("track_id"), "event_id", F.explode(rows).alias("x"))
    full = flat_rows.select("track_id", (F.col("event_id") * 4 + F.col("x.k")).alias("seq"), "x.type", "x.register", "x.value", F.lit(0).cast("long").alias("sample_pos"), F.lit(None).cast("string").alias("error"))
    return vgm.write_tracks(full)


@query(f"""WITH {WRITES} SELECT track_id, count(*) FILTER (k IN ('click', 'view', 'signup')) + 2 * count(*) FILTER (k IN ('error', 'purchase')) AS fm_writes, bool_or(k = 'signup' AND cents % 2 = 1) AS lfo, CAST(max(cents % 7) FILTER (k = 'signup' AND cents % 2 = 1) AS INTEGER) AS lfo_rate,
  false AS pms, bool_or(k = 'error' AND cents % 3 > 0) AS ams, bool_or(k = 'purchase' AND cents % 5 = 0) AS ssg_eg, bool_or(k = 'purchase' AND cents % 3 = 0) AS ch3_special, false AS dac, false AS noise,
  coalesce(list_sort(list(DISTINCT CAST(cents % 5 AS INTEGER)) FILTER (k = 'error')), []) AS algorithms, coalesce(list_sort(list(DISTINCT CAST(cents % 8 AS INTEGER)) FILTER (k = 'error')), []) AS feedbacks FROM st GROUP BY 1""")
def feature_flags(spark, sf_dir):
    return report.feature_flags(vgm.read_events(_writes(spark, sf_dir)))


FLAGS = """f AS (SELECT track_id, bool_or(k = 'signup' AND cents % 2 = 1) AS lfo, bool_or(k = 'error' AND cents % 3 > 0) AS ams, bool_or(k = 'purchase' AND cents % 5 = 0) AS ssg, bool_or(k = 'purchase' AND cents % 3 = 0) AS ch3, max(cents % 7) FILTER (k = 'signup' AND cents % 2 = 1) AS rate FROM st GROUP BY 1),
  n AS (SELECT count(*) AS n FROM f), r AS (SELECT 'flag' AS kind, 'lfo' AS value, count(*) FILTER (lfo) AS tracks FROM f UNION ALL SELECT 'flag', 'ams', count(*) FILTER (ams) FROM f UNION ALL SELECT 'flag', 'ssg_eg', count(*) FILTER (ssg) FROM f UNION ALL SELECT 'flag', 'ch3_special', count(*) FILTER (ch3) FROM f
    UNION ALL SELECT 'lfo_rate', CAST(rate AS VARCHAR), count(*) FROM f WHERE lfo GROUP BY 2 UNION ALL SELECT 'algorithm', CAST(cents % 5 AS VARCHAR), count(DISTINCT track_id) FROM st WHERE k = 'error' GROUP BY 2 UNION ALL SELECT 'feedback', CAST(cents % 8 AS VARCHAR), count(DISTINCT track_id) FROM st WHERE k = 'error' GROUP BY 2)"""


@query(f"""WITH {WRITES}, {FLAGS} SELECT kind, value, tracks, round(tracks / n, 6) AS share, CASE WHEN kind = 'flag' THEN CASE WHEN tracks / n > 0.10 THEN 'HIGH' WHEN tracks / n > 0.03 THEN 'MED' ELSE 'LOW' END END AS priority FROM r, n WHERE tracks > 0""")
def feature_report(spark, sf_dir):
    return report.feature_report(report.feature_flags(vgm.read_events(_writes(spark, sf_dir))))


@query(f"""WITH {WRITES}, sp AS (SELECT *, CASE WHEN k IN ('signup', 'purchase') THEN coalesce(lead(clock) OVER (PARTITION BY track_id, k ORDER BY event_id), total) - clock END AS span,
    last_value(CASE WHEN k = 'error' THEN cents % 8 * 8 + cents % 5 END IGNORE NULLS) OVER w AS voice, last_value(CASE WHEN k = 'error' THEN cents % 4 * 64 + cents % 3 * 16 END IGNORE NULLS) OVER w AS pan, last_value(CASE WHEN k = 'purchase' THEN CASE WHEN cents % 5 = 0 THEN 8 ELSE 0 END END IGNORE NULLS) OVER w AS ssg
    FROM st WINDOW w AS (PARTITION BY track_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
  a AS (SELECT track_id, max(total) AS total, count(*) FILTER (k = 'error' AND cents % 4 <> 3) AS pans, coalesce(max(cents % 8) FILTER (k = 'error'), 0) AS max_fb, bool_or(k = 'purchase' AND cents % 5 = 0) AS ssg,
    greatest(count(DISTINCT (coalesce(voice, 0), coalesce(pan, 192), coalesce(ssg, 0))) FILTER (k = 'click') - 1, 0) AS more, coalesce(sum(span) FILTER (k = 'signup' AND cents % 2 = 1), 0) AS lfo, coalesce(sum(span) FILTER (k = 'purchase' AND cents % 3 = 0), 0) AS ch3 FROM sp GROUP BY 1),
  f AS (SELECT track_id, round(pans / (total / 44100), 6) AS pan_rate, CAST(max_fb AS INTEGER) AS max_fb, round(more / (total / 44100), 6) AS ic_rate, CASE WHEN ssg THEN 1 ELSE 0 END AS ssg_eg, round(lfo / total, 6) AS lfo_frac, round(ch3 / total, 6) AS ch3_frac,
    pans / (total / 44100) > 1.0 OR lfo / total > 0.10 OR ch3 / total > 0.05 AS five, more / (total / 44100) > 0.5 OR ssg AS four FROM a)
  SELECT track_id, pan_rate, max_fb, ic_rate, CAST(0 AS DOUBLE) AS dac_frac, CAST(0 AS DOUBLE) AS psg_frac, ssg_eg, lfo_frac, ch3_frac, CASE WHEN five THEN 5 WHEN four THEN 4 ELSE 1 END AS cluster FROM f""")
def log_features(spark, sf_dir):
    """Eight hardware features of each log, and its profile."""
    files = stored(_writes(spark, sf_dir), "logs")
    e = vgm.read_events(files)
    f = chips.features(e, chips.decode_notes(e), vgm.read_headers(files)).withColumn("cluster", analysis.cluster())
    r = lambda c: F.round(c, 6).alias(c)
    return f.select("track_id", r("pan_rate"), F.col("max_fb").cast("int").alias("max_fb"), r("ic_rate"), r("dac_frac"), r("psg_frac"), F.col("ssg_eg").cast("int").alias("ssg_eg"), r("lfo_frac"), r("ch3_frac"), "cluster")


TOKENS = """tk AS (SELECT track_id, unnest(CASE k WHEN 'click' THEN ['P0:28:F0'] WHEN 'view' THEN ['P0:28:00'] WHEN 'error' THEN ['P0:B0:' || format('{:02X}', cents % 8 * 8 + cents % 5), 'P0:B4:' || format('{:02X}', cents % 4 * 64 + cents % 3 * 16)]
  WHEN 'signup' THEN ['P0:22:' || format('{:02X}', cents % 2 * 8 + cents % 7)] ELSE ['P0:27:' || CASE WHEN cents % 3 = 0 THEN '40' ELSE '00' END, 'P0:90:' || CASE WHEN cents % 5 = 0 THEN '08' ELSE '00' END] END) AS token FROM st)"""


@query(f"""WITH {WRITES}, {TOKENS}, c AS (SELECT token, count(*) AS n FROM tk GROUP BY 1 HAVING count(*) >= 2) SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 3 + 61 AS id FROM c""")
def event_vocabulary(spark, sf_dir):
    """Events as strings, and their dictionary by frequency."""
    return tokens.build_vocabulary(tokens.event_tokens(vgm.read_events(_writes(spark, sf_dir))))


@query(f"""WITH {WRITES}, {TOKENS}, c AS (SELECT token FROM tk GROUP BY 1 HAVING count(*) >= 2), w AS (SELECT track_id, count(*) AS waits FROM st GROUP BY 1), k AS (SELECT track_id, count(*) FILTER (c.token IS NOT NULL) AS known FROM tk LEFT JOIN c USING (token) GROUP BY 1)
  SELECT track_id, waits + known AS ids, known AS writes, waits FROM w JOIN k USING (track_id)""")
def event_roundtrip(spark, sf_dir):
    """Events to ids and back: rare ones are lost, all others and the waits come back."""
    t = stored(tokens.event_tokens(vgm.read_events(_writes(spark, sf_dir))), "tokens")
    v = tokens.build_vocabulary(t)
    ids = stored(tokens.encode(t, v), "ids")
    back = tokens.decode_events(ids, v).groupBy("track_id").agg(F.count_if(F.col("type") != vgm.WAIT).alias("writes"), F.count_if(F.col("type") == vgm.WAIT).alias("waits"))
    return ids.select("track_id", F.size("ids").cast("long").alias("ids")).join(back, "track_id")


@query(f"""WITH {WRITES}, k AS (SELECT track_id, event_id, k FROM st WHERE k IN ('click', 'view')) SELECT track_id, count(*) FILTER (k = 'click') AS ons, count(*) FILTER (k = 'view') AS offs FROM k GROUP BY 1""")
def note_token_counts(spark, sf_dir):
    t = tokens.note_tokens(vgm.read_events(_writes(spark, sf_dir)))
    return t.where(F.col("token").rlike("^CH1:(ON|OFF)")).groupBy("track_id").agg(F.count_if(F.col("token") == "CH1:ON:X").alias("ons"), F.count_if(F.col("token") == "CH1:OFF").alias("offs"))


@query("""WITH f AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS INTEGER)) AS t FROM documents), l AS (SELECT doc_id, len(t) AS n, t FROM f), p AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
  a AS (SELECT unnest(t) AS token, start + generate_subscripts(t, 1) - 1 AS position FROM p) SELECT CAST(position AS BIGINT) AS position, token FROM a WHERE position BETWEEN 5000 AND 5999""")
def flat_stretch(spark, sf_dir):
    """A stretch of all documents' word lengths as one flat array, written and read by position."""
    from seqmill.session import scratch_path

    path = scratch_path(spark, "array")
    flat.write(table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("t")), "doc_id", "t", path, vocabulary=1024)
    return flat.stretch(spark, path, 5000, 1000)


@query("""WITH t AS (SELECT event_id, user_id, CAST(event_id % 50 AS INTEGER) AS token, value - 50 AS logit FROM events), r AS (SELECT DISTINCT user_id, token FROM t WHERE event_id % 3 = 0)
  SELECT t.event_id, round(CASE WHEN r.token IS NULL THEN logit WHEN logit > 0 THEN logit / 1.3 ELSE logit * 1.3 END / 0.9, 6) AS scaled FROM t LEFT JOIN r USING (user_id, token)""")
def repetition_penalty(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 50).cast("int").alias("token"), (F.col("value") - 50).alias("logit"))
    recent = t.where("event_id % 3 = 0").select("user_id", "token")
    return corpus.penalised(t, "user_id", "logit", "token", recent, 1.3, 0.9).select("event_id", F.round("scaled", 6).alias("scaled"))


@query("""WITH l(name, id) AS (VALUES ('src3', 0), ('src1', 1), ('lost', 2)) SELECT doc_id, coalesce(l.id, 64) AS id FROM documents d LEFT JOIN l ON l.name = d.source""")
def game_lookup(spark, sf_dir):
    """Ids of names in a curated list, by the order of the list; suffixes and case do not count."""
    groups = spark.createDataFrame([([{"games": [{"gd3_name_hint": "SRC3 (Japan)"}, {"gd3_name_hint": "src1"}]}, {"games": [{"gd3_name_hint": "Src3"}, {"gd3_name_hint": " lost "}]}],)], library.CURATED)
    docs = table(spark, sf_dir, "documents").withColumn("game", F.concat(F.upper("source"), F.lit(" (Rev 2)")))
    return library.game_ids(docs, "doc_id", "game", library.curated_names(groups), 64)


@query(f"""WITH {SCORE}, a AS (SELECT track_id, channel, event_id, pitch, sample_on, sample_off FROM sc), b AS (SELECT track_id, channel, event_id, pitch + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS pitch, sample_on + event_id % 5 * 100 AS sample_on, sample_off FROM sc WHERE event_id % 11 <> 0),
  na AS (SELECT *, row_number() OVER (PARTITION BY track_id, channel ORDER BY sample_on, event_id) AS k FROM a), nb AS (SELECT *, row_number() OVER (PARTITION BY track_id, channel ORDER BY sample_on, event_id) AS k FROM b),
  p AS (SELECT na.track_id, na.channel, k, nb.sample_on - na.sample_on AS d_on, (nb.sample_off - nb.sample_on) - (na.sample_off - na.sample_on) AS d_dur, nb.pitch - na.pitch AS d_pitch FROM na JOIN nb USING (track_id, channel, k)),
  d AS (SELECT track_id, channel, round(avg(d_on), 2) AS mean_on, round(avg(d_dur), 2) AS mean_dur, max(abs(d_on)) AS max_on, list_sort(list(abs(d_on))) AS l, count(*) FILTER (d_pitch <> 0) AS pitch_mismatches FROM p GROUP BY 1, 2),
  ca AS (SELECT track_id, channel, count(*) AS count_a FROM a GROUP BY 1, 2), cb AS (SELECT track_id, channel, count(*) AS count_b FROM b GROUP BY 1, 2)
  SELECT track_id, channel, count_a, coalesce(count_b, 0) AS count_b, count_a - coalesce(count_b, 0) AS dropped, mean_on, mean_dur, max_on, l[least(CAST(floor(0.95 * len(l)) AS BIGINT), len(l) - 1) + 1] AS p95_on, pitch_mismatches FROM ca LEFT JOIN cb USING (track_id, channel) LEFT JOIN d USING (track_id, channel)""")
def channel_diff(spark, sf_dir):
    """How the channels of two versions of all tracks differ."""
    a = notes(spark, sf_dir)
    b = a.where("emit % 11 <> 0").withColumns({"pitch": F.col("pitch") + F.when(F.col("emit") % 9 == 0, 1).otherwise(0), "sample_on": F.col("sample_on") + F.col("emit") % 5 * 100})
    return diff.summary(a, b).select("track_id", "channel", "count_a", "count_b", "dropped", "mean_on", "mean_dur", "max_on", "p95_on", "pitch_mismatches")


NAMED = """nt AS (SELECT event_id, user_id, 'user' || user_id AS track_id, event_type AS k, 'FM' || (1 + cents % 3) AS ch, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][cents % 19 % 12 + 1] || (3 + cents % 19 // 12) AS note, 48 + cents % 19 AS midi FROM ev),
  no AS (SELECT *, midi - lag(midi) OVER w AS step, lag(note) OVER w || ' ' || note AS two, lag(note, 2) OVER w || ' ' || lag(note) OVER w || ' ' || note AS three FROM nt WHERE k IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id, ch ORDER BY event_id)),
  pc AS (SELECT track_id, regexp_replace(note, '[0-9]+$', '') AS c, count(*) AS n FROM no GROUP BY 1, 2), en AS (SELECT track_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS bits FROM pc GROUP BY 1),
  bi AS (SELECT track_id, count(*) FILTER (n > 1) / count(*) AS r FROM (SELECT track_id, two, count(*) AS n FROM no WHERE two IS NOT NULL GROUP BY 1, 2) GROUP BY 1), tr AS (SELECT track_id, count(*) FILTER (n > 1) / count(*) AS r FROM (SELECT track_id, three, count(*) AS n FROM no WHERE three IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
  iv AS (SELECT track_id, count(DISTINCT note) AS pitches, count(DISTINCT ch) AS channels, coalesce(count(*) FILTER (abs(step) <= 12) / nullif(count(step), 0), 0) AS melodic, coalesce(count(*) FILTER (abs(step) IN (1, 2)) / nullif(count(step), 0), 0) AS stepwise FROM no GROUP BY 1),
  wr AS (SELECT track_id, k = 'error' AS h, sum(CASE WHEN k = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM nt), wl AS (SELECT track_id, max(n) AS longest FROM (SELECT track_id, i, count(*) FILTER (h) AS n FROM wr GROUP BY 1, 2) GROUP BY 1),
  sh AS (SELECT track_id, count(*) FILTER (k IN ('click', 'purchase', 'view')) / count(*) AS notes, count(*) FILTER (k = 'error') / count(*) AS waits, count(*) FILTER (k = 'signup') / count(*) AS raw FROM nt GROUP BY 1),
  mu AS (SELECT track_id, round(CAST(pitches AS DOUBLE), 3) AS unique_pitches, round(bits, 3) AS pitch_class_entropy, round(melodic, 3) AS melodic, round(stepwise, 3) AS stepwise, round(coalesce(bi.r, 0), 3) AS bigram_repeat, round(coalesce(tr.r, 0), 3) AS trigram_repeat,
    round(CAST(channels AS DOUBLE), 3) AS channels, round(CAST(longest AS DOUBLE), 3) AS longest_waits, round(notes, 3) AS note_share, round(waits, 3) AS wait_share, round(raw, 3) AS raw_share FROM iv JOIN en USING (track_id) LEFT JOIN bi USING (track_id) LEFT JOIN tr USING (track_id) JOIN wl USING (track_id) JOIN sh USING (track_id))"""


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    c = F.col("cents")
    name = F.concat(F.lit("FM"), (1 + c % 3).cast("string"))
    note = music.midi_name(48 + c % 19)
    token = (
        F.when(F.col("event_type") == "click", F.concat_ws(":", name, F.lit("ON"), note)).when(F.col("event_type") == "purchase", F.concat_ws(":", name, F.lit("PITCH"), note))
        .when(F.col("event_type") == "view", F.concat_ws(":", name, F.lit("OFF"))).when(F.col("event_type") == "error", F.lit("WAIT:3")).otherwise(F.lit("P0:30:01"))
    )
    return musicality.measures(e.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("track_id"), F.col("event_id").alias("seq"), token.alias("token")))


@query(f"WITH {EV}, {NAMED} SELECT * FROM mu")
def musicality_measures(spark, sf_dir):
    """One row of measures for each track."""
    return _measures(spark, sf_dir)


GROUPS = "la AS (SELECT *, CASE WHEN CAST(substr(track_id, 5) AS INTEGER) % 3 = 0 THEN 'made' ELSE 'real' END AS label FROM mu), me AS (SELECT label, " + ", ".join(f"round(avg({m}), 3) AS {m}" for m in musicality.MEASURES) + " FROM la GROUP BY 1)"
GAPS = " UNION ALL ".join(f"SELECT '{m}' AS measure, r.{m} AS \"real\", o.{m} AS other FROM (SELECT * FROM me WHERE label = 'real') r, (SELECT * FROM me WHERE label = 'made') o" for m in musicality.MEASURES)


@query(f"""WITH {EV}, {NAMED}, {GROUPS}, ga AS ({GAPS}) SELECT measure, "real", other, round(other - "real", 3) AS gap, CASE measure WHEN 'pitch_class_entropy' THEN other > 0.8 * "real" WHEN 'melodic' THEN other > 0.6 WHEN 'stepwise' THEN other > 0.15 WHEN 'bigram_repeat' THEN other > 0.3 * "real" WHEN 'channels' THEN other >= 2 END AS fine FROM ga""")
def musicality_verdict(spark, sf_dir):
    """Means of two groups of tracks, their gap, and whether the second is fine."""
    rows = _measures(spark, sf_dir)
    label = F.when(F.substring("track_id", 5, 10).cast("int") % 3 == 0, "made").otherwise("real")
    return musicality.gap(musicality.means(rows.withColumn("label", label), "label"), "label", "real", "made")


LOOPS = f"""WITH {SCORE}, hd AS (SELECT track_id, max(sample_off) AS total FROM sc GROUP BY 1), lo AS (SELECT total / 44100 AS total, CASE WHEN CAST(substr(track_id, 5) AS INTEGER) % 2 = 0 THEN total // 3 ELSE 0 END / 44100 AS body FROM hd),
  lp AS (SELECT total, body, body > 0 AS has, CASE WHEN body > 0 THEN total - body ELSE 0 END AS intro FROM lo WHERE total > 1.0), lw AS (SELECT *, (total - intro) / body AS repeats, greatest(0, total - intro - body) / total AS wasted, intro + body AS one_pass FROM lp WHERE has AND body > 0.5)"""


@query(
    LOOPS
    + " UNION ALL ".join(
        [" SELECT 'looping' AS measure, CAST(count(*) AS DOUBLE) AS value FROM lw", "SELECT 'plain', CAST(count(*) AS DOUBLE) FROM lp WHERE NOT has", "SELECT 'fits', CAST(count(*) AS DOUBLE) FROM lw WHERE one_pass * 600 < 16384", "SELECT 'tokens_mean', round(avg(one_pass) * 600, 6) FROM lw"]
        + [f"SELECT '{c}_{f}', round({g}({c}), 6) FROM lw" for c in ("total", "body", "intro", "repeats", "wasted", "one_pass") for f, g in (("mean", "avg"), ("max", "max"), ("median", "median"))]
        + ["SELECT 'body ' || CASE WHEN body < 10 THEN '<10s' WHEN body < 30 THEN '<30s' WHEN body < 60 THEN '<60s' WHEN body < 120 THEN '<120s' ELSE '>120s' END, CAST(count(*) AS DOUBLE) FROM lw GROUP BY 1"]
    )
)
def loop_report(spark, sf_dir):
    """How the made tracks loop: lengths, repeats, waste, and what one pass holds."""
    h = headers(spark, sf_dir).withColumn("loop", F.col("loop_samples"))
    return report.loop_report(h).withColumn("value", F.round("value", 6))


@query(f"""WITH {SCORE}, fp AS (SELECT md5(array_to_string(list_concat([alg, 3, 0, 0, pan], flatten([[tl, 31, 1, 2, 3, 4, 1, 0, 0, 0, 0] for k in range(4)])), ',')) AS print FROM sc WHERE channel < 6) SELECT print, count(*) AS n FROM fp GROUP BY 1""")
def patch_fingerprints(spark, sf_dir):
    """Voices by fingerprint, and the notes that each has."""
    p = notes(spark, sf_dir).where("patch IS NOT NULL").groupBy(library.fingerprint(F.col("patch")).alias("print")).agg(F.count("*").alias("n"))
    return p.select(F.lower(F.hex("print")).alias("print"), "n")
