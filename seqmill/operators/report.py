"""Reports: what hardware a track uses, what a corpus uses, what a track sounds like, what an encoder keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmill.functions.music import bits
from seqmill.operators import quantiles, score
from seqmill.operators.chips import DRUM, NOISE, TONE0
from seqmill.session import stored
from seqmill.sources.vgm import PORT0, PORT1, PSG

FLAGS = ("lfo", "pms", "ams", "ssg_eg", "ch3_special", "dac", "noise")
RATE = 44100
#: LFO rates in hertz.
LFO_HZ = (3.98, 5.56, 6.02, 6.37, 6.88, 9.40, 11.75, 23.64)


def feature_flags(events: DataFrame) -> DataFrame:
    """A row for each track: which features its writes switch on, its fastest LFO, and the algorithms and feedbacks written."""
    e = events.where("error IS NULL")
    fm, reg, v = F.col("type").isin(PORT0, PORT1), F.col("register"), F.col("value")
    pan, voice = fm & reg.between(0xB4, 0xB6), fm & reg.between(0xB0, 0xB2)
    lfo = fm & (reg == 0x22) & (bits(v, 3, 1) == 1)
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return e.groupBy("track_id").agg(
        F.count_if(fm).alias("fm_writes"), any_of(lfo).alias("lfo"), F.max(F.when(lfo, bits(v, 0, 7))).alias("lfo_rate"), any_of(pan & (bits(v, 0, 7) > 0)).alias("pms"), any_of(pan & (bits(v, 4, 3) > 0)).alias("ams"),
        any_of(fm & reg.between(0x90, 0x9F) & (bits(v, 3, 1) == 1)).alias("ssg_eg"), any_of(fm & (reg == 0x27) & (bits(v, 6, 3) > 0)).alias("ch3_special"), any_of(fm & (reg == 0x2B) & (v >= 0x80)).alias("dac"),
        any_of((F.col("type") == PSG) & (v >= 0xE0)).alias("noise"), F.array_sort(F.collect_set(F.when(voice, bits(v, 0, 7)))).alias("algorithms"), F.array_sort(F.collect_set(F.when(voice, bits(v, 3, 7)))).alias("feedbacks"),
    )


def feature_report(flags: DataFrame) -> DataFrame:
    """``kind, value, tracks, share, priority``: tracks with each flag, LFO rate, algorithm and feedback, of all with FM writes.

    Flags over a tenth of the tracks are HIGH, over three hundredths MED, else LOW; the other kinds have no priority.
    """
    own = flags.where("fm_writes > 0")
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    when = lambda test, e: F.when(test, F.array(e)).otherwise(F.array().cast("array<struct<kind: string, value: string>>"))
    each = lambda kind, values: F.transform(values, lambda x: entry(kind, x.cast("string")))
    kinds = F.concat(
        F.array(entry("all", F.lit(""))), *[when(F.col(f), entry("flag", F.lit(f))) for f in FLAGS], when(F.col("lfo"), entry("lfo_rate", F.col("lfo_rate").cast("string"))),
        each("algorithm", "algorithms"), each("feedback", "feedbacks"),
    )
    counts = own.select(F.explode(kinds).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("tracks"))
    total = counts.where("kind = 'all'").select(F.col("tracks").alias("total"))
    joined = counts.where("kind <> 'all'").join(F.broadcast(total))  # one row
    share = F.col("tracks") / F.col("total")
    return joined.select("kind", "value", "tracks", F.round(share, 6).alias("share"), F.when(F.col("kind") == "flag", F.when(share > 0.10, "HIGH").when(share > 0.03, "MED").otherwise("LOW")).alias("priority"))


def channel_name(channel: Column) -> Column:
    return (
        F.when(channel < 6, F.concat(F.lit("FM"), (channel + 1).cast("string"))).when(channel == DRUM, "DAC").when(channel == NOISE, "NOISE").otherwise(F.concat(F.lit("PSG"), (channel - TONE0 + 1).cast("string")))
    )


def bpm_guess(samples: Column) -> Column:
    """Tempi from 40 to 300 at which a note of so many samples is half a beat, one or two, joined; null for none or no length."""
    tempi = F.filter(F.transform(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0)), lambda b: 60 * b * RATE / samples), lambda t: t.between(40, 300))
    return F.when((samples > 0) & (F.size(tempi) > 0), F.array_join(F.transform(tempi, lambda t: F.bround(t).cast("int").cast("string")), " / "))


def track_summary(notes: DataFrame) -> DataFrame:
    """A row for each channel that plays: notes, pitch range, the upper median of durations, voices, notes that fade, tempo guess."""
    length = F.col("sample_off") - F.col("sample_on")
    heard = F.array_sort(F.collect_list(F.when(length > 0, length)))  # a channel of one file
    rows = notes.groupBy("track_id", "channel").agg(
        F.count("*").alias("notes"), F.min("pitch").alias("lowest"), F.max("pitch").alias("highest"), heard.alias("lengths"), F.countDistinct("patch").alias("voices"), F.count_if(F.size("levels") > 0).alias("fades"),
    )
    median = F.coalesce(F.get("lengths", F.floor(F.size("lengths") / 2).cast("int")), F.lit(0))
    return rows.select("track_id", channel_name(F.col("channel")).alias("channel"), "notes", "lowest", "highest", median.alias("median"), "voices", "fades", bpm_guess(median).alias("tempi"))


def hardware_tokens(sequences: DataFrame) -> DataFrame:
    """Tokens of hardware states in each encoded track."""
    t = F.col("tokens")
    n = lambda low, high: F.size(F.filter(t, lambda x: x.between(low, high))).cast("long")
    return sequences.select(
        "track_id", n(min(score.PAN.values()), max(score.PAN.values())).alias("pan"), n(score.LFO_ON, score.LFO_ON + 7).alias("lfo"), n(score.CH3 + 1, score.CH3 + 1).alias("ch3_special"),
        n(score.DAC_STATE + 1, score.DAC_STATE + 1).alias("dac"), n(score.LOOP_POINT, score.LOOP_POINT).alias("loop_point"), n(score.CHANGE, score.CHANGE).alias("instrument_change"),
    )


def fidelity(original: DataFrame, versions: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``track_id, version, original, kept, retention, tokens, seconds``: what each encoder's tokens give back.

    ``original``: notes; ``versions``: name -> (sequences, notes decoded from them). Counted are notes
    with a pitch off the drum channel; a track that an encoder leaves out has no tokens and no seconds.
    """
    pitched = F.col("pitch").isNotNull() & (F.col("channel") != DRUM)
    want = original.groupBy("track_id").agg(F.count_if(pitched).alias("original"))
    out = None
    for name, (sequences, notes) in versions.items():
        own = notes.groupBy("track_id").agg(F.count_if(pitched).alias("kept"), (F.max(F.coalesce("sample_off", "sample_on")) / RATE).alias("seconds"))
        rows = want.join(sequences.select("track_id", F.size("tokens").cast("long").alias("tokens")), "track_id", "left").join(own, "track_id", "left")
        rows = rows.select("track_id", F.lit(name).alias("version"), "original", F.coalesce("kept", F.lit(0)).alias("kept"), F.round(100 * F.coalesce("kept", F.lit(0)) / F.nullif("original", F.lit(0)), 3).alias("retention"), "tokens", F.round("seconds", 6).alias("seconds"))
        out = rows if out is None else out.unionByName(rows)
    return out


def split_counts(files: DataFrame, encoded: DataFrame, sequences: DataFrame) -> DataFrame:
    """``split, files, encoded_files, sequences, tokens``.

    ``files``: track_id, split; ``encoded``: track_id of what could be encoded; ``sequences``: split, tokens.
    """
    done = files.join(encoded.select("track_id").distinct(), "track_id", "left_semi").groupBy("split").agg(F.count("*").alias("encoded_files"))
    sizes = sequences.groupBy("split").agg(F.count("*").alias("sequences"), F.sum(F.size("tokens")).cast("long").alias("tokens"))
    return files.groupBy("split").agg(F.count("*").alias("files")).join(done, "split", "left").join(sizes, "split", "left").na.fill(0)


def is_effect(has_notes: Column, seconds: Column) -> Column:
    """No note at all, or under five seconds."""
    return ~F.coalesce(has_notes, F.lit(False)) | F.coalesce(seconds < 5, F.lit(True))


def register_name(kind: Column, register: Column) -> Column:
    """What a register of the FM chip is for, with the channel or operator it is of."""
    slot = F.concat(F.lit("_"), (F.floor(register % 16 / 4) + 1).cast("string"), F.lit("_"), (register % 4 + 1 + F.when(kind == PORT1, 3).otherwise(0)).cast("string"))
    of_channel = F.concat(F.lit("_"), (register % 4 + 1 + F.when(kind == PORT1, 3).otherwise(0)).cast("string"))
    names = {0x22: "LFO", 0x24: "TIMER_A_HIGH", 0x25: "TIMER_A_LOW", 0x26: "TIMER_B", 0x27: "CH3_MODE", 0x28: "KEY", 0x2A: "DAC", 0x2B: "DAC_ENABLE"}
    operator = ("DT_MUL", "TL", "KS_AR", "AM_DR", "SR", "SL_RR", "SSG_EG")
    channel = {0xA0: "FNUM_LOW", 0xA4: "BLOCK_FNUM_HIGH", 0xB0: "FB_ALG", 0xB4: "PAN_AMS_FMS"}
    out = F.concat(F.lit("REG_"), F.format_string("%02X", register.cast("int")))
    for base, name in channel.items():
        out = F.when(register.between(base, base + 2), F.concat(F.lit(name), of_channel)).otherwise(out)
    for k, name in enumerate(operator):
        out = F.when(register.between(0x30 + 16 * k, 0x3F + 16 * k) & (register % 4 != 3), F.concat(F.lit(name), slot)).otherwise(out)
    for r, name in names.items():
        out = F.when((kind == PORT0) & (register == r), name).otherwise(out)
    return F.when(kind == PSG, "PSG").when(kind.isin(PORT0, PORT1), out)


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", 100.0 * share)


def milliseconds(samples: Column, signed: bool = False) -> Column:
    return F.format_string("%+.1f ms" if signed else "%.1f ms", samples * (1000.0 / RATE))


#: Seconds that a loop and a track must exceed, tokens a second by estimate, and tokens of a window.
LEAST_LOOP, LEAST_TRACK, TOKEN_RATE, WINDOW = 0.5, 1.0, 600, 16_384
LOOP_BOUNDS = (10, 30, 60, 120)


def loop_report(headers: DataFrame) -> DataFrame:
    """``measure, value``: how many tracks loop, and for those lengths, repeats, wasted shares and what one pass would hold.

    ``headers``: total_samples, loop_samples, loop (null or 0: none). A track is its begin and its loop
    once; what goes beyond that is wasted. Means and medians over no track are null.
    """
    total, body = F.col("total_samples") / RATE, F.coalesce("loop_samples", F.lit(0)) / RATE
    has = F.coalesce("loop", F.lit(0)) != 0
    h = headers.select(has.alias("has"), total.alias("total"), body.alias("body"), F.when(has, total - body).otherwise(0.0).alias("intro")).where(F.col("total") > LEAST_TRACK)
    looped = F.col("has") & (F.col("body") > LEAST_LOOP)
    counted = h.where(looped | ~F.col("has"))
    marked = stored(
        counted.select(
            looped.alias("looped"), "total", "body", "intro", F.try_divide(F.col("total") - F.col("intro"), "body").alias("repeats"),
            (F.greatest(F.lit(0.0), F.col("total") - F.col("intro") - F.col("body")) / F.col("total")).alias("wasted"), (F.col("intro") + F.col("body")).alias("one_pass"),
        ), "loops",
    )
    own = marked.where("looped")
    band = F.lit(f">{LOOP_BOUNDS[-1]}s")
    for bound in reversed(LOOP_BOUNDS):
        band = F.when(F.col("body") < bound, f"<{bound}s").otherwise(band)
    names = ("total", "body", "intro", "repeats", "wasted", "one_pass")
    sums = own.agg(
        F.count("*").alias("looping"), *[F.avg(c).alias(f"{c}_mean") for c in names], *[F.max(c).alias(f"{c}_max") for c in names],
        F.count_if(F.col("one_pass") * TOKEN_RATE < WINDOW).alias("fits"), (F.avg("one_pass") * TOKEN_RATE).alias("tokens_mean"),
    ).crossJoin(marked.agg(F.count_if(~F.col("looped")).alias("plain")))
    rows = F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in sums.columns])))
    out = sums.select(rows.alias("measure", "value"))
    each = own.select(F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(f"{c}_median").alias("k"), F.col(c).cast("double").alias("v")) for c in names]))).alias("measure", "value"))
    out = out.unionByName(quantiles.quantiles(each, ["measure"], "value", {"median": 0.5}).withColumnRenamed("median", "value"))
    return out.unionByName(own.groupBy(F.concat(F.lit("body "), band).alias("measure")).agg(F.count("*").cast("double").alias("value")))
