"""Notes back to register logs: actions in order, differences alone, then bytes.

Actions are rows; which of them change a register is a window over the chip's state key. Only laying
out the bytes of a track is Python's work, one track at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.functions.music import best_block, midi_to_fnumber, psg_period
from seqmill.operators.chips import DRUM, NOISE, OPERATOR_AT, TONE0
from seqmill.sources.vgm import DAC, PORT0, PORT1, PSG, WAIT, write_tracks

#: What comes first at one sample: sample playback on or off, keys off, voices, pitches, levels, keys on, drum samples.
MODE, OFF, VOICE, TUNE, LEVEL, ON, HIT = range(-1, 6)
HIT_STEP = 5  # samples of the clock from one byte of a drum sample to the next
_WRITE = "struct<prio: int, type: int, register: int, value: int>"


def _write(prio: int, kind: Column | int, register: Column | int, value: Column | int) -> Column:
    part = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(prio).alias("prio"), part(kind).cast("int").alias("type"), part(register).cast("int").alias("register"), part(value).cast("int").alias("value"))


def voice_writes(patch: Column, channel: Column) -> Column:
    """All register writes of a patch array on an FM channel."""
    port, c = F.when(channel >= 3, PORT1).otherwise(PORT0), F.pmod(channel, F.lit(3))
    at = lambda k: F.element_at(patch, k + 1)
    out = [_write(VOICE, port, 0xB0 + c, at(0) + at(1) * 8), _write(VOICE, port, 0xB4 + c, at(4) * 64 + at(2) * 16 + at(3))]
    for op, slot in enumerate(OPERATOR_AT):
        tl, ar, dr, sr, rr, sl, mul, dt, ks, ssg, am = (at(5 + 11 * op + k) for k in range(11))
        for base, value in ((0x30, mul + dt * 16), (0x40, tl), (0x50, ar + ks * 64), (0x60, dr + am * 128), (0x70, sr), (0x80, rr + sl * 16), (0x90, ssg)):
            out.append(_write(VOICE, port, base + slot + c, value))
    return F.array(*out)


def actions(notes: DataFrame) -> DataFrame:
    """``track_id, sample, prio, emit, k, type, register, value``: every write that the notes ask for."""
    ch, pitch = F.col("channel"), F.col("pitch")
    fm, tone, noise = (ch < 6) & pitch.isNotNull(), ch.between(TONE0, TONE0 + 2) & pitch.isNotNull(), ch == NOISE
    port, c = F.when(ch >= 3, PORT1).otherwise(PORT0), F.pmod(ch, F.lit(3))
    key = F.when(ch >= 3, ch + 1).otherwise(ch)
    block, psg = best_block(pitch), ch - TONE0
    fnum, period = midi_to_fnumber(pitch, block), psg_period(pitch)
    volume = 15 - F.col("velocity")
    none = F.array().cast(f"array<{_WRITE}>")
    voice = F.when(F.col("patch").isNotNull(), voice_writes(F.col("patch"), ch)).otherwise(none)
    tune = F.array(_write(TUNE, port, 0xA4 + c, block * 8 + F.shiftright(fnum, 8)), _write(TUNE, port, 0xA0 + c, fnum.bitwiseAND(255)))
    start = (
        F.when(fm, F.concat(voice, tune, F.array(_write(ON, PORT0, 0x28, key + 0xF0))))
        .when(tone, F.array(_write(TUNE, PSG, 0, 0x80 + psg * 32 + period.bitwiseAND(15)), _write(TUNE, PSG, 0, F.shiftright(period, 4)), _write(LEVEL, PSG, 0, 0x90 + psg * 32 + volume)))
        .when(noise, F.array(_write(TUNE, PSG, 0, 0xE0 + F.col("noise_mode").bitwiseAND(7)), _write(LEVEL, PSG, 0, 0xF0 + volume)))
        .otherwise(none)
    )
    stop = F.when(fm, F.array(_write(OFF, PORT0, 0x28, key))).when(tone, F.array(_write(OFF, PSG, 0, 0x9F + psg * 32))).when(noise, F.array(_write(OFF, PSG, 0, 0xFF))).otherwise(none)
    on = notes.select("track_id", F.col("sample_on").alias("sample"), "emit", F.posexplode(start).alias("k", "w"))
    off = notes.where("sample_off IS NOT NULL").select("track_id", F.col("sample_off").alias("sample"), "emit", F.posexplode(stop).alias("k", "w"))
    return on.unionByName(off).select("track_id", "sample", "emit", "k", "w.*")


def differences(acts: DataFrame) -> DataFrame:
    """Without voice writes that leave their register as it is."""
    w = W.partitionBy("track_id", "type", "register").orderBy("sample", "prio", "emit", "k")
    same = (F.col("prio") == VOICE) & F.lag("value").over(w).eqNullSafe(F.col("value"))
    return acts.withColumn("__same", F.coalesce(same, F.lit(False))).where("NOT __same").drop("__same")


def drum_hits(notes: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """Writes of the drum samples that notes ask for by ``slot``: a byte each HIT_STEP samples, until the next hit or the sample's end.

    ``sizes``: slot -> where its sample begins in the bank, and its bytes.
    """
    at, size = (F.create_map(*[F.lit(x) for k, pair in sizes.items() for x in (k, pair[i])]) for i in range(2))
    hits = notes.where((F.col("channel") == DRUM) & F.col("slot").isin(list(sizes))).select("track_id", "sample_on", "emit", "slot")
    stop = F.lead("sample_on").over(W.partitionBy("track_id").orderBy("sample_on", "emit"))
    whole = F.element_at(size, F.col("slot"))
    room = F.when(F.col("stop").isNull(), whole).otherwise(F.least(whole, F.ceil((F.col("stop") - F.col("sample_on")) / HIT_STEP)))
    played = hits.withColumn("stop", stop).withColumn("room", room.cast("int")).where("room > 0")
    steps = played.select("track_id", "sample_on", "emit", F.element_at(at, F.col("slot")).alias("at"), F.explode(F.sequence(F.lit(0), F.col("room") - 1)).alias("k"))
    row = {"k": F.lit(0), "prio": F.lit(HIT), "type": F.lit(DAC), "register": F.lit(0x2A), "value": F.lit(0), "pcm_offset": (F.col("at") + F.col("k")).cast("long")}
    return steps.select("track_id", (F.col("sample_on") + F.col("k") * HIT_STEP).alias("sample"), "emit", *[c.alias(n) for n, c in row.items()])


def with_dac_mode(acts: DataFrame) -> DataFrame:
    """Sample playback is switched on before a drum byte and off before a key-on of the sixth channel, where it is not so already."""
    drum = F.col("type") == DAC
    sixth = (F.col("prio") == ON) & (F.col("type") == PORT0) & (F.col("register") == 0x28) & (F.col("value") == 0xF6)
    state = F.when(drum, 1).when(sixth, 0)
    w = W.partitionBy("track_id").orderBy("sample", "prio", "emit", "k")
    before = F.coalesce(F.last(state, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    turns = acts.withColumns({"__s": state, "__b": before}).where("__s IS NOT NULL AND __s <> __b")
    switch = turns.select("track_id", "sample", "emit", "k", F.lit(MODE).alias("prio"), F.lit(PORT0).alias("type"), F.lit(0x2B).alias("register"), (F.col("__s") * 0x80).alias("value"))
    return acts.unionByName(switch, allowMissingColumns=True)


def synthesise(notes: DataFrame, kit: DataFrame | None = None) -> DataFrame:
    """``track_id, content``: a log of each track's notes, with the waits between its writes.

    With a drum kit (slot, pcm: a few samples) its bytes are the bank of every log, and drum notes that
    carry a ``slot`` play them.
    """
    acts, bank = differences(actions(notes)), b""
    samples = {r["slot"]: bytes(r["pcm"]) for r in kit.where("length(pcm) > 0").orderBy("slot").collect()} if kit is not None else {}
    if samples:
        sizes = {}
        for slot, pcm in samples.items():
            sizes[slot], bank = (len(bank), len(pcm)), bank + pcm
        acts = with_dac_mode(acts.unionByName(drum_hits(notes, sizes), allowMissingColumns=True))
    else:
        acts = acts.withColumn("pcm_offset", F.lit(None).cast("long"))
    w = W.partitionBy("track_id").orderBy("sample", "prio", "emit", "k")
    ordered = acts.withColumns({"seq": F.row_number().over(w) * 2, "gap": F.col("sample") - F.coalesce(F.lag("sample").over(w), F.lit(0))})
    row = lambda seq, kind, register, value, offset: F.struct(seq.alias("seq"), kind.cast("tinyint").alias("type"), register.cast("smallint").alias("register"), value.cast("int").alias("value"), offset.cast("long").alias("pcm_offset"))
    write = row(F.col("seq"), F.col("type"), F.col("register"), F.col("value"), F.col("pcm_offset"))
    wait = row(F.col("seq") - 1, F.lit(WAIT), F.lit(0), F.col("gap"), F.lit(None))
    rows = ordered.select("track_id", F.explode(F.when(F.col("gap") > 0, F.array(wait, write)).otherwise(F.array(write))).alias("x"))
    full = rows.select("track_id", "x.*").withColumns({"sample_pos": F.lit(0).cast("long"), "error": F.lit(None).cast("string")})
    return write_tracks(full, bank)


TAIL, SHORTEST = 44_100, 441_000  # a second after the last note; ten seconds where there is none


def lengths(notes: DataFrame) -> DataFrame:
    """``track_id, samples``: a second beyond the end of the last note that has one."""
    return notes.groupBy("track_id").agg(F.coalesce(F.max(F.coalesce("sample_off", "sample_on")) + TAIL, F.lit(SHORTEST)).cast("long").alias("samples"))


def strip_prompt(notes: DataFrame, prompt: DataFrame) -> DataFrame:
    """Notes that start at or after the end of a track's prompt (``track_id, until``), moved to start there."""
    joined = notes.join(prompt.select("track_id", "until"), "track_id", "left").withColumn("until", F.coalesce("until", F.lit(0)))
    kept = joined.where("sample_on >= until")
    return kept.withColumns({"sample_on": F.col("sample_on") - F.col("until"), "sample_off": F.col("sample_off") - F.col("until")}).drop("until")


def unroll_loop(notes: DataFrame, headers: DataFrame) -> DataFrame:
    """Notes, and once more those from the loop's start on, moved by its length."""
    h = headers.where("loop_samples > 0").select("track_id", (F.col("total_samples") - F.col("loop_samples")).alias("__from"), "loop_samples")
    again = notes.join(h, "track_id").where("sample_on >= __from")
    moved = again.withColumns({"sample_on": F.col("sample_on") + F.col("loop_samples"), "sample_off": F.col("sample_off") + F.col("loop_samples")}).drop("__from", "loop_samples")
    return notes.unionByName(moved.select(*notes.columns))
