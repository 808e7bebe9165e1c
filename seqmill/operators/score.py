"""Notes and hardware changes as a token sequence with a bar and beat grid, and back.

The vocabulary is fixed. A track's sequence is built from rows that carry (sample, priority, place):
everything up to the final concatenation is DataFrame work; the grid marks between rows come from
window functions over the same order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.functions.music import CARRIERS
from seqmill.operators import sequence
from seqmill.operators.chips import DRUM, NOISE, SILENT, TONE0
from seqmill.sources.vgm import PORT0, PORT1

#: The token layout.
PAD, BOS, EOS, UNK = 0, 1, 2, 3
TEMPO, KEY, METER, BAR, BEAT = 4, 185, {4: 209, 3: 210, 6: 211, 2: 212}, 213, 214
CH_FM, CH_DAC, CH_PSG = 231, 237, 238
ROLES = ("BASS", "LEAD", "HARM", "COUNTER", "DRUMS", "PERC", "UNK")
ROLE, NOTE_ON, NOTE_OFF, PITCH, VELOCITY, DAC_HIT, NOISE_HIT = 241, 376, 377, 379, 467, 483, 491
UNK_COMPOSER, UNK_GAME, CONTEXTS, LOOP, NO_LOOP = 620, 889, {"level": 890, "boss": 891, "title": 892, "credits": 893, "gameover": 894, "unknown": 897}, 895, 896
ALG, P8, P4, FMS, TL, P32, P16, SSG = 621, 629, 637, 641, 649, 777, 809, 920
PAN, LFO_OFF, LFO_ON, CH3, DAC_STATE, LOOP_POINT, CHANGE, DOWNBEAT, HALFBEAT = {0: 898, 1: 899, 2: 900, 3: 901}, 902, 903, 911, 913, 915, 916, 917, 918
OP_BASES = (TL, P32, P32, P32, P16, P16, P16, P8, P4, SSG)  # tl ar dr sr rr sl mul dt ks ssg
OP_MASKS = (127, 31, 31, 31, 15, 15, 15, 7, 3, 15)
PATCH_TOKENS = 44
LOW_PITCH, PITCHES, DAC_SLOTS = 24, 88, 8
RATE = 44100


# -- pieces ---------------------------------------------------------------------------------------


def patch_tokens(patch: Column, ssg: bool = True) -> Column:
    """44 tokens of a patch array (five values, then eleven for each operator); 40 without SSG-EG."""
    at = lambda k: F.element_at(patch, k + 1)
    out = [ALG + at(0), P8 + at(1), P4 + at(2), FMS + at(3)]
    for op in range(4):
        out += [base + at(5 + 11 * op + k).bitwiseAND(mask) for k, (base, mask) in enumerate(zip(OP_BASES, OP_MASKS, strict=True)) if ssg or base != SSG]
    return F.array(*[x.cast("int") for x in out])


def patch_from_tokens(tokens: list[int], ssg: bool = True) -> list[int] | None:
    """The patch array of 44 tokens, or 40 without SSG-EG (pan and AM as at reset); None if they are no patch block."""
    each = 10 if ssg else 9
    if len(tokens) < 4 + 4 * each or not 0 <= tokens[0] - ALG < 8:
        return None
    out = [tokens[0] - ALG, tokens[1] - P8, tokens[2] - P4, tokens[3] - FMS, 3]
    for op in range(4):
        own = [t - base for t, base in zip(tokens[4 + each * op : 4 + each * (op + 1)], OP_BASES, strict=False)]
        out += [*own, *([] if ssg else [0]), 0]
    return out


def channel_token(channel: Column) -> Column:
    """Null for noise, which has no channel token."""
    return F.when(channel < 6, CH_FM + channel).when(channel == DRUM, CH_DAC).when(channel.between(TONE0, TONE0 + 2), CH_PSG + channel - TONE0).cast("int")


def hardware_changes(events: DataFrame, headers: DataFrame) -> DataFrame:
    """``track_id, sample, place, tokens``: pan, LFO, CH3 and DAC states where they change, and the loop point."""
    reg, value, fm0 = F.col("register"), F.col("value"), F.col("type") == PORT0
    e = events.where("error IS NULL AND type IN (0, 1)")
    pan = reg.between(0xB4, 0xB6)
    channel = reg - 0xB4 + F.when(F.col("type") == PORT1, 3).otherwise(0)
    pan_token = F.element_at(F.array(*[F.lit(PAN[k]) for k in range(4)]), F.shiftright(value, 6) + 1)
    state = (
        F.when(pan, F.array((CH_FM + channel).cast("int"), pan_token))
        .when(fm0 & (reg == 0x22), F.array(F.when(value.bitwiseAND(8) != 0, LFO_ON + value.bitwiseAND(7)).otherwise(LFO_OFF)))
        .when(fm0 & (reg == 0x27), F.array(CH3 + F.when(value.bitwiseAND(0x40) != 0, 1).otherwise(0)))
        .when(fm0 & (reg == 0x2B), F.array(DAC_STATE + F.when(value >= 0x80, 1).otherwise(0)))
    )
    kind = F.when(pan, channel).otherwise(100 + reg)
    writes = e.select("track_id", "seq", F.col("sample_pos").alias("sample"), kind.alias("kind"), state.alias("tokens")).where("tokens IS NOT NULL")
    changed = sequence.changes(writes, ["track_id", "kind"], ["seq"], "tokens")
    loops = headers.where("loop_samples > 0 AND total_samples > loop_samples").select("track_id", (F.col("total_samples") - F.col("loop_samples")).alias("sample"), F.lit(-1).alias("place"), F.array(F.lit(LOOP_POINT)).alias("tokens"))
    return changed.select("track_id", "sample", F.col("seq").alias("place"), "tokens").unionByName(loops)


def split_notes(notes: DataFrame) -> DataFrame:
    """Cut FM notes at level changes and PSG notes at volume changes, eight parts at most; parts lose their envelopes."""
    fm, tone = F.col("channel") < 6, F.col("channel").between(TONE0, TONE0 + 2)
    # mean level of the carriers of each algorithm
    def mean_tl(tl: Column) -> Column:
        out = F.lit(127.0)
        for k, ops in enumerate(CARRIERS):
            out = F.when(F.element_at("patch", 1) == k, sum((F.element_at(tl, o + 1) for o in ops), F.lit(0.0)) / len(ops)).otherwise(out)
        return out

    level = lambda tl: F.least(F.lit(7), F.floor(mean_tl(tl) * 7 / 127.0)).cast("int")
    from_level = lambda b: F.greatest(F.lit(1), F.floor((7 - b) * 15 / 7)).cast("int")
    from_volume = lambda a: F.when(a >= 15, 0).otherwise(F.greatest(F.lit(1), 15 - a)).cast("int")
    loud = lambda v: F.floor(v * 7 / 15).cast("int")
    own_tl = F.array(*[F.element_at("patch", 6 + 11 * op) for op in range(4)])
    first = F.struct(F.col("sample_on").alias("s"), F.col("velocity").alias("v"), F.when(fm, level(own_tl)).otherwise(loud(F.col("velocity"))).alias("b"))
    points = F.when(fm, F.transform("levels", lambda x: F.struct(x["sample"].alias("s"), from_level(level(x["tl"])).alias("v"), level(x["tl"]).alias("b")))).when(
        tone, F.transform("volumes", lambda x: F.struct(x["sample"].alias("s"), from_volume(x["a"]).alias("v"), loud(from_volume(x["a"])).alias("b")))
    )
    inside = F.array_sort(F.filter(points, lambda p: (p["s"] >= F.col("sample_on")) & (p["s"] < F.col("sample_off"))))
    walk = F.aggregate(inside, F.array(first), lambda acc, p: F.when(F.element_at(acc, -1)["b"] != p["b"], F.concat(acc, F.array(p))).otherwise(acc))
    parts = F.when(F.col("sample_off").isNotNull() & points.isNotNull() & (F.size(inside) > 0), F.slice(walk, 1, 8)).otherwise(F.array(first))
    cut = notes.withColumn("__parts", parts).select("*", F.posexplode("__parts").alias("part", "__p"))
    last = F.col("part") == F.size("__parts") - 1
    end = F.when(last, F.col("sample_off")).otherwise(F.try_element_at("__parts", F.col("part") + 2)["s"])
    whole = F.size("__parts") == 1
    keep = {c: F.when(whole, F.col(c)).otherwise(F.array().cast(notes.schema[c].dataType)) for c in ("bends", "levels", "volumes", "pans")}
    return cut.withColumns(keep | {"sample_off": end, "sample_on": F.col("__p.s"), "velocity": F.col("__p.v")}).drop("__parts", "__p")


def reclassify(notes: DataFrame) -> DataFrame:
    """Drum notes that carry a patch and no sample are notes of the sixth channel."""
    moved = (F.col("channel") == DRUM) & F.col("dac_sample_id").isNull() & F.col("patch").isNotNull()
    return notes.withColumn("channel", F.when(moved, 5).otherwise(F.col("channel")))


def dominant_patches(notes: DataFrame) -> DataFrame:
    """``track_id, channel, patch``: of each FM channel the most frequent audible patch, else the most frequent."""
    n = notes.where("channel < 6 AND patch IS NOT NULL").groupBy("track_id", "channel", "patch").agg(F.count("*").alias("n"), F.min("emit").alias("first"))
    tl = [F.element_at("patch", 6 + 11 * op) for op in range(4)]
    audible = F.lit(False)
    for k, ops in enumerate(CARRIERS):
        quietest = F.greatest(*[tl[o] for o in ops]) if len(ops) > 1 else tl[ops[0]]
        audible = F.when(F.element_at("patch", 1) == k, quietest < SILENT).otherwise(audible)
    w = W.partitionBy("track_id", "channel").orderBy(audible.desc(), F.col("n").desc(), "first")
    return n.withColumn("__k", F.row_number().over(w)).where("__k = 1").select("track_id", "channel", "patch")


# -- encoding -------------------------------------------------------------------------------------


def encode(notes: DataFrame, hardware: DataFrame, tracks: DataFrame, roles: DataFrame, drums: DataFrame | None = None) -> DataFrame:
    """``track_id, tokens``.

    ``tracks``: track_id, bpm (whole), key_index, is_minor, beats, composer, game (token ids), context
    (token id), has_loop. ``roles``: track_id, channel, role. ``drums``: dac_sample_id -> slot (else 0).
    ``notes`` are split and reclassified. A track without notes or hardware changes has only a header.
    """
    patches = dominant_patches(notes)
    # header
    silent = F.array(*[F.lit(x) for x in [ALG, P8, P4, FMS] + [b + (127 if b == TL else 0) + (1 if k == 6 else 0) for _ in range(4) for k, b in enumerate(OP_BASES)]])
    role = (F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1).cast("int")
    listed = roles.join(patches, ["track_id", "channel"], "left").withColumn("ch", channel_token(F.col("channel"))).where("ch IS NOT NULL")
    entry = F.concat(F.array(F.col("ch"), ROLE + role), F.when(F.col("channel") < 6, F.coalesce(patch_tokens(F.col("patch")), silent)).otherwise(F.array().cast("array<int>")))
    channels = listed.groupBy("track_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("channel", entry.alias("t")))), lambda x: x["t"])).alias("channels"))
    meter = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in METER.items() for x in kv]), F.col("beats")), F.lit(METER[4]))
    head = F.array(
        F.lit(BOS), TEMPO + F.col("bpm") - 60, KEY + F.when(F.col("is_minor"), 12).otherwise(0) + F.col("key_index"), meter,
        F.coalesce("composer", F.lit(UNK_COMPOSER)), F.coalesce("game", F.lit(UNK_GAME)), F.coalesce("context", F.lit(CONTEXTS["level"])), F.when(F.col("has_loop"), LOOP).otherwise(NO_LOOP),
    )
    # stream: (sample, priority, place) orders hardware before offs before ons
    fm = W.partitionBy("track_id", "channel").orderBy("sample_on", "emit", "part")
    played = notes.join(patches.withColumnRenamed("patch", "header_patch"), ["track_id", "channel"], "left")
    before = F.coalesce(F.lag("patch").over(fm), F.col("header_patch"))
    changes = played.where("channel < 6 AND patch IS NOT NULL").withColumn("__b", before).where(F.col("__b").isNotNull() & (F.col("__b") != F.col("patch")))
    changed = changes.select("track_id", F.col("sample_on").alias("sample"), (F.lit(1 << 30) + F.col("emit")).alias("place"), F.concat(F.array((CH_FM + F.col("channel")).cast("int"), F.lit(CHANGE)), patch_tokens(F.col("patch"))).alias("tokens"))
    hw = hardware.select("track_id", "sample", F.col("place").cast("long").alias("place"), "tokens").unionByName(changed.withColumn("place", F.col("place").cast("long"))).withColumns({"prio": F.lit(0), "mute": F.lit(False)})
    ch = channel_token(F.col("channel"))
    place = F.col("emit").cast("long") * 8 + F.col("part")
    if drums is not None:
        notes = notes.join(drums.select("dac_sample_id", "slot"), "dac_sample_id", "left")
    else:
        notes = notes.withColumn("slot", F.lit(0))
    in_range = F.col("pitch").between(LOW_PITCH, LOW_PITCH + PITCHES - 1)
    none = F.array().cast("array<int>")
    sound = (
        F.when(F.col("channel") == DRUM, F.array(DAC_HIT + F.coalesce("slot", F.lit(0))))
        .when(F.col("channel") == NOISE, F.array(F.lit(NOISE_HIT)))
        .when(in_range, F.array(ch, F.lit(NOTE_ON), PITCH + F.col("pitch") - LOW_PITCH, VELOCITY + F.col("velocity")))
        .otherwise(none)
    )
    order = F.struct("sample_on", "channel", "emit", "part")
    numbered = notes.withColumn("place", F.row_number().over(W.partitionBy("track_id").orderBy("sample_on", "channel", "emit", "part")).cast("long"))
    del order, place
    ons = numbered.select("track_id", F.col("sample_on").alias("sample"), "place", sound.alias("tokens"), F.lit(2).alias("prio"), F.lit(False).alias("mute"))
    offs = numbered.where("sample_off IS NOT NULL").select("track_id", F.col("sample_off").alias("sample"), "place", F.array(ch, F.lit(NOTE_OFF)).alias("tokens"), F.lit(1).alias("prio"), F.col("channel").isin(DRUM, NOISE).alias("mute"))
    stream = hw.unionByName(offs).unionByName(ons).where("NOT mute").join(tracks.select("track_id", "bpm", "beats"), "track_id")
    bar_len = F.lit(RATE * 60.0) / F.col("bpm") / 4.0 * (F.col("beats") * 4)
    bar = F.floor(F.col("sample") / bar_len)
    beat = F.floor((F.col("sample") - bar * bar_len) / (bar_len / 16) + 0.5)
    gridded = stream.withColumns({"bar": F.when(beat >= 16, bar + 1).otherwise(bar).cast("long"), "beat": F.when(beat >= 16, 0).otherwise(beat).cast("long")})
    marked = sequence.grid_marks(gridded, ["track_id"], ["sample", "prio", "place"], "bar", "beat")
    marks = F.concat(
        F.flatten(F.array_repeat(F.array(F.lit(BAR), F.lit(DOWNBEAT)), F.col("bars").cast("int"))),
        F.when(F.col("half_beat"), F.array(F.lit(HALFBEAT))).otherwise(none), F.when(F.col("new_beat"), F.array((BEAT + F.col("beat")).cast("int"))).otherwise(none),
    )
    body = marked.groupBy("track_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sample", "prio", "place", F.concat(marks, "tokens").alias("t")))), lambda x: x["t"])).alias("body"))
    joined = tracks.join(channels, "track_id", "left").join(body, "track_id", "left")
    return joined.select("track_id", F.concat(F.transform(head, lambda x: x.cast("int")), F.coalesce("channels", none), F.coalesce("body", none), F.array(F.lit(EOS))).alias("tokens"))


# -- decoding -------------------------------------------------------------------------------------


@dataclass
class Decoded:
    bpm: int = 120
    key_index: int = 0
    is_minor: bool = False
    beats: int = 4
    roles: dict = field(default_factory=dict)
    notes: list = field(default_factory=list)


def _channel(token: int) -> int | None:
    if CH_FM <= token < CH_FM + 6:
        return token - CH_FM
    if token == CH_DAC:
        return DRUM
    return TONE0 + token - CH_PSG if CH_PSG <= token < CH_PSG + 3 else None


def decode_tokens(tokens: list[int], ssg: bool = True) -> Decoded:
    """Notes as dicts and the header; times lie on the grid, in whole samples. ``ssg``: as in patch_tokens()."""
    out, at, n, size = Decoded(), 0, len(tokens), PATCH_TOKENS if ssg else PATCH_TOKENS - 4
    peek = lambda: tokens[at] if at < n else PAD
    if peek() == BOS:
        at += 1
    if TEMPO <= peek() < KEY:
        out.bpm, at = peek() - TEMPO + 60, at + 1
    if KEY <= peek() < KEY + 24:
        out.key_index, out.is_minor, at = (peek() - KEY) % 12, peek() - KEY >= 12, at + 1
    if peek() in METER.values():
        out.beats, at = next(k for k, v in METER.items() if v == peek()), at + 1
    for low, high in ((492, UNK_COMPOSER), (825, UNK_GAME)):
        if low <= peek() <= high:
            at += 1
    for group in (set(CONTEXTS.values()), {LOOP, NO_LOOP}):
        if peek() in group:
            at += 1
    patches: dict[int, list[int]] = {}
    while at + 1 < n and (c := _channel(tokens[at])) is not None and ROLE <= tokens[at + 1] < ROLE + len(ROLES):
        out.roles[c] = ROLES[tokens[at + 1] - ROLE]
        at += 2
        if c < 6 and (p := patch_from_tokens(tokens[at : at + size], ssg)) is not None:
            patches[c] = p
            at += size
    bar_len = max(1, int(RATE * 60.0 / out.bpm / 4.0 * (out.beats * (2 if out.beats == 6 else 4))))
    beat_len = max(1, bar_len // 16)
    bar, beat, open_notes = -1, 0, {}
    hit = lambda c, v, s: out.notes.append({"channel": c, "pitch": None, "velocity": v, "sample_on": now, "sample_off": now + beat_len, "patch": None, "slot": s})
    while at < n and tokens[at] not in (EOS, PAD):
        t, now = tokens[at], bar * bar_len + beat * beat_len
        at += 1
        if t == BAR:
            bar, beat = bar + 1, 0
        elif BEAT <= t < BEAT + 16:
            beat = t - BEAT
        elif DAC_HIT <= t < DAC_HIT + DAC_SLOTS:
            hit(DRUM, 15, t - DAC_HIT)
        elif t == NOISE_HIT:
            hit(NOISE, 12, None)
        elif (c := _channel(t)) is not None and c != DRUM and at < n:
            action = tokens[at]
            at += 1
            if action == NOTE_ON and at + 1 < n:
                pitch, velocity = tokens[at] - PITCH, tokens[at + 1] - VELOCITY
                at += 2
                if 0 <= pitch < PITCHES and 0 <= velocity < 16:
                    if c in open_notes:
                        out.notes.append(open_notes.pop(c) | {"sample_off": now})
                    open_notes[c] = {"channel": c, "pitch": pitch + LOW_PITCH, "velocity": velocity, "sample_on": now, "sample_off": None, "patch": patches.get(c), "slot": None}
            elif action == NOTE_OFF and c in open_notes:
                out.notes.append(open_notes.pop(c) | {"sample_off": now})
            elif action == CHANGE:
                if (p := patch_from_tokens(tokens[at : at + size], ssg)) is not None:
                    patches[c] = p
                at += size
    end = bar * bar_len + beat * beat_len
    out.notes += [x | {"sample_off": end} for x in open_notes.values()]
    out.notes.sort(key=lambda x: (x["sample_on"], x["channel"]))
    return out


_DECODED = "track_id string, place int, channel int, pitch int, velocity int, sample_on long, sample_off long, patch array<int>, slot int, bpm int"


def _decoded(ssg: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("track_id", pa.string()), ("place", pa.int32()), ("channel", pa.int32()), ("pitch", pa.int32()), ("velocity", pa.int32()), ("sample_on", pa.int64()), ("sample_off", pa.int64()), ("patch", pa.list_(pa.int32())), ("slot", pa.int32()), ("bpm", pa.int32())])
        for b in batches:
            for track, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                d = decode_tokens(tokens or [], ssg)
                yield pa.RecordBatch.from_pylist([{"track_id": track, "place": k, "bpm": d.bpm, **x} for k, x in enumerate(d.notes)], schema)

    return run


def decode(sequences: DataFrame, ssg: bool = True) -> DataFrame:
    """``track_id, tokens`` -> a row for each note. Null and empty sequences have none. Without ``ssg``: sequences of version 6."""
    return sequences.select("track_id", "tokens").mapInArrow(_decoded(ssg), _DECODED)


def patch_vector(patch: Column) -> Column:
    """47 numbers for comparing patches: the algorithm one-hot (times four), feedback, nine by operator, AMS and FMS, each from 0 to 1."""
    at = lambda k: F.element_at(patch, k + 1)
    hot = [F.when(at(0) == k, 4.0).otherwise(0.0) for k in range(8)]
    out = [*hot, at(1) / 7.0]
    for op in range(4):
        out += [at(5 + 11 * op + k) / float(mask) for k, mask in enumerate(OP_MASKS[:9])]
    return F.array(*out, at(2) / 3.0, at(3) / 7.0)
