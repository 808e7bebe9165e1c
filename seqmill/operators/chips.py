"""From register writes to notes: state machines of the two sound chips over a track's sorted events.

The machines keep raw registers and read a patch off them when a key goes down. A track's events pass
by once, in order, through ``mapInArrow`` over sorted partitions; what is held is the register file
and the open notes, never a track.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.functions.music import CARRIERS, CLOCK, PSG_CLOCK
from seqmill.session import small_batches
from seqmill.sources.vgm import DAC, END, PORT0, PORT1, PSG, WAIT

SILENT, LATE_PAN, ONSET_GAP, FRAME = 120, 200, 64, 735
DRUM, TONE0, NOISE = 6, 7, 10
OPERATOR_AT = (0, 8, 4, 12)  # register offset of the four operators
PATCH = ("algorithm", "feedback", "ams", "fms", "pan")  # then ten values and the AM switch for each operator
NOTE_SCHEMA = (
    "track_id string, emit int, channel int, pitch int, velocity int, sample_on long, sample_off long, patch array<int>, dac_sample_id long, noise_mode int, "
    "bends array<struct<sample: long, a: int, b: int>>, levels array<struct<sample: long, tl: array<int>>>, volumes array<struct<sample: long, a: int>>, pans array<struct<sample: long, a: int>>"
)
_NOTE_TYPE = pa.schema(
    [
        ("track_id", pa.string()), ("emit", pa.int32()), ("channel", pa.int32()), ("pitch", pa.int32()), ("velocity", pa.int32()), ("sample_on", pa.int64()), ("sample_off", pa.int64()),
        ("patch", pa.list_(pa.int32())), ("dac_sample_id", pa.int64()), ("noise_mode", pa.int32()),
        ("bends", pa.list_(pa.struct([("sample", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))), ("levels", pa.list_(pa.struct([("sample", pa.int64()), ("tl", pa.list_(pa.int32()))]))),
        ("volumes", pa.list_(pa.struct([("sample", pa.int64()), ("a", pa.int32())]))), ("pans", pa.list_(pa.struct([("sample", pa.int64()), ("a", pa.int32())]))),
    ]
)


@dataclass
class Note:
    channel: int
    sample_on: int
    pitch: int | None = None
    velocity: int = 15
    sample_off: int | None = None
    patch: list[int] | None = None
    dac_sample_id: int | None = None
    noise_mode: int = 7
    bends: list[dict] = field(default_factory=list)
    levels: list[dict] = field(default_factory=list)
    volumes: list[dict] = field(default_factory=list)
    pans: list[dict] = field(default_factory=list)


def midi(hz: float) -> int | None:
    return round(69 + 12 * math.log2(hz / 440)) if hz > 0 else None


def velocity(db: float) -> int:
    return 0 if db >= 60 else max(0, min(15, int(15 * (1 - db / 60) + 0.5)))


class FmChip:
    """Six channels of four operators; ``regs[c]`` holds the channel's registers without its number."""

    def __init__(self) -> None:
        self.regs = [bytearray(256) for _ in range(6)]
        for r in self.regs:
            r[0xB4] = 0xC0  # both sides until written
        self.open: list[Note | None] = [None] * 6
        self.down = [False] * 6
        self.dac, self.last_dac, self.last_dac_at = False, None, None

    def tl(self, c: int) -> list[int]:
        return [self.regs[c][0x40 + at] & 127 for at in OPERATOR_AT]

    def patch(self, c: int) -> list[int]:
        r = self.regs[c]
        out = [r[0xB0] & 7, r[0xB0] >> 3 & 7, r[0xB4] >> 4 & 3, r[0xB4] & 7, r[0xB4] >> 6 & 3]
        for at in OPERATOR_AT:
            x = [r[base + at] for base in range(0x30, 0xA0, 0x10)]
            # tl, ar, dr, sr, rr, sl, mul, dt, ks, ssg, am
            out += [x[1] & 127, x[2] & 31, x[3] & 31, x[4] & 31, x[5] & 15, x[5] >> 4, x[0] & 15, x[0] >> 4 & 7, x[2] >> 6, x[6] & 15, x[3] >> 7]
        return out

    def frequency(self, c: int) -> tuple[int, int]:
        r = self.regs[c]
        return (r[0xA4] & 7) << 8 | r[0xA0], r[0xA4] >> 3 & 7

    def carriers(self, c: int) -> list[int]:
        tl = self.tl(c)
        return [tl[o] for o in CARRIERS[self.regs[c][0xB0] & 7]]

    def close(self, c: int, at: int, always: bool = False) -> Iterator[Note]:
        note = self.open[c]
        if note is not None:
            if note.sample_off is None or always:
                note.sample_off = at
            self.open[c], self.down[c] = None, False
            yield note

    def write(self, port: int, reg: int, value: int, now: int) -> Iterator[Note]:
        if port == 0 and reg < 0x30:
            if reg == 0x2B:
                on = value >= 0x80
                if on and not self.dac:
                    yield from self.close(5, now, True)
                self.dac = on
            elif reg == 0x28:
                yield from self.key(value, now)
            return
        if reg & 3 == 3 or reg < 0x30 or reg > 0xB6 or 0xA8 <= reg < 0xB0:
            return
        c, reg = reg % 4 + 3 * port, reg & 0xFC
        self.regs[c][reg] = value
        note = self.open[c]
        if note is None:
            return
        if reg == 0xA0:
            fnum, block = self.frequency(c)
            if not note.bends or (note.bends[-1]["a"], note.bends[-1]["b"]) != (fnum, block):
                note.bends.append({"sample": now, "a": fnum, "b": block})
        elif reg == 0xB4:
            if now - note.sample_on <= LATE_PAN:
                note.patch[4] = value >> 6
            else:
                note.pans.append({"sample": now, "a": value >> 6})
        elif reg & 0xF0 == 0x40 and self.down[c]:
            tl = self.tl(c)
            if not note.levels or note.levels[-1]["tl"] != tl:
                note.levels.append({"sample": now, "tl": tl})
            if min(self.carriers(c)) >= SILENT:
                yield from self.close(c, now, True)

    def key(self, value: int, now: int) -> Iterator[Note]:
        if value & 3 == 3:
            return
        c = (value & 3) + (3 if value & 4 else 0)
        if value & 0xF0:
            if c == 5 and self.dac:
                return
            yield from self.close(c, now)
            fnum, block = self.frequency(c)
            pitch = midi(fnum * CLOCK / (144 * 2 ** (20 - block)))
            self.open[c], self.down[c] = Note(c, now, pitch, velocity(0.75 * min(self.carriers(c))), patch=self.patch(c)), True
        elif self.down[c]:
            self.down[c] = False
            self.open[c].sample_off = now

    def sample(self, offset: int, now: int) -> Iterator[Note]:
        if self.dac:
            if self.last_dac is None or offset != self.last_dac + 1 or now - self.last_dac_at > ONSET_GAP:
                yield Note(DRUM, now, sample_off=now + FRAME, dac_sample_id=offset)
            self.last_dac, self.last_dac_at = offset, now


class PsgChip:
    """Three tones and noise; a latched register takes the data byte after it."""

    def __init__(self) -> None:
        self.period, self.volume = [0] * 4, [15] * 4
        self.open: list[Note | None] = [None] * 4
        self.latched = (0, 0)

    def pitch(self, c: int) -> int | None:
        return midi(PSG_CLOCK / (32 * self.period[c])) if c < 3 and self.period[c] else None

    def level(self, c: int) -> int:
        return 0 if self.volume[c] >= 15 else velocity(2 * self.volume[c])

    def start(self, c: int, now: int) -> None:
        self.open[c] = Note(TONE0 + c, now, self.pitch(c), self.level(c), noise_mode=self.period[3] if c == 3 else 7)

    def close(self, c: int, now: int) -> Iterator[Note]:
        if (note := self.open[c]) is not None:
            note.sample_off, self.open[c] = now, None
            yield note

    def write(self, value: int, now: int) -> Iterator[Note]:
        if value & 0x80:
            c, kind = self.latched = value >> 5 & 3, value >> 4 & 1
            if kind:
                before, self.volume[c] = self.volume[c], value & 15
                if before == 15 and self.volume[c] < 15:
                    self.start(c, now)
                elif before < 15 and self.volume[c] == 15:
                    yield from self.close(c, now)
                elif before < 15 and self.open[c] is not None:
                    self.open[c].volumes.append({"sample": now, "a": self.volume[c]})
            else:
                self.period[c] = self.period[c] & 0x3F0 | value & 15 if c < 3 else value & 15
            return
        c, kind = self.latched
        if kind or c == 3:
            return
        self.period[c] = (value & 0x3F) << 4 | self.period[c] & 15
        note, pitch = self.open[c], self.pitch(c)
        if note is None:
            return
        if pitch is not None and pitch != note.pitch:
            yield from self.close(c, now)
            self.start(c, now)
        elif not note.bends or note.bends[-1]["a"] != self.period[c]:
            note.bends.append({"sample": now, "a": self.period[c], "b": None})


class Decoder:
    """Both chips over one track."""

    def __init__(self) -> None:
        self.fm, self.psg, self.now, self.ended = FmChip(), PsgChip(), 0, False

    def feed(self, kind: int, register: int, value: int, offset: int | None) -> Iterator[Note]:
        if self.ended:
            return
        if kind == WAIT:
            self.now += value
        elif kind in (PORT0, PORT1):
            yield from self.fm.write(kind, register, value, self.now)
        elif kind == PSG:
            yield from self.psg.write(value, self.now)
        elif kind == DAC:
            yield from self.fm.sample(-1 if offset is None else offset, self.now)
        elif kind == END:
            self.ended = True

    def finish(self) -> Iterator[Note]:
        for c in range(6):
            yield from self.fm.close(c, self.now)
        for c in range(4):
            yield from self.psg.close(c, self.now)


def decode_track(rows: Iterator[tuple]) -> list[Note]:
    """Notes of (type, register, value, pcm_offset) rows, by start, channel and order of closing, FM first."""
    d, notes = Decoder(), []
    for r in rows:
        notes += d.feed(*r)
    notes += d.finish()
    return sorted(notes, key=lambda n: (n.sample_on, n.channel))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    track, d, emit, out = None, Decoder(), 0, []

    def add(note: Note) -> None:
        nonlocal emit
        out.append({"track_id": track, "emit": emit, **note.__dict__})
        emit += 1

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("track_id", "type", "register", "value", "pcm_offset")]
        for t, kind, register, value, offset in zip(*cols, strict=True):
            if t != track:
                if track is not None:
                    for n in d.finish():
                        add(n)
                track, d, emit = t, Decoder(), 0
            for n in d.feed(kind, register, value, offset):
                add(n)
        if len(out) > 2000:
            yield pa.RecordBatch.from_pylist(out, _NOTE_TYPE)
            out = []
    if track is not None:
        for n in d.finish():
            add(n)
    if out:
        yield pa.RecordBatch.from_pylist(out, _NOTE_TYPE)


def decode_notes(events: DataFrame) -> DataFrame:
    """Event rows -> notes in NOTE_SCHEMA; ``emit`` is the order of closing within the track."""
    small_batches(events.sparkSession)
    rows = events.where("error IS NULL").select("track_id", "seq", "type", "register", "value", "pcm_offset")
    return rows.repartition("track_id").sortWithinPartitions("track_id", "seq").mapInArrow(_decode, NOTE_SCHEMA)


def features(events: DataFrame, notes: DataFrame, headers: DataFrame, count_twice: bool = False) -> DataFrame:
    """Eight hardware features by track, from one aggregate over events and one over notes.

    With ``count_twice`` active LFO and CH3 time counts double, as thresholds tuned on that expect.
    """
    from pyspark.sql import Window as W

    from seqmill.functions.music import bits

    e = events.where("error IS NULL")
    fm0, fm = F.col("type") == PORT0, F.col("type").isin(PORT0, PORT1)
    reg, value = F.col("register"), F.col("value")
    last = W.partitionBy("track_id")
    states = e.where(fm0 & reg.isin(0x22, 0x27)).select("track_id", "seq", "register", "value", "sample_pos").join(headers.select("track_id", "total_samples"), "track_id")
    span = F.coalesce(F.lead("sample_pos").over(last.partitionBy("track_id", "register").orderBy("seq")), F.col("total_samples")) - F.col("sample_pos")
    on = F.when(reg == 0x22, bits(value, 3, 1) == 1).otherwise(bits(value, 6, 3) != 0)
    active = states.withColumn("span", F.when(on, F.greatest(span, F.lit(0))).otherwise(0))
    active = active.groupBy("track_id").agg(F.sum(F.when(reg == 0x22, F.col("span"))).alias("lfo"), F.sum(F.when(reg == 0x27, F.col("span"))).alias("ch3"))
    writes = e.groupBy("track_id").agg(
        F.count_if(fm & reg.between(0xB4, 0xB6) & (bits(value, 6, 3) != 3)).alias("pans"), F.coalesce(F.max(F.when(fm & reg.between(0xB0, 0xB2), bits(value, 3, 7))), F.lit(0)).alias("max_fb"),
        F.max(F.when(fm & reg.between(0x90, 0x9F) & (bits(value, 3, 1) == 1), 1).otherwise(0)).alias("ssg_eg"),
    )
    kept = notes.groupBy("track_id").agg(F.count("*").alias("n"), F.count_if(F.col("channel") == DRUM).alias("drums"), F.count_if(F.col("channel") >= TONE0).alias("psg"))
    prints = notes.where("channel < 6").groupBy("track_id", "channel").agg((F.countDistinct("patch") - 1).alias("more")).groupBy("track_id").agg(F.sum("more").alias("more"))
    seconds = F.greatest(F.col("total_samples"), F.lit(1)) / 44100
    times = 2 if count_twice else 1
    j = headers.where("error IS NULL").select("track_id", "total_samples").join(writes, "track_id", "left").join(kept, "track_id", "left").join(prints, "track_id", "left").join(active, "track_id", "left").na.fill(0)
    return j.select(
        "track_id", (F.col("pans") / seconds).alias("pan_rate"), "max_fb", (F.col("more") / seconds).alias("ic_rate"), (F.col("drums") / F.greatest("n", F.lit(1))).alias("dac_frac"), (F.col("psg") / F.greatest("n", F.lit(1))).alias("psg_frac"),
        F.col("ssg_eg").cast("float").alias("ssg_eg"), (times * F.col("lfo") / F.greatest("total_samples", F.lit(1))).alias("lfo_frac"), (times * F.col("ch3") / F.greatest("total_samples", F.lit(1))).alias("ch3_frac"),
    )
