"""Pitch, level and binning arithmetic as Column expressions. Rounding to a pitch is half to even."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK, PSG_CLOCK, RATE = 7670454, 3579545, 44100
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
FLATS = ("C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B")
#: Fixed values of note texts: their clock, and an octave scale a step above the one used elsewhere.
TEXT_CLOCK, TEXT_SCALE = 7670453, 21
#: Carrier operators of the eight algorithms.
CARRIERS = ((3,), (3,), (3,), (3,), (1, 3), (1, 2, 3), (1, 2, 3), (0, 1, 2, 3))


def hz_to_midi(hz: Column) -> Column:
    return F.when(hz > 0, F.bround(69 + 12 * F.log2(hz / 440)).cast("int")).otherwise(F.lit(-1))


def fnumber_to_midi(fnum: Column, block: Column, clock: int = CLOCK, scale: int = 20) -> Column:
    hz = fnum * F.lit(float(clock)) / (144 * F.pow(F.lit(2.0), scale - block))
    return F.when(fnum == 0, F.lit(-1)).otherwise(hz_to_midi(hz))


def midi_to_fnumber(midi: Column, block: Column, clock: int = CLOCK) -> Column:
    hz = 440 * F.pow(F.lit(2.0), (midi - 69) / 12)
    return F.greatest(F.lit(0), F.least(F.lit(2047), F.bround(hz * 144 * F.pow(F.lit(2.0), 20 - block) / clock).cast("int")))


def best_block(midi: Column, clock: int = CLOCK) -> Column:
    """The block with the largest F-number that still fits; 4 if none does."""
    hz = 440 * F.pow(F.lit(2.0), (midi - 69) / 12)
    tries = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.struct(F.bround(hz * 144 * F.pow(F.lit(2.0), 20 - b) / clock).alias("f"), (-b).alias("b")))
    return F.coalesce(-F.array_max(F.filter(tries, lambda t: (t["f"] <= 2047) & (t["f"] > 0)))["b"], F.lit(4))


def least_error(midi: Column, clock: int = TEXT_CLOCK, scale: int = TEXT_SCALE) -> Column:
    """``struct<fnum, block>`` whose frequency is nearest to the pitch's; of equal ones the lowest block; noughts if none fits."""
    hz = 440 * F.pow(F.lit(2.0), (midi - 69) / 12)

    def tried(b: Column) -> Column:
        unit = 144 * F.pow(F.lit(2.0), scale - b)
        fnum = F.bround(hz * unit / clock)
        return F.struct(F.abs(fnum * F.lit(float(clock)) / unit - hz).alias("error"), b.alias("block"), fnum.cast("int").alias("fnum"))

    fit = F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), tried), lambda t: t["fnum"].between(1, 2047))
    best = F.array_min(fit)
    return F.struct(F.coalesce(best["fnum"], F.lit(0)).alias("fnum"), F.coalesce(best["block"], F.lit(0)).alias("block"))


def midi_name(midi: Column, names: tuple[str, ...] = NAMES) -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, names)), (F.pmod(midi, F.lit(12)) + 1).cast("int")), (F.floor(midi / 12) - 1).cast("string"))


def name_to_midi(name: Column) -> Column:
    """Of names with sharps or flats."""
    tone = F.regexp_extract(name, r"^([A-G][#b]?)", 1)
    place = F.greatest(*(F.array_position(F.array(*map(F.lit, names)), tone) for names in (NAMES, FLATS))) - 1
    return (place + 12 * (F.regexp_extract(name, r"(-?\d+)$", 1).cast("int") + 1)).cast("int")


def db_to_velocity(db: Column) -> Column:
    return F.when(db >= 60, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(15), F.floor(15 * (1 - db / 60) + 0.5)))).cast("int")


def fm_velocity(algorithm: Column, tl: Column) -> Column:
    """From the loudest carrier: a step of total level is three quarters of a decibel."""
    loudest = F.lit(None).cast("int")
    for k, ops in enumerate(CARRIERS):
        loudest = F.when(algorithm == k, F.least(*[F.element_at(tl, o + 1) for o in ops]) if len(ops) > 1 else F.element_at(tl, ops[0] + 1)).otherwise(loudest)
    return db_to_velocity(loudest * 0.75)


def psg_pitch(period: Column, clock: int = PSG_CLOCK) -> Column:
    return F.when(period > 0, hz_to_midi(F.lit(float(clock)) / (32 * F.when(period > 0, period)))).otherwise(F.lit(-1))


def psg_velocity(attenuation: Column) -> Column:
    return F.when(attenuation >= 15, 0).otherwise(db_to_velocity(attenuation * 2))


def psg_period(midi: Column, clock: int = PSG_CLOCK) -> Column:
    hz = 440 * F.pow(F.lit(2.0), (midi - 69) / 12)
    return F.greatest(F.lit(1), F.least(F.lit(1023), F.bround(clock / (32 * hz)).cast("int")))


def bits(value: Column, shift: int, mask: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND(mask)


def velocity_bucket(velocity: Column) -> Column:
    return F.floor(velocity * 7 / 15).cast("int")


def level_bucket(mean_tl: Column) -> Column:
    return F.least(F.lit(7), F.floor(mean_tl * 7 / 127).cast("int"))


def wait_bins(n: int = 64, most: int = 3_000_000) -> list[int]:
    """Distinct rounded members of a geometric series from 1 to ``most``."""
    return sorted({round(math.exp(math.log(most) * k / (n - 1))) for k in range(n)})


def nearest_bin(value: Column, bins: list[int]) -> Column:
    """Index of the nearest bin; in the middle the upper one; beyond the ends the end."""
    a = F.array(*map(F.lit, bins))
    at = F.coalesce(F.array_position(F.transform(a, lambda b: b >= value), F.lit(True)), F.lit(0))
    up = F.when(at == 0, len(bins)).otherwise(at).cast("int")
    low = F.greatest(up - 1, F.lit(1))
    closer = (value - F.element_at(a, low)) < (F.element_at(a, up) - value)
    return F.when(closer, low - 1).otherwise(up - 1).cast("int")


def bin_value(index: Column, bins: list[int]) -> Column:
    return F.element_at(F.array(*map(F.lit, bins)), F.least(F.greatest(index, F.lit(0)) + 1, F.lit(len(bins))).cast("int"))


def snap_tempo(bpm: Column) -> Column:
    """Nearest whole tempo from 60 to 240; in the middle the slower."""
    return F.greatest(F.lit(60), F.least(F.lit(240), F.ceil(bpm - 0.5))).cast("int")


def duration_bucket(seconds: Column) -> Column:
    out = F.lit("300+")
    for low, high in ((180, 300), (120, 180), (60, 120), (30, 60), (0, 30)):
        out = F.when(seconds < high, f"{low}-{high}").otherwise(out)
    return out
