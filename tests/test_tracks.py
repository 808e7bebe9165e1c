import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqmill.functions import music
from seqmill.operators import chips, synth, tokens, tracks
from seqmill.sources import vgm

RATE = tracks.RATE


def track(on, seconds):
    return tracks.Onsets(np.asarray(on, np.int64), int(seconds * RATE))


def every(bins, n, start=0):
    """Onsets exactly so many bins of ten milliseconds apart."""
    return (start + np.arange(n) * bins) * tracks.BIN


def test_tempo_by_hand():
    # 41 onsets 50 bins apart: 40 repeats at 50, 39 at 100, none beside them, so the peak is at 50 bins, 120 a minute
    assert tracks.tempo(track(every(50, 41), 30)) == 120.0
    # 40 bins: 40 repeats at 40 (150 a minute), 39 at 80, 38 at 120
    assert tracks.tempo(track(every(40, 41), 30)) == 150.0
    # onsets 60 bins apart and each with another 62 later: 60 and 62 have repeats, 61 none; by hand:
    on = np.sort(np.concatenate([every(60, 20), every(60, 20, 2)]))  # lag 60: 19 + 19, lag 58: 19, lag 62: 19
    assert tracks.tempo(track(on, 30)) == pytest.approx(6000 / 60)
    # unequal neighbours: 3 at 49, 10 at 50, 1 at 51 -> 50 + (3 - 1) / 2 / (3 - 20 + 1) = 49.9375
    gaps = [50] * 10 + [150] + [49] * 3 + [150] + [51]
    at = np.concatenate([[0], np.cumsum(gaps)])
    h = np.bincount(at, minlength=3001)
    counted = [int(h[: 3001 - k] @ h[k:]) for k in range(20, 121)]
    k = int(np.argmax(counted))
    a, b, c = counted[k - 1 : k + 2]
    assert (20 + k, a, b, c) == (50, 3, 10, 1)
    assert tracks.tempo(track(at * tracks.BIN, 30)) == pytest.approx(6000 / 49.9375)


def test_tempo_of_what_has_none():
    assert tracks.tempo(track([5] * 9, 30)) == 120.0  # nine onsets in one bin
    assert tracks.tempo(track(every(500, 9), 60)) == 120.0  # no repeats within the slowest beat
    assert tracks.tempo(track(every(50, 7), 30)) == 120.0 and tracks.tempo(track([], 0)) == 120.0
    assert tracks.tempo(track(every(1, 9), 0.2)) == 120.0  # shorter than the fastest beat


def test_repeats_by_definition():
    rng = np.random.default_rng(0)
    on = rng.integers(0, 300 * tracks.BIN, 400)
    h = np.bincount(on // tracks.BIN, minlength=301)
    assert tracks.Onsets(on, 300 * tracks.BIN).repeats(np.arange(51)).tolist() == [float((h[: 301 - k] * h[k:]).sum()) for k in range(51)]


def test_phase_by_hand():
    # onsets at 0.30 s and every half second: the comb that starts at bin 30 meets all
    assert tracks.phase(track(every(50, 40, 30), 30), 120) == pytest.approx(0.3)
    # a lone first onset at 0.10 s: the comb at 0.30 goes back a beat, to -0.20, and so to the start
    assert tracks.phase(track(np.append(every(50, 40, 30), 10 * tracks.BIN), 30), 120) == 0.0
    # first onset at 1.33 s, comb at bin 30: back by none, 1.30 is not before ... 0.30 lies a beat or more before the first onset
    assert tracks.phase(track(np.append(every(50, 40, 180), 133 * tracks.BIN), 40), 120) == pytest.approx(0.3)
    # within an eighth of a beat before the first onset: that onset
    assert tracks.phase(track(np.append(every(50, 40, 80), 35 * tracks.BIN), 40), 120) == pytest.approx(0.35)
    assert tracks.phase(track(every(50, 3), 30), 120) == 0.0 and tracks.phase(track(every(50, 40), 30), 0) == 0.0


def test_meter_by_hand():
    bar = RATE / 2  # a beat of 50 bins
    three = np.concatenate([every(50, 60), np.repeat(every(150, 20), 6)])
    assert tracks.meter(track(three, 31), bar) == 3
    assert tracks.meter(track(every(50, 60), 31), bar) == 4  # 58, 57 and 56 repeats: none stands out
    two = np.repeat(every(100, 40), 3)  # 9 * 39 after two beats, 0 after three, 9 * 38 after four: too like a bar of four
    assert tracks.meter(track(two, 41), bar) == 4
    assert tracks.meter(track(np.concatenate([every(100, 2, 1000 * k) for k in range(8)]), 81), bar) == 2  # nothing repeats after four
    assert tracks.meter(track([7] * 12, 31), bar) == 2  # no repeats at all
    assert tracks.meter(track(every(50, 11), 31), bar) == 4 and tracks.meter(track(every(50, 60), 31), 0) == 4


def test_tempo_map_by_hand():
    # 60 s of 150 a minute (40 bins), then 60 s of 100 (60 bins); least section 15 s.
    on = np.concatenate([every(40, 150), every(60, 100, 6000)])
    whole = track(on, 120)
    # halves are pure. Cuts: 60 s keeps both tempi, so ties go right: low 60; then 82.5 s: the left part still repeats
    # most at 40 bins (149 against 37 at 60), the right stays 100: low; and so on to the end of the range, 105 s
    sections = tracks.tempo_map(whole)
    assert [round(t) for _, t in sections][0] == 150 and round(sections[-1][1]) == 100 and sections[0][0] == 0.0
    low, high = 15 * RATE, 105 * RATE
    halves = tracks.tempo(whole.part(0, 60 * RATE)), tracks.tempo(whole.part(60 * RATE, 120 * RATE))
    assert (round(halves[0]), round(halves[1])) == (150, 100)
    for _ in range(8):  # the rule once more, on absolute distances with ties to the right
        cut = (low + high) // 2
        left, right = tracks.tempo(whole.part(0, cut)), tracks.tempo(whole.part(cut, 120 * RATE))
        low, high = (cut, high) if abs(left - halves[0]) <= abs(right - halves[1]) else (low, cut)
    assert tracks._change(lambda a, b: tracks.tempo(whole.part(a, b)), 0, 120 * RATE, 15 * RATE, 0.06) == (low + high) // 2
    assert tracks.tempo_map(track(every(60, 200), 120)) == [(0.0, 100.0)]
    assert tracks.tempo_map(track([], 0)) == [(0.0, 120.0)]
    assert tracks.tempo_map(track(every(60, 20), 12)) == [(0.0, 100.0)]  # shorter than a section
    # nothing in the second half: it has no tempo, so nothing is cut
    assert tracks.tempo_map(track(every(40, 140), 120)) == [(0.0, 150.0)]


def scale(spark):
    """C major on two channels, eight times, as notes."""
    rows = []
    for c in (0, 1):
        for k in range(64):
            pitch = 60 + (0, 2, 4, 5, 7, 9, 11, 12)[k % 8] - 12 * c
            rows.append({"track_id": "t", "emit": len(rows), **chips.Note(c, 7350 * k, pitch, 12 - c, 7350 * k + 7000, patch=[4, 3, 0, 0, 3, *[20, 31, 1, 2, 3, 4, 1, 0, 0, 0, 0] * 4]).__dict__})
    notes = spark.createDataFrame(rows, chips.NOTE_SCHEMA)
    heads = spark.createDataFrame([("t", 7350 * 64, 7350 * 64 / RATE, 0, None), ("none", 44100 * 20, 20.0, 0, None), ("bad", None, None, None, "broken")], "track_id string, total_samples long, seconds double, loop_samples long, error string")
    return notes, heads


def test_analysis_of_a_scale(spark):
    notes, heads = scale(spark)
    got = tracks.analyse(notes, heads).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.key_index, r.is_minor, r.beats) == (0, False, 4) and 60 <= r.bpm <= 240
    assert r.roles[0] in ("LEAD", "COUNTER") and r.roles[1] in ("HARM", "BASS", "LEAD", "COUNTER")
    assert {x.track_id: x.reason for x in tracks.gate(notes, heads).collect()} == {"t": None, "none": "few_channels"}


def test_notes_come_back_from_bytes(spark):
    notes, heads = scale(spark)
    back = chips.decode_notes(vgm.read_events(synth.synthesise(notes)))
    key = ["channel", "pitch", "sample_on", "sample_off", "patch"]
    want = sorted(map(tuple, notes.select(*key).collect()), key=str)
    assert sorted(map(tuple, back.select(*key).collect()), key=str) == want
    acts = synth.actions(notes)
    assert synth.differences(acts).where(F.col("prio") == synth.VOICE).count() == 2 * 30
    stripped = synth.strip_prompt(notes, spark.createDataFrame([("t", 7350 * 60)], "track_id string, until long"))
    assert stripped.count() == 8 and stripped.agg(F.min("sample_on")).first()[0] == 0
    looped = heads.where("track_id = 't'").withColumn("loop_samples", F.lit(7350 * 16).cast("long"))
    assert synth.unroll_loop(notes, looped).count() == 128 + 32


ROWS = "track_id string, seq int, type tinyint, register smallint, value int, sample_pos long, pcm_offset long, error string"


def test_event_tokens_round_trip(spark):
    own = [(0, 0x28, 0xF0), (3, 0, 1), (5, 0x2A, 9), (3, 0, 1), (0, 0x28, 0xF0), (2, 0, 0x9F), (2, 0, 0x9F), (0, 0x40, 1), (4, 0, 0)]
    df = spark.createDataFrame([("t", k, t, r, v, 0, None, None) for k, (t, r, v) in enumerate(own)], ROWS)
    t = tokens.event_tokens(df)
    assert [r.token for r in t.orderBy("seq").collect()] == ["P0:28:F0", "WAIT:1", "P0:28:F0", "SN:00:9F", "SN:00:9F", "P0:40:01"]
    vocab = tokens.build_vocabulary(t, 2)
    assert {r.token for r in vocab.collect()} == {"P0:28:F0", "SN:00:9F"}
    ids = tokens.encode(t, vocab)
    back = [(r.type, r.register, r.value) for r in tokens.decode_events(ids, vocab).orderBy("place").collect()]
    assert back == [(0, 0x28, 0xF0), (3, 0, tokens.BINS[1]), (0, 0x28, 0xF0), (2, 0, 0x9F), (2, 0, 0x9F)]


def test_note_tokens(spark):
    own = [(0, 0xA4, 0x22), (0, 0xA0, 0x69), (0, 0x28, 0xF0), (3, 0, 735), (0, 0xA0, 0x6A), (0, 0xA4, 0x2A), (0, 0xA0, 0x69), (0, 0x28, 0), (0, 0xA0, 0), (2, 0, 0x80), (0, 0x30, 1), (1, 0xA4, 0x22), (1, 0xA0, 0x69), (0, 0x28, 0xF4)]
    df = spark.createDataFrame([("t", k, t, r, v, 0, None, None) for k, (t, r, v) in enumerate(own)], ROWS)
    got = [r.token for r in tokens.note_tokens(df).orderBy("seq").collect()]
    assert [x for x in got if not x.startswith("<WAIT")] == ["CH1:ON:B3", "CH1:PITCH:B4", "CH1:OFF", "PSG:80", "FM0:30:01", "CH4:ON:B3"]


def rows_of(spark, *logs):
    return spark.createDataFrame([(f"t{n}", k, t, r, v, 0, None, None) for n, own in enumerate(logs) for k, (t, r, v) in enumerate(own)], ROWS)


def plain_note_tokens(own, drums=False):
    """The rules of note texts one event at a time."""
    names = ["C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B"]
    high, low, down, pitch = ({c: 0 for c in range(1, 7)} for _ in range(4))
    out, pending = [], 0

    def flush():
        nonlocal pending
        if pending:
            out.append(f"<WAIT:{min(range(len(tokens.BINS)), key=lambda k: (abs(tokens.BINS[k] - pending), -k))}>")
        pending = 0

    def tune(c):
        f = (high[c] & 7) * 256 + low[c]
        pitch[c] = round(69 + 12 * math.log2(f * 7670453 / (144 * 2 ** (21 - (high[c] >> 3 & 7))) / 440)) if f else 0
        return names[pitch[c] % 12] + str(pitch[c] // 12 - 1)

    for kind, reg, value in own:
        if kind == 4:
            break
        if kind == 5 and not drums:
            continue
        if kind == 3:
            pending += value
            continue
        flush()
        n = value & 7
        key = n + 1 if n <= 2 else n if 4 <= n <= 6 else 0
        c = reg % 4 + 1 + 3 * kind
        if kind == 2:
            out.append(f"PSG:{value:02X}")
        elif kind == 0 and reg == 0x28 and key:
            down[key] = value >> 4
            if down[key]:
                name = tune(key)
                out.append(f"CH{key}:ON:{name if pitch[key] > 0 else 'X'}")
            else:
                out.append(f"CH{key}:OFF")
        elif kind < 2 and 0xA4 <= reg <= 0xA6:
            high[c] = value
        elif kind < 2 and 0xA0 <= reg <= 0xA2:
            low[c], before = value, pitch[c]
            name = tune(c)
            if down[c] and pitch[c] != before and pitch[c] > 0:
                out.append(f"CH{c}:PITCH:{name}")
        else:
            out.append(f"FM{kind % 5}:{reg:02X}:{value:02X}")
    flush()
    return out


def test_note_tokens_by_their_rules(spark):
    rng = random.Random(9)
    logs = []
    for _ in range(30):
        own = []
        for _ in range(rng.randint(1, 120)):
            kind = rng.choice([0, 0, 0, 0, 1, 1, 2, 3, 3, 5])
            reg = {0: rng.choice([0x28, 0x28, 0xA0, 0xA1, 0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7, 0x30]), 1: rng.choice([0xA0, 0xA4, 0xA2, 0xA6, 0x28, 0x90]), 5: 0x2A}.get(kind, 0)
            own.append((kind, reg, rng.choice([0, 1, 735, 882, 40_000]) if kind == 3 else rng.choice([0, rng.randrange(256)])))
        logs.append(own + [(4, 0, 0)])
    df = rows_of(spark, *logs)
    for drums in (False, True):
        got = {}
        for r in tokens.note_tokens(df, drums).orderBy("track_id", "seq").collect():
            got.setdefault(r.track_id, []).append(r.token)
        for n, own in enumerate(logs):
            assert got.get(f"t{n}", []) == plain_note_tokens(own, drums)


def test_note_writes(spark):
    own = ["CH1:ON:A4", "<WAIT:20>", "CH1:OFF", "CH4:OFF", "CH2:PITCH:D4", "FM0:30:71", "FM1:B0:3A", "PSG:9F", "<PAD>", "nonsense", "CH5:ON:X", "CH5:ON:C4", "CH7:ON:C4"]
    df = spark.createDataFrame([("t", k, x) for k, x in enumerate(own)], "track_id string, seq int, token string")
    rows = [(r.type, r.register, r.value, r.sample_pos) for r in tokens.note_writes(df).orderBy("seq").collect()]
    wait = tokens.BINS[20]
    f = {r.m: (r.fnum, r.block) for r in spark.createDataFrame([(69,), (62,), (60,)], "m int").select("m", music.least_error(F.col("m")).alias("t")).select("m", "t.*").collect()}
    pair = lambda m, port, c, at: [(port, 0xA4 + c, f[m][1] * 8 + f[m][0] // 256, at), (port, 0xA0 + c, f[m][0] % 256, at)]
    want = [*pair(69, 0, 0, 0), (0, 0x28, 0xF0, 0), (3, 0, wait, 0), (0, 0x28, 0, wait), (0, 0x28, 4, wait), *pair(62, 0, 1, wait), (0, 0x30, 0x71, wait), (1, 0xB0, 0x3A, wait), (2, 0, 0x9F, wait)]
    want += [*pair(60, 1, 1, wait), (0, 0x28, 0xF5, wait), *pair(60, 1, 1, wait), (0, 0x28, 0xF5, wait), (4, 0, 0, wait)]
    assert rows == want
    fewer = [(r.type, r.register, r.value, r.sample_pos) for r in tokens.note_writes(df, changes_only=True).orderBy("seq").collect()]
    assert fewer == want[:-4] + want[-2:]
    # every pitch that a channel can reach comes back by name, from the least error
    notes = [f"CH{1 + m % 6}:ON:{n}{o}" for o in range(0, 8) for m, n in enumerate(music.FLATS)]
    df = spark.createDataFrame([("t", k, x) for k, x in enumerate(notes)], "track_id string, seq int, token string")
    again = [r.token for r in tokens.note_tokens(tokens.note_writes(df)).orderBy("seq").collect()]
    assert [x for x in again if ":ON:" in x] == notes


def test_note_ids(spark):
    df = rows_of(spark, [(0, 0xA4, 0x22), (0, 0xA0, 0x69), (0, 0x28, 0xF0), (3, 0, 735), (0, 0x28, 0), (0, 0x28, 0xF0), (0, 0x30, 9), (4, 0, 0)], [(0, 0x40, 1), (4, 0, 0)])
    t = tokens.note_tokens(df)
    v = tokens.build_vocabulary(t, least=2)
    assert [r.token for r in v.collect()] == ["CH1:ON:B3"]
    assert tokens.vocabulary_summary(v).first().asDict() == {"special": 4, "waits": 61, "notes": 1, "writes": 0, "size": 66}
    ids = tokens.encode(t, v, marks=True)
    (wait,) = [k for k, b in enumerate(tokens.BINS) if b == min(tokens.BINS, key=lambda b: abs(b - 735))]
    assert {r.track_id: r.ids for r in ids.collect()} == {"t0": [1, 65, 4 + wait, 65, 2], "t1": [1, 2]}
    assert [r.token for r in tokens.token_strings(ids, v).orderBy("seq").collect()] == ["CH1:ON:B3", f"<WAIT:{wait}>", "CH1:ON:B3"]
    assert {r.track_id: r.ids for r in tokens.encode(t, v).collect()} == {"t0": [65, 4 + wait, 65]}
