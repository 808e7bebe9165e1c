"""The chips' rules, one by one, on hand-made rows: (type, register, value, pcm_offset)."""

from pyspark.sql import functions as F

from seqmill.operators import chips, score
from seqmill.sources.vgm import DAC, END

W = lambda n: (3, 0, n, None)
P0 = lambda r, v: (0, r, v, None)
P1 = lambda r, v: (1, r, v, None)
S = lambda v: (2, 0, v, None)
ON, OFF = P0(0x28, 0xF0), P0(0x28, 0)
A4 = [P0(0xA4, 0x22), P0(0xA0, 0x69)]


def notes(*rows):
    return [(n.channel, n.pitch, n.sample_on, n.sample_off) for n in chips.decode_track(iter(rows))]


def test_key_on_off_and_end():
    assert notes(*A4, W(10), ON, W(20), OFF, W(5)) == [(0, 71, 10, 30)]
    assert notes(ON, W(7))[0][2:] == (0, 7)
    assert notes(ON, W(7), (END, 0, 0, None), W(9))[0][2:] == (0, 7)


def test_retrigger_and_release():
    assert [n[2:] for n in notes(ON, W(5), ON, W(5), OFF)] == [(0, 5), (5, 10)]
    n = chips.decode_track(iter([ON, W(5), OFF, W(5), *A4, W(5), ON, OFF]))
    assert n[0].sample_off == 5 and n[0].bends and n[1].sample_on == 15


def test_invalid_channels_and_second_port():
    assert notes(P0(0x28, 0xF3), P0(0x28, 0xF7)) == []
    assert notes(P0(0x28, 0xF4), W(3))[0][0] == 3
    n = chips.decode_track(iter([P1(0xB0, 0x3C), P1(0xB4, 0x40), P0(0x28, 0xF4), W(1)]))[0]
    assert n.patch[:5] == [4, 7, 0, 0, 1]


def test_fade_closes_and_late_pan_corrects():
    fade = [P0(0x4C, 127)]  # the carrier of algorithm 0 is the last operator
    assert notes(ON, W(9), *fade, W(5)) == [(0, None, 0, 9)]
    early = chips.decode_track(iter([ON, W(200), P0(0xB4, 0x80), W(1)]))[0]
    late = chips.decode_track(iter([ON, W(201), P0(0xB4, 0x80), W(1)]))[0]
    assert early.patch[4] == 2 and not early.pans and late.patch[4] == 3 and late.pans == [{"sample": 201, "a": 2}]


def test_dac_takes_the_sixth_channel():
    six = P0(0x28, 0xF6)
    assert notes(six, W(5), P0(0x2B, 0x80), W(5), six, W(5)) == [(5, None, 0, 5)]
    hits = notes(P0(0x2B, 0x80), (DAC, 0x2A, 1, 0), (DAC, 0x2A, 1, 1), W(64), (DAC, 0x2A, 1, 2), W(65), (DAC, 0x2A, 1, 3), (DAC, 0x2A, 1, 9))
    assert [n[2] for n in hits] == [0, 129, 129]
    assert notes((DAC, 0x2A, 1, 0)) == []


def test_psg():
    tone = [S(0x8E), S(0x0F)]
    assert notes(*tone, S(0x90), W(9), S(0x9F))[0][2:] == (0, 9)
    n = chips.decode_track(iter([*tone, S(0x90), W(4), S(0x94), W(4), S(0x8E), S(0x1F), W(4), S(0x9F)]))
    assert [(x.sample_on, x.sample_off) for x in n] == [(0, 8), (8, 12)] and n[0].volumes == [{"sample": 4, "a": 4}]
    noise = chips.decode_track(iter([S(0xE5), S(0xF0), W(3), S(0xFF)]))[0]
    assert (noise.channel, noise.pitch, noise.noise_mode) == (10, None, 5)


def test_order_does_not_depend_on_partitions(spark):
    rows = []
    for t in range(6):
        for k in range(300):
            rows.append((f"t{t}", 2 * k, 3, 0, 100 + t, 0, None, None))
            rows.append((f"t{t}", 2 * k + 1, 0, 0x28, 0xF0 if k % 2 == 0 else 0, 0, None, None))
    df = spark.createDataFrame(rows, "track_id string, seq int, type tinyint, register smallint, value int, sample_pos long, pcm_offset long, error string")
    want = sorted((t, n.sample_on, n.sample_off) for t in {r[0] for r in rows} for n in chips.decode_track(iter((r[2], r[3], r[4], r[6]) for r in rows if r[0] == t)))
    for parts in (1, 7):
        got = sorted((r.track_id, r.sample_on, r.sample_off) for r in chips.decode_notes(df.repartition(parts)).collect())
        assert got == want


def test_patch_tokens_round_trip(spark):
    patches = [[k % 8, k % 7, k % 4, k % 5, 3, *[x for op in range(4) for x in ((k * 7 + op) % 128, k % 32, (k + 1) % 32, (k + 2) % 32, k % 16, (k + 3) % 16, (k + 5) % 16, k % 8, k % 4, k % 16, 0)]] for k in range(40)]
    df = spark.createDataFrame([(p,) for p in patches], "patch array<int>")
    got = [r.t for r in df.select(score.patch_tokens(F.col("patch")).alias("t")).collect()]
    assert all(len(t) == 44 for t in got) and [score.patch_from_tokens(t) for t in got] == patches
    assert score.patch_from_tokens([1] * 44) is None and score.patch_from_tokens(got[0][:40]) is None


def test_envelope_split(spark):
    note = chips.Note(7, 0, 60, 15, 100, volumes=[{"sample": 10, "a": 14}, {"sample": 20, "a": 13}, {"sample": 50, "a": 0}, {"sample": 100, "a": 9}])
    quiet = chips.Note(7, 0, 60, 15, None, volumes=[{"sample": 10, "a": 14}])
    rows = [{"track_id": "t", "emit": k, **n.__dict__} for k, n in enumerate((note, quiet))]
    df = spark.createDataFrame(rows, chips.NOTE_SCHEMA)
    got = [(r.emit, r.sample_on, r.sample_off, r.velocity, len(r.volumes)) for r in score.split_notes(df).orderBy("emit", "part").collect()]
    assert got == [(0, 0, 10, 15, 0), (0, 10, 50, 1, 0), (0, 50, 100, 15, 0), (1, 0, None, 15, 1)]


def test_decoding_is_bounded_by_the_sequence():
    assert score.decode_tokens([]).notes == [] and score.decode_tokens([score.BOS, score.EOS]).notes == []
    t = [score.BOS, score.TEMPO + 60, score.BAR, score.DOWNBEAT, score.BEAT, score.CH_FM, score.NOTE_ON, score.PITCH + 36, score.VELOCITY + 9, score.BEAT + 8, score.CH_FM, score.NOTE_OFF, score.DAC_HIT + 2, score.EOS]
    d = score.decode_tokens(t)
    assert [(n["channel"], n["pitch"], n["sample_on"], n["sample_off"]) for n in d.notes] == [(0, 60, 0, 44096), (6, None, 44096, 44096 + 5512)]
    for cut in range(len(t)):
        score.decode_tokens(t[:cut])


def test_patch_vectors_lie_in_bounds(spark):
    top = [7, 7, 3, 7, 3, *[127, 31, 31, 31, 15, 15, 15, 7, 3, 15, 1] * 4]
    df = spark.createDataFrame([(top,), ([0] * 49,)], "patch array<int>")
    a, b = (r.v for r in df.select(score.patch_vector(F.col("patch")).alias("v")).collect())
    assert len(a) == len(b) == 47 and a[7] == 4.0 and all(x == 1.0 for x in a[8:]) and b[0] == 4.0 and sum(b) == 4.0
