"""Pitch of sounds, windows and triggers; landing."""

import io
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqmill.operators import library, pitch
from seqmill.sources import landing, wav

RATE = 44100


def tone(hz, seconds=0.1, rate=RATE, overtones=(1.0,)):
    t = np.arange(int(seconds * rate)) / rate
    return sum(a * np.sin(2 * math.pi * hz * (k + 1) * t) for k, a in enumerate(overtones))


def by_rule(segment, rate, lowest=40.0, highest=8000.0):
    """The first estimate, one frame at a time, by direct sums."""
    n = len(segment)
    if n < 8:
        return None
    seg = segment - segment.mean()
    least, most = max(1, int(rate / highest)), min(int(rate / lowest), n // 2)
    if math.sqrt((seg**2).mean()) < 1e-4 or least >= most:
        return None
    like = [float(seg[: n - k] @ seg[k:]) / float(seg @ seg) for k in range(least, most + 1)]
    k = int(np.argmax(like))
    return rate / (least + k) if like[k] >= 0.3 else None


@pytest.mark.parametrize("hz", [41.2, 55.0, 110.0, 261.63, 440.0, 987.77, 2093.0, 4186.0])
def test_tones_within_a_cent(hz):
    for overtones in ((1.0,), (1.0, 0.6, 0.3), (0.5, 1.0)):
        if hz * len(overtones) < 8000:
            refined = pitch.pitches(tone(hz, 0.2, overtones=overtones)[None], RATE)[1][0]
            assert abs(1200 * math.log2(refined / hz)) < (1 if 200 < hz < 3000 else 8), (hz, overtones, refined)


def test_first_estimate_by_its_rule():
    rng = np.random.default_rng(5)
    frames = [rng.normal(size=800), np.zeros(800), np.full(800, 0.7), tone(440, 0.1, 8000), tone(90, 0.1, 8000) + rng.normal(size=800) * 0.1, 1e-5 * tone(300, 0.1, 8000)]
    got = pitch.pitches(np.array(frames), 8000)[0]
    for x, f in zip(got, frames, strict=True):
        want = by_rule(f, 8000)
        assert (want is None and math.isnan(x)) or math.isclose(x, want)
    assert np.isnan(pitch.pitches(np.ones((2, 7)), 8000)).all() and pitch.pitches(np.ones((0, 800)), 8000)[0].shape == (0,)


def test_windows_and_triggers():
    x = tone(440, 1.0)
    n = pitch.window_samples(x, RATE // 2, RATE)
    assert n == int(0.008 * RATE)  # two and a half cycles are shorter than a window may be
    assert pitch.window_samples(x, RATE // 2, RATE, cycles=10) == 1000  # 440 Hz: a lag of 100 samples
    at = pitch.trigger(x, RATE // 2, n)
    assert x[at] < 0 <= x[at + 1] and abs(at - (RATE // 2)) <= n
    assert pitch.window_samples(np.zeros(RATE), 0, RATE) == int(0.08 * RATE) == pitch.window_samples(x[:5], 0, RATE)
    assert pitch.trigger(np.ones(100), 50, 20) == 40 and pitch.trigger(np.ones(10), 9, 20) == 0
    assert pitch.window_samples(tone(8000, 1.0), RATE // 2, RATE) == int(0.008 * RATE)


def test_sound_files_to_pitches(spark, tmp_path):
    for hz in (220.0, 440.0, 1000.0):
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1), f.setsampwidth(2), f.setframerate(RATE)
            f.writeframes((tone(hz, 0.5) * 30_000).astype("<i2").tobytes())
        (tmp_path / f"{hz:.0f}.wav").write_bytes(out.getvalue())
    (tmp_path / "bad.wav").write_bytes(b"no sound")
    sounds = wav.read(spark, str(tmp_path))
    rows = pitch.track(pitch.frames(sounds, 4410, 2205)).collect()
    assert len(rows) == 3 * 9
    for r in rows:
        hz = float(r.path.rsplit("/", 1)[1].removesuffix(".wav"))
        assert abs(1200 * math.log2(r.refined / hz)) < 1 and r["at"] % 2205 == 0
    shown = pitch.windows(sounds, 4410).collect()
    assert len(shown) == 15 and {r.n for r in shown if "1000" in r.path and r["at"] > 0} == {int(0.008 * RATE)}
    quiet = spark.createDataFrame([("a", 8000, [0.0] * 900), ("b", 8000, []), ("c", 8000, None), ("d", 8000, [1.0] * 5)], "path string, rate int, samples array<float>")
    assert [(r.path, r.hz, r.refined) for r in pitch.track(pitch.frames(quiet, 400, 400)).collect()] == [("a", None, None), ("a", None, None)]
    assert pitch.windows(quiet, 400, triggered=False).where("path IN ('b', 'c')").count() == 0


def test_landing(spark, tmp_path):
    path = str(tmp_path / "in")
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6), (2, "z", 7), (None, "w", 8)], "id int, body string, n int")
    assert landing.keys(spark, path) is None and landing.read(spark, path) is None
    assert landing.land(a, path, "id", "body") == {"run": 0, "new": 2, "contents": 2}
    assert landing.land(a, path, "id", "body") == {"run": 1, "new": 0, "contents": 0}  # nothing lands twice
    first = {(r.id, r.body, r.run) for r in landing.read(spark, path).collect()}
    digest = {b: spark.range(1).select(F.sha2(F.lit(b).cast("binary"), 256)).first()[0] for b in "yz"}
    assert first == {(1, "x", 0), (2, min(digest, key=digest.get), 0)}
    b = a.unionByName(spark.createDataFrame([(3, "x", 1), (4, None, 2), (5, "v", 3)], a.schema))
    # a run that broke off before its keys were complete: its rows are there and do not count
    b.where("id > 2").write.parquet(f"{path}/rows/run=1", mode="overwrite")
    b.select(F.col("id").alias("key")).write.parquet(f"{path}/keys/run=1", mode="overwrite")
    (tmp_path / "in/keys/run=1/_SUCCESS").unlink()
    assert landing.read(spark, path).count() == 2
    assert landing.land(b, path, "id", "body") == {"run": 1, "new": 3, "contents": 2}  # the first body is known
    assert {(r.id, r.run) for r in landing.read(spark, path).collect()} == {(1, 0), (2, 0), (3, 1), (4, 1), (5, 1)}
    assert landing.keys(spark, path).count() == 5


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [12]), (4, []), (5, None), (6, [1, None, 2])], "k int, patch array<int>")
    got = {r.k: r.p for r in df.select("k", library.fingerprint(F.col("patch")).alias("p")).collect()}
    assert got[1] == got[2] and got[5] is None and len({bytes(got[k]) for k in (1, 3, 4, 6)}) == 4 and all(len(p) == 16 for p in got.values() if p)
    lib = library.voice_library(df)
    assert [(r.lib, r.patch, r.n) for r in lib.orderBy("lib").collect()][0] == (0, [1, 2], 2) and lib.count() == 4
