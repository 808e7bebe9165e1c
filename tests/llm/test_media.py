import hashlib
import zlib

import numpy as np
import pytest

from seqmill.llm import media


def plain_mulaw(code):
    code = ~code & 0xFF
    size = (((code & 15) * 8 + 132) << (code >> 4 & 7)) - 132
    return -size if code & 128 else size


def plain_alaw(code):
    code ^= 0x55
    e, m = code >> 4 & 7, code & 15
    size = m * 16 + 8 if e == 0 else (m * 16 + 264) << (e - 1)
    return size if code & 128 else -size


def plain_adpcm(block):
    """One block, sample by sample."""
    value, index = int.from_bytes(block[:2], "little", signed=True), block[2]
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            diff = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                diff += part if code & bit else 0
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + int(media.INDEX_MOVES[code])))
            out.append(value)
    return out


def test_tables():
    codes = bytes(range(256))
    assert media.expand(codes, media.MULAW).tolist() == [plain_mulaw(c) for c in codes]
    assert media.expand(codes, media.ALAW).tolist() == [plain_alaw(c) for c in codes]
    for law in (media.MULAW, media.ALAW):  # compressing picks the nearest value
        values = media.expand(codes, law).astype(int)
        for x in (-40000, -32768, -5, 0, 3, 77, 32767, 40000):
            got = int(media.expand(media.compress(np.array([x]), law), law)[0])
            assert abs(got - x) == min(abs(values - x))


def test_adpcm_blocks_side_by_side():
    rng = np.random.default_rng(1)
    blocks = []
    for _ in range(7):
        b = bytearray(rng.integers(0, 256, media.BLOCK, dtype=np.uint8).tobytes())
        b[2] = rng.integers(0, 89)
        blocks.append(bytes(b))
    assert media.adpcm_decode(b"".join(blocks)).tolist() == sum(map(plain_adpcm, blocks), [])
    wave = (8000 * np.sin(np.arange(5000) / 9)).astype(np.int16)
    back = media.adpcm_decode(media.adpcm_encode(wave), samples=5000)
    assert np.abs(back.astype(int) - wave).mean() < 300
    assert len(media.adpcm_decode(b"")) == 0 and media.adpcm_encode(np.zeros(0, np.int16)) == b""


@pytest.mark.parametrize("to", [16000, 11025, 4000, 8000])
def test_resampling_keeps_a_tone(to):
    t = np.arange(8000) / 8000
    out = media.resample((10000 * np.sin(2 * np.pi * 440 * t)).astype(np.int16), 8000, to)
    want = 10000 * np.sin(2 * np.pi * 440 * np.arange(len(out)) / to)
    assert len(out) == to and np.abs(out - want)[50:-50].max() < 400
    assert len(media.resample(np.zeros(0, np.int16), 8000, to)) == 0


@pytest.mark.parametrize(("rate", "to"), [(8000, 16000), (8000, 11025), (16000, 8000), (8000, 12000), (7, 3)])
def test_resampling_by_direct_convolution(rate, to):
    x = np.random.default_rng(2).integers(-32768, 32768, 150).astype(np.int16)
    up, down = to // np.gcd(rate, to), rate // np.gcd(rate, to)
    cut, half, want = min(1.0, up / down), 8, []
    for k in range(-(-150 * up // down)):
        center, gap = divmod(k * down, up)
        at = np.arange(-half + 1, half + 1) - gap / up
        taps = cut * np.sinc(cut * at) * np.cos(np.pi * at / (2 * half)) ** 2 * (np.abs(at) < half)
        near = [float(x[min(max(center + j, 0), 149)]) for j in range(-half + 1, half + 1)]
        want.append(float(np.clip(np.dot(near, taps / taps.sum()), -32768, 32767)))
    got = media.resample(x, rate, to)
    assert len(got) == len(want) and np.abs(got - np.array(want)).max() <= 0.5 + 1e-6


def test_containers():
    for law in (media.MULAW, media.ALAW):
        data = bytes(range(256)) + b"x"
        assert media.unwav(media.wav(data, law))[0] == data
        pcm, rate = media.decode(media.wav(data, law))
        assert rate == 8000 and len(pcm) == 257
    data = bytes(range(256)) * 2 + b"cut"
    pcm, rate = media.decode(media.wav(data, media.ADPCM))
    assert media.unwav(media.wav(data, media.ADPCM))[1]["bits"] == 4 and rate == 8000
    assert pcm.tolist() == media.adpcm_decode(data).tolist()
    back, rate = media.decode(media.to_pcm(media.wav(b"\x80" * 100)))
    assert rate == 16000 and len(back) == 200
    for broken in (b"nothing", media.wav(b"abc")[:30], media.wav(b"abc", 99), b"RIFF0000WAVEdata\0\0\0\0"):
        with pytest.raises(ValueError):
            media.decode(broken)


def plain_feature(x, rate):
    """By definition, in whole numbers."""
    n, steps = len(x), [b - a for a, b in zip(x, x[1:])]
    crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))
    return f"n={n};ms={1000 * n // rate};ms2={sum(v * v for v in x) // n};peak={max(map(abs, x))};zc={crossings};tilt={sum(d * d for d in steps) // max(n - 1, 1)}"


def plain_decode(data, law):
    if law == "ADPCM":
        fixed = [data[k : k + 64] for k in range(0, len(data), 64)]
        return sum((plain_adpcm(b[:2] + bytes([min(b[2], 88)]) + b[3:]) for b in fixed), [])
    return [(plain_mulaw if law == "mu-law" else plain_alaw)(c) for c in data]


def test_rows(spark):
    texts = [None, "", "a" * 64, "é" * 33, "x" * 200_000, "a" * 64, "b", "some words", "漢字" * 40, "z" * 129]
    df = spark.createDataFrame([(k, t, "m") for k, t in enumerate(texts)] + [(None, "q", "m")], "doc_id long, text string, media string")
    stored = media.store(df)
    assert "file:" in stored.inputFiles()[0]  # read back from what was written
    got = {r.doc_id: r for r in media.digest(stored).collect()}
    for k, t in [*enumerate(texts), (None, "q")]:
        data = (t or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        pcm = plain_decode(payload, r.coding)
        assert r.feature == plain_feature(pcm, 8000)
        assert r.pcm_bytes == 44 + 2 + 4 * len(pcm)  # the format has an empty extension
    assert {r.coding for r in got.values()} == {"mu-law", "A-law", "ADPCM"}
    same = lambda r: (r.media_sha256, r.feature, r.media_bytes, r.pcm_sha256)
    assert same(got[2]) == same(got[5]) and same(got[0]) == same(got[1])
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"junk")), (3, bytearray(media.wav(b"abc")))], "doc_id long, media binary")
    assert [r.pcm and bytes(r.pcm[:4]) for r in media.store_pcm(odd).orderBy("doc_id").collect()] == [None, None, b"RIFF"]
    assert media.digest(media.store(df.limit(0))).count() == 0
