"""Telephony audio columns: mu-law, A-law and IMA ADPCM, stored in WAV files, decoded and resampled.

The two companded codes have 256 values, so expanding is one lookup. ADPCM is sequential within a
block but blocks are independent: numpy decodes the same sample of all blocks at once. PCM is
resampled by a windowed sinc whose phases are a small table.

Any bytes are valid in each of the three codings, as samples of 8 bits or, in blocks of 64, as ADPCM.
So a payload is stored as it is; which coding its file declares goes by the payload's checksum. The
files are written to the shared folder and read back; what is read is decoded, described, and
resampled to 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.session import small_batches, stored

RATE, PCM_RATE = 8000, 16_000
ALAW, MULAW, ADPCM = 6, 7, 0x11  # format tags of the WAV container
CODINGS = (MULAW, ALAW, ADPCM)
UNIT = 64  # payloads are padded to a multiple of so many bytes
BLOCK = 256  # bytes of an ADPCM block
CHUNK = 1 << 20  # samples looked at together
#: Fixed values of IMA ADPCM: how a code moves the step index, and the step sizes.
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024,
    3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])


# -- companding -----------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


@lru_cache(maxsize=1)
def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent = code >> 4 & 7
    size = np.where(exponent == 0, ((code & 15) << 4) + 8, ((code & 15) << 4) + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def compress(pcm: np.ndarray, law: int = MULAW) -> bytes:
    """The code whose value is nearest; of equally near ones the smaller value's."""
    table = (mulaw_table() if law == MULAW else alaw_table()).astype(np.int64)
    order = np.argsort(table, kind="stable")
    values = table[order]
    x = np.clip(pcm.astype(np.int64), values[0], values[-1])
    k = np.clip(np.searchsorted(values, x), 1, 255)
    k -= x - values[k - 1] <= values[k] - x
    return order[k].astype(np.uint8).tobytes()


def expand(codes: bytes | np.ndarray, law: int = MULAW) -> np.ndarray:
    data = np.frombuffer(codes, np.uint8) if isinstance(codes, (bytes, bytearray, memoryview)) else codes
    return (mulaw_table() if law == MULAW else alaw_table())[data]


# -- ADPCM ----------------------------------------------------------------------------------------


def _move(value: np.ndarray, index: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = STEPS[index]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
    return value, np.clip(index + INDEX_MOVES[code], 0, 88)


def adpcm_decode(data: bytes, block: int = BLOCK, samples: int | None = None) -> np.ndarray:
    """All blocks side by side: one step in numpy for each sample of a block. A cut last block ends early."""
    n = -(-len(data) // block)
    if not n:
        return np.zeros(0, np.int16)
    raw = np.frombuffer(data.ljust(n * block, b"\0"), np.uint8).reshape(n, block)
    value = raw[:, :2].copy().view("<i2").astype(np.int64).ravel()
    index = np.minimum(raw[:, 2], 88).astype(np.int64)
    codes = np.stack([raw[:, 4:] & 15, raw[:, 4:] >> 4], axis=2).reshape(n, -1)
    out = np.empty((n, codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(codes.shape[1]):
        value, index = _move(value, index, codes[:, k])
        out[:, k + 1] = value
    whole = (n - 1) * out.shape[1] + 1 + 2 * max(0, len(data) - (n - 1) * block - 4)
    return out.ravel()[: whole if samples is None else samples]


def adpcm_encode(pcm: np.ndarray, block: int = BLOCK) -> bytes:
    """Blocks of the format, each from its first sample on; all blocks side by side."""
    per = 2 * (block - 4) + 1
    n = -(-len(pcm) // per)
    if not n:
        return b""
    x = np.zeros(n * per, np.int64)
    x[: len(pcm)] = pcm
    x[len(pcm) :] = pcm[-1]
    x = x.reshape(n, per)
    value, index = x[:, 0].copy(), np.zeros(n, np.int64)
    codes = np.zeros((n, per - 1), np.uint8)
    for k in range(per - 1):
        step, gap = STEPS[index], x[:, k + 1] - value
        code = np.where(gap < 0, 8, 0)
        gap = np.abs(gap)
        for bit in (4, 2, 1):
            take = gap >= step
            code, gap, step = code | np.where(take, bit, 0), np.where(take, gap - step, gap), step >> 1
        codes[:, k] = code
        value, index = _move(value, index, code)
    head = np.zeros((n, 4), np.uint8)
    head[:, :2] = x[:, 0].astype("<i2").view(np.uint8).reshape(n, 2)
    return np.hstack([head, codes[:, ::2] | codes[:, 1::2] << 4]).tobytes()


# -- resampling -----------------------------------------------------------------------------------


@lru_cache(maxsize=16)
def _phases(up: int, down: int, half: int = 8) -> np.ndarray:
    """A windowed sinc for each of ``up`` phases."""
    cut = min(1.0, up / down)
    at = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    window = np.cos(np.pi * at / (2 * half)) ** 2 * (np.abs(at) < half)
    taps = cut * np.sinc(cut * at) * window
    return taps / taps.sum(axis=1, keepdims=True)


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """PCM at another rate; ends are held. Empty stays empty.

    Outputs of one phase are ``up`` apart and have the same taps over evenly spaced inputs.
    """
    g = gcd(rate, to)
    up, down = to // g, rate // g
    if up == down or not len(pcm):
        return pcm.astype(np.int16)
    taps = _phases(up, down)
    half = taps.shape[1] // 2
    n = -(-len(pcm) * up // down)
    out = np.empty(n, np.int16)
    padded = np.concatenate([np.full(half, pcm[0], np.int16), pcm, np.full(half + 1, pcm[-1], np.int16)])
    for r in range(min(up, n)):
        begin, phase = divmod(r * down, up)
        own, line = len(range(r, n, up)), sliding_window_view(padded[begin + 1 :], 2 * half)[::down]
        for at in range(0, own, CHUNK // 4):
            part = line[at : min(own, at + CHUNK // 4)]
            x = part.astype(np.float64) @ taps[phase] if down > 1 else np.correlate(padded[begin + 1 + at : begin + at + len(part) + 2 * half].astype(np.float64), taps[phase])
            out[r + at * up : r + (at + len(part)) * up : up] = np.clip(np.rint(x), -32768, 32767)
    return out


# -- the container --------------------------------------------------------------------------------


def wav(data: bytes, law: int = MULAW, rate: int = RATE, block: int | None = None, bits: int | None = None) -> bytes:
    """A WAV file; by default blocks of BLOCK bytes and 4 bits a sample for ADPCM, else of one sample of 8 bits."""
    block = block or (BLOCK if law == ADPCM else 1)
    bits = bits or (4 if law == ADPCM else 8)
    extra = struct.pack("<H", 2 * (block - 4) + 1) if law == ADPCM else b""
    speed = rate * block // (2 * (block - 4) + 1) if law == ADPCM else rate * block
    fmt = struct.pack("<HHIIHHH", law, 1, rate, speed, block, bits, len(extra)) + extra
    pad = b"\0" * (len(data) % 2)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[bytes, dict]:
    """The sample bytes and the format of a WAV file; ValueError for what is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, {}
    while at + 8 <= len(media):
        name, (size,) = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])
        if name == b"fmt " and size >= 16 and at + 24 <= len(media):
            law, channels, rate, _, block, bits = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
            fmt = {"law": law, "channels": channels, "rate": rate, "block": block, "bits": bits}
        elif name == b"data":
            if not fmt:
                raise ValueError("no format before the data")
            return media[at + 8 : at + 8 + size], fmt
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """PCM and rate of a stored file of any of the three codings, or of 16-bit PCM."""
    data, fmt = unwav(media)
    if not fmt["rate"] or fmt["channels"] != 1:
        raise ValueError("one channel and a rate are needed")
    if fmt["law"] in (ALAW, MULAW):
        return expand(data, fmt["law"]), fmt["rate"]
    if fmt["law"] == ADPCM and fmt["block"] > 4:
        return adpcm_decode(data, fmt["block"]), fmt["rate"]
    if fmt["law"] == 1 and fmt["bits"] == 16:
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.int16), fmt["rate"]
    raise ValueError(f"coding {fmt['law']} is not known")


def decode_all(media: list[bytes]) -> list[tuple[np.ndarray, int]]:
    """decode() of each; the ADPCM blocks of all files of whole blocks of one size go side by side."""
    out: list = [None] * len(media)
    groups: dict[int, list[tuple[int, bytes, int]]] = {}
    for k, m in enumerate(media):
        data, fmt = unwav(m)
        if fmt["law"] == ADPCM and fmt["channels"] == 1 and fmt["rate"] and fmt["block"] > 4 and data and len(data) % fmt["block"] == 0:
            groups.setdefault(fmt["block"], []).append((k, data, fmt["rate"]))
        else:
            out[k] = decode(m)
    for block, files in groups.items():
        pcm = adpcm_decode(b"".join(d for _, d, _ in files), block)
        at = 0
        for k, data, rate in files:
            n = len(data) // block * (2 * (block - 4) + 1)
            out[k] = pcm[at : at + n], rate
            at += n
    return out


def to_pcm(media: bytes, rate: int = PCM_RATE) -> bytes:
    """A WAV file of resampled 16-bit PCM."""
    return pcm_file(*decode(media), rate)


def pcm_file(pcm: np.ndarray, own: int, rate: int = PCM_RATE) -> bytes:
    return wav(resample(pcm, own, rate).astype("<i2").tobytes(), law=1, rate=rate, block=2, bits=16)


# -- the column of payloads -----------------------------------------------------------------------


def payload(text: str | None) -> bytes:
    """UTF-8, then zero bytes up to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def media_file(data: bytes) -> bytes:
    """A payload as the samples of a WAV file, in the coding that its checksum gives."""
    law = CODINGS[zlib.crc32(data) % len(CODINGS)]
    return wav(data, law, block=UNIT if law == ADPCM else 1)


def feature(pcm: np.ndarray, rate: int) -> str:
    """Length, mean square, peak, zero crossings and mean squared step of decoded audio."""
    n, energy, peak, crossings, tilt, last = len(pcm), 0, 0, 0, 0, None
    for at in range(0, n, CHUNK):
        x = pcm[at : at + CHUNK].astype(np.int64)
        energy += int(x @ x)
        peak = max(peak, int(np.abs(x).max()))
        if last is not None:
            x = np.concatenate([[last], x])
        up = x >= 0
        crossings += int(np.count_nonzero(up[1:] != up[:-1]))
        d = x[1:] - x[:-1]
        tilt += int(d @ d)
        last = x[-1]
    return f"n={n};ms={1000 * n // rate};ms2={energy // max(n, 1)};peak={peak};zc={crossings};tilt={tilt // max(n - 1, 1)}"


_STORED = "doc_id long, n_bytes long, media binary"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            texts = part.column(1).to_pylist()
            media = [media_file(payload(t)) for t in texts]
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``, written to the shared folder: each text's payload as a WAV file. Null is empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return stored(rows.mapInArrow(_store, _STORED), "media", "zstd")


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, coding string, pcm_bytes long, pcm_sha256 string"


def _digest(rate: int):
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        media = part.column("media").to_pylist()
        back = [unwav(m) for m in media]
        audio = decode_all(media)
        names = {MULAW: "mu-law", ALAW: "A-law", ADPCM: "ADPCM"}
        pcm = [(len(p), sha(p)) for p in (pcm_file(x, own, rate) for x, own in audio)]
        cols = [
            part.column("doc_id"), part.column("n_bytes"), pa.array([len(x) for x, _ in back], pa.int64()), pa.array([sha(x) for x, _ in back], pa.string()),
            pa.array([zlib.crc32(x[-UNIT:]) for x, _ in back], pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array([sha(m) for m in media], pa.string()),
            pa.array([feature(x, own) for x, own in audio], pa.string()), pa.array([names[f["law"]] for _, f in back], pa.string()), pa.array([n for n, _ in pcm], pa.int64()), pa.array([h for _, h in pcm], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _DIGEST.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            while at < b.num_rows:  # PCM is several times its media: a few rows, or one long one, at a time
                n, size = 1, len(b.column("media")[at].as_py())
                while at + n < b.num_rows and n < 256 and (size := size + len(b.column("media")[at + n].as_py())) <= CHUNK:
                    n += 1
                yield rows(b.slice(at, n))
                at += n

    return run


def digest(media: DataFrame, rate: int = PCM_RATE) -> DataFrame:
    """What store() gave, read back: sizes, digests and features of each row, and its PCM at ``rate``."""
    small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digest(rate), _DIGEST)


def store_pcm(media: DataFrame, rate: int = PCM_RATE) -> DataFrame:
    """``media`` with a column ``pcm``: the decoded audio, resampled, as a WAV file of 16-bit samples.

    Null and what is no file of a known coding give null.
    """
    small_batches(media.sparkSession)
    return media.withColumn("pcm", F.pandas_udf(_pcm(rate), "binary")("media"))


def _pcm(rate: int):
    import pandas as pd

    def one(m: bytes | None) -> bytes | None:
        try:
            return None if m is None else to_pcm(bytes(m), rate)
        except ValueError:
            return None

    def run(media: pd.Series) -> pd.Series:
        return media.map(one)

    run.__annotations__ = {"media": pd.Series, "return": pd.Series}
    return run
