"""Sound files as rows: 16 and 24-bit PCM, channels averaged."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from seqmill.session import small_batches

_SCHEMA = "path string, rate int, samples array<float>, error string"


def mono(data: bytes) -> tuple[np.ndarray, int]:
    """Samples from -1 to 1 and the rate; ValueError for other widths and for what is no such file."""
    try:
        with wave.open(io.BytesIO(data)) as f:
            channels, width, rate, raw = f.getnchannels(), f.getsampwidth(), f.getframerate(), f.readframes(f.getnframes())
    except (wave.Error, EOFError) as e:
        raise ValueError(f"{type(e).__name__}: {e}") from None
    if width not in (2, 3):
        raise ValueError(f"samples of {width} bytes")
    raw = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 4), np.uint8)  # the sample's bytes on top, so that the sign is right
    wide[:, 4 - width :] = raw
    return (wide.view("<i4").ravel() / 2.0**31).reshape(-1, channels).mean(axis=1).astype(np.float32), rate


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            try:
                samples, rate = mono(content.as_py())
                row = {"path": path, "rate": rate, "samples": samples, "error": None}
            except ValueError as e:
                row = {"path": path, "rate": None, "samples": None, "error": str(e)}
            yield pa.RecordBatch.from_pylist([row], kinds)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file; one that cannot be read has an ``error``."""
    small_batches(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    return found.select("path", "content").mapInArrow(_read, _SCHEMA)
