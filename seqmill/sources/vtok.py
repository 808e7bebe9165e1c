"""Compact token files: magic, version, vocabulary size, count, then 16-bit ids, all little-endian."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
MAGIC, VERSION = b"VTOK", 1
HEAD = "<4sBHI"


def pack(ids: np.ndarray, vocabulary: int) -> bytes:
    ids = np.asarray(ids)
    if len(ids) and (ids.min() < 0 or ids.max() >= vocabulary):
        raise ValueError("an id lies outside the vocabulary")
    return struct.pack(HEAD, MAGIC, VERSION, vocabulary, len(ids)) + ids.astype("<u2").tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, int]:
    size = struct.calcsize(HEAD)
    if len(data) < size:
        raise ValueError("too short")
    magic, version, vocabulary, n = struct.unpack_from(HEAD, data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token file of this version")
    if len(data) != size + 2 * n:
        raise ValueError("wrong length")
    return np.frombuffer(data, "<u2", n, size), vocabulary


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                ids, vocabulary = unpack(content)
                rows.append({"path": path, "vocabulary": vocabulary, "tokens": ids.astype(np.int32), "error": None})
            except ValueError as e:
                rows.append({"path": path, "vocabulary": None, "tokens": None, "error": str(e)})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("vocabulary", pa.int32()), ("tokens", pa.list_(pa.int32())), ("error", pa.string())]))


def read(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.vtok").load(path)
    return found.select("path", "content").mapInArrow(_read, "path string, vocabulary int, tokens array<int>, error string")


def column(tokens: str, vocabulary: int):
    """The file's bytes as a column, for any sink that takes binary."""
    import pandas as pd

    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: pack(np.asarray(x, np.int64), vocabulary))

    run.__annotations__ = {"lists": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")(F.col(tokens))


def write(df: DataFrame, name: str, tokens: str, vocabulary: int, path: str) -> DataFrame:
    """``path, n``: one file for each row, ``name`` under ``path``, written where the row is.

    ``path`` is a URI of a file system that pyarrow knows (a plain path is local); a file appears under
    its name when it is whole, so a task that is run again does no harm. Names must be distinct.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        for b in batches:
            out = []
            for file, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at = f"{root.rstrip('/')}/{file}.vtok"
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                part = f"{at}.{uuid.uuid4().hex}.part"
                values = np.asarray(ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else [], np.int64)
                with system.open_output_stream(part) as f:
                    f.write(pack(values, vocabulary))
                system.move(part, at)
                out.append((at, len(values)))
            paths, sizes = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "n"])

    return df.select(name, tokens).mapInArrow(run, "path string, n long")
