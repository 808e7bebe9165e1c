"""Token counts by a separator scan of flat, unindexed token files.

A flat file is the ids of one document after the other, each followed by the end-of-document id, as
little-endian integers of two or four bytes, and nothing else.

Reading. Splits of a file are byte ranges. Spark's line reader, with the bytes of the separator
between its lines, gives a range what starts in it; joined again, the lines are the range's bytes, in
memory a bounded number at a time. numpy searches them for the separator. Where a range's bytes begin
within an id is not known before those of the ranges before it are counted, so a range is searched at
each of the two or four alignments, and prefix sums of bytes then say which holds. Each block yields
the documents that lie inside it, and the tokens before its first and after its last separator; a
prefix scan over the blocks of a file adds these loose ends up: a document that spans blocks is the
tail of one, whole blocks without a separator, and the head of the next.

Writing. One pass writes both the flat files and, beside each, which document stands where: a task
sends two kinds of rows to two folders, in files of its own number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.llm.bpe import codec
from seqmill.session import scratch_path, small_batches, stored

BLOCK = 1 << 20  # bytes of a block
END = 50256  # the end-of-document id of the production vocabulary
TOKENS, PLACES = "tokens", "places"  # folders of flat files and of their lists of documents


def _flat(path: str, end: int, width: int):
    """(doc_id, text) -> (kind, place, value): a row of ids, and one that says which document they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, place = codec(path, library=True), 0
        for b in batches:
            n, values = b.num_rows, []
            for t in b.column(1).to_pylist():
                x = tokens.encode(t)
                if (x == end).any():  # the text spells the separator: its bytes are encoded as plain text
                    x = np.frombuffer(tokens._plain(t), "<u4")
                if width == 2 and len(x) and x.max() >= 1 << 16:
                    raise ValueError("ids need four bytes")
                values.append(x.astype(f"<u{width}").tobytes())
            places = np.arange(place, place + n, dtype=np.int64)
            place += n
            values += [f"{p} {'' if i is None else i}".encode() for p, i in zip(places.tolist(), b.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([TOKENS] * n + [PLACES] * n), pa.array(np.concatenate([places, places])), pa.array(values, pa.binary())], names=["kind", "place", "value"])

    return run


def _text_options(end: int, width: int) -> dict[str, str]:
    return {"lineSep": _separator(end, width).decode("latin-1"), "encoding": "ISO-8859-1"}


def _separator(end: int, width: int) -> bytes:
    mark = end.to_bytes(width, "little")
    if any(mark[:k] == mark[-k:] for k in range(1, width)):
        raise ValueError(f"the bytes of the separator {end} overlap themselves, so it cannot be told where ranges meet")
    return mark


def write(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, width: int = 2) -> DataFrame:
    """Write flat files under ``path/kind=tokens``; returns ``(doc_id, part, place)``: which document is where.

    Null and empty texts are documents of no tokens. A text that spells the separator is plain text.
    Each task writes one file, numbered like the task, and the list of its documents beside it.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    encoded = rows.mapInArrow(_flat(tokenizer, end, width), "kind string, place long, value binary")
    # sorted as the writer wants its folders, so that rows keep their order
    in_order = encoded.sortWithinPartitions("kind", "place").select("kind", F.col("value").cast("string").alias("value"))
    in_order.write.partitionBy("kind").options(**_text_options(end, width), compression="none", maxRecordsPerFile="0").text(path)
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, part int, place long")
    listed = docs.sparkSession.read.options(**_text_options(end, width)).text(f"{path}/kind={PLACES}")
    said = F.split(F.col("value"), " ")
    return listed.select(said[1].try_cast("long").alias("doc_id"), _part(F.col("_metadata.file_path")).alias("part"), said[0].cast("long").alias("place"))


def _part(file):
    return F.regexp_extract(file, r"part-(\d+)-", 1).cast("int")


class _Alignment:
    """A range's bytes as ids, if its first byte stands ``offset`` bytes behind the begin of an id."""

    def __init__(self, offset: int, end: int, width: int) -> None:
        self.offset, self.end, self.width = offset, end, width
        self.skip = (width - offset) % width  # bytes of an id that begins before the range
        self.held, self.loose = b"", int(offset > 0)  # that id counts here

    def block(self, data: bytes) -> tuple[int, int, int, np.ndarray]:
        """Separators, tokens before the first and after the last, and between them."""
        data = self.held + data
        begin = min(self.skip, len(data))
        self.skip -= begin
        stop = begin + (len(data) - begin) // self.width * self.width
        self.held = data[stop:]
        ids = np.frombuffer(data[begin:stop], f"<u{self.width}")
        at, loose = np.flatnonzero(ids == self.end), self.loose
        self.loose = 0
        if not len(at):
            return 0, len(ids) + loose, 0, at
        return len(at), int(at[0]) + loose, len(ids) - int(at[-1]) - 1, np.diff(at) - 1


_SCAN = "file string, start long, size long, offset int, block long, bytes long, ends long, head long, tail long, inner array<long>"


def _scan(end: int, width: int, block_bytes: int):
    mark = _separator(end, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, block = None, [], 0
        held: list[bytes] = []
        n = 0

        def out() -> pa.RecordBatch:
            data = b"".join(held)
            found = [(*at, a.offset, block, len(data), *a.block(data)) for a in own]
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=[x.split()[0] for x in _SCAN.split(", ")])

        for b in batches:
            for file, start, total, value in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
                if (file, start, total) != at:
                    if held:
                        yield out()
                    at, own, block, held, n = (file, start, total), [_Alignment(k, end, width) for k in range(width)], 0, [], 0
                held.append(value.as_py() + mark)
                n += len(held[-1])
                if n >= block_bytes:
                    yield out()
                    block, held, n = block + 1, [], 0
        if held:
            yield out()

    return run


def count(spark: SparkSession, path: str, end: int = END, width: int = 2, block: int = BLOCK) -> DataFrame:
    """``(file, place, n_tokens)`` for every document of the flat files under ``path``; places count from 0.

    Tokens after a file's last separator are a document that was cut off: it counts if it has any;
    bytes that make no whole id at a file's end do not count. ``block`` is the number of bytes searched
    at a time, or one document where that is longer. Separators whose bytes overlap themselves (as of
    id 0) are an error.
    """
    small_batches(spark)
    lines = spark.read.options(**_text_options(end, width), recursiveFileLookup="true").text(path)
    ranges = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    scanned = stored(ranges.mapInArrow(_scan(end, width, block), _SCAN), "scan")
    # alignments: bytes of the ranges before, by file; each range is taken at the one that holds
    sizes = scanned.where("offset = 0").groupBy("file", "start").agg(F.sum("bytes").alias("n"))
    past = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    aligned = sizes.select("file", "start", (past % width).cast("int").alias("offset"))
    true = scanned.join(aligned, ["file", "start", "offset"])
    # prefix scan: separators before a block, and the tokens that are open when it begins
    order = W.partitionBy("file").orderBy("start", "block")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    run = F.coalesce(F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(earlier), F.lit(0))
    stitched = true.select("file", "start", "block", "size", "bytes", "ends", "head", "tail", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("before"), run.alias("run"))
    since = W.partitionBy("file", "run").orderBy("start", "block").rowsBetween(W.unboundedPreceding, -1)
    # the blocks of one run: the first may follow a tail, those after it have no separator but the last
    tail = F.coalesce(F.lag("tail").over(order), F.lit(0))
    loose = stitched.withColumn("tail_before", F.when(F.col("run") == 0, 0).otherwise(tail))
    opened = loose.withColumn("open", F.coalesce(F.first("tail_before").over(W.partitionBy("file", "run").orderBy("start", "block")), F.lit(0)) + F.coalesce(F.sum("head").over(since), F.lit(0)))
    opened = stored(opened.select("file", "start", "block", "size", "bytes", "ends", "head", "tail", "before", "open"), "stitched")
    inner = true.where("ends > 0").select("file", "start", "block", "inner")
    closed = opened.where("ends > 0").join(inner, ["file", "start", "block"]).select("file", "before", F.concat(F.array(F.col("open") + F.col("head")), "inner").alias("sizes"))
    whole = closed.select("file", "before", F.posexplode("sizes").alias("k", "n_tokens")).select("file", (F.col("before") + F.col("k")).alias("place"), "n_tokens")
    at = F.struct("start", "block")
    open_end = F.max_by(F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("open") + F.col("head")), at)
    # a separator put after a file's last bytes closes the last document, but counts as an id where these end within one
    cut = F.when((F.sum("bytes") != F.max("size")) & (F.max("size") % width != 0), 1).otherwise(0)
    last = opened.groupBy("file").agg(F.sum("ends").alias("place"), (open_end - cut).alias("n_tokens"))
    return whole.unionByName(last.where("n_tokens > 0").select("file", "place", "n_tokens"))


def count_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_tokens)``: write ``docs`` to flat files, scan these, and look up which document is where."""
    spark = docs.sparkSession
    path = scratch_path(spark, "flat")
    listed = write(docs, tokenizer, path, id_col, text_col, end)
    if listed.isEmpty():
        return listed.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    counted = count(spark, f"{path}/kind={TOKENS}", end, 2, block)
    placed = counted.select(_part(F.col("file")).alias("part"), "place", "n_tokens")
    return listed.join(placed, ["part", "place"], "left").select("doc_id", "n_tokens")
