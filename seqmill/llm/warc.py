"""WARC archives of one gzip member for each record: written and read by Spark, on any file system.

Writing. A member's last byte is the top byte of its length, so it is zero for records below 16 MiB,
and a longer record is followed by an empty member. Spark's text writer puts a separator after each
row; with the zero byte as separator and rows cut before it, its files are plain concatenations of
members, which is what a compressed WARC file is.

Reading. Splits of a file are byte ranges. Spark's line reader scans each for the separator, here the
gzip magic, and a range owns what starts inside it, reading on past its end. The magic also occurs
within members, so each piece is only a candidate: if its bytes do not start a member whose decoded
head is that of a record, it belongs to the member before. A piece too short to tell waits for those
after it. Where a range's end falls between the two, the pieces are put together in a second step;
those are few (one in 2**24 bytes starts like a member).

Known limit: a record that holds another archive's members stored as they are, across a range's end,
may have these taken for records of their own.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmill.session import scratch_path, small_batches, stored

MAGIC = b"\x1f\x8b\x08"
HEAD = b"WARC/"
LEVEL = 4
REVISIT_FROM = 1000  # bytes of a payload that a record may revisit
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # archives of equal pages are equal
_EMPTY = zlib.compressobj(LEVEL, zlib.DEFLATED, 31).flush()

RECORD = "record_type string, record_id string, target_uri string, refers_to string, declared_digest string, declared_bytes long, payload binary"


# -- records --------------------------------------------------------------------------------------


def _line(text: str | None) -> str:
    return " ".join((text or "").split())


def record(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or with ``refers_to`` a revisit record, which leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(uri)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, and an empty one after it if it does not end in a zero byte."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + _EMPTY


def _headers(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, rest


def _number(text: str | None) -> int | None:
    """A length as it stands in a header; what is none is missing."""
    return int(text) if text is not None and text.isascii() and text.isdigit() and len(text) < 19 else None


def _digest_hex(text: str | None) -> str | None:
    """A SHA-1 in base32 or hexadecimal digits; what is neither, or another hash, is missing."""
    kind, _, value = (text or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        raw = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


def parse(data: bytes) -> tuple | None:
    """A decoded member -> the columns of RECORD; None for what holds no record.

    Only blocks of HTTP messages have a payload apart from their headers; of other records the block is
    the payload. Without a length the block is all that follows; headers that cannot be read are null.
    """
    if not data.startswith(HEAD):
        return None
    head, rest = _headers(data)
    size = _number(head.get("content-length"))
    block = rest if size is None else rest[:size]
    http, payload = _headers(block) if head.get("content-type", "").startswith("application/http") else ({}, block)
    urn = lambda x: x.removeprefix("<urn:page:").removesuffix(">") if x is not None else None
    said = _number(http.get("content-length"))
    return (
        head.get("warc-type"), urn(head.get("warc-record-id")), head.get("warc-target-uri"), urn(head.get("warc-refers-to")),
        _digest_hex(head.get("warc-payload-digest")), len(payload) if said is None else said, payload,
    )


# -- writing --------------------------------------------------------------------------------------


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, uri, payload, digest, refers in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            out.append(member(record(i, uri, payload, digest, refers))[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_FROM) -> None:
    """Write a record for each row. Null html is an empty payload; a null id is written as no id.

    Of rows with equal payloads of ``least`` bytes at least, those with the largest id respond and the
    others revisit it; without any id all respond.
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("uri"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    # only payloads that have a copy are joined; the small ones, among which the commonest are, go straight to the archive
    size = F.length("payload")
    last = rows.where(size >= least).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("digest", "last")
    joined = rows.where(size >= least).join(stored(last, "copies"), "digest", "left")
    all_rows = joined.unionByName(rows.where(size < least).withColumn("last", F.lit(None).cast("long")))
    refers = F.when(F.coalesce(F.col("id") != F.col("last"), F.col("last").isNotNull()), F.col("last").cast("string"))
    out = all_rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "uri", "payload", "digest", refers.alias("refers"))
    members = out.mapInArrow(_members, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("encoding", "ISO-8859-1").option("compression", "none").text(path)


# -- reading --------------------------------------------------------------------------------------


class _Range:
    """The candidates of one byte range, in order: records it owns, and pieces that the ends cut off."""

    def __init__(self) -> None:
        self.open: zlib._Decompress | None = None
        self.raw: list[bytes] = []
        self.out: list[bytes] = []
        self.early: list[bytes] = []  # before the first record: ends of a member that starts before
        self.begun = False
        self.sure = False  # is what is open known to be a record?

    def feed(self, piece: bytes) -> list[bytes]:
        """A piece with the magic before it -> the decoded members that it completes."""
        done, todo = [], [piece]
        while todo:
            piece = todo.pop()
            if self.open is None:
                self.open, self.raw, self.out, self.sure = zlib.decompressobj(31), [], [], False
            self.raw.append(piece)
            try:
                self.out.append(self.open.decompress(piece))
            except zlib.error:
                if self.sure:  # a broken member: what follows may be one
                    todo.append(piece)
                else:
                    todo += self._reject()
                self.open = None
                continue
            if not self.sure:
                head = b"".join(self.out)[: len(HEAD)]
                self.sure = head == HEAD or self.open.eof and not head
                if not self.sure and (self.open.eof or not HEAD.startswith(head)):
                    todo += self._reject()
                    self.open = None
                    continue
                self.begun |= self.sure
            if self.open.eof:
                self.open = None
                done.append(b"".join(self.out))
        return done

    def _reject(self) -> list[bytes]:
        """No record starts here after all -> the pieces that waited with the first, the last one first."""
        if not self.begun:
            self.early.append(self.raw[0])
        return self.raw[:0:-1]

    def left(self) -> list[tuple[str, bytes]]:
        """What the range's end cuts off: early pieces, then what is open and, while that is not sure, its pieces apart."""
        cut = [("early", x) for x in self.early]
        if self.open is None:
            return cut
        if self.sure:
            return [*cut, ("open", b"".join(self.raw))]
        if not self.begun:
            return cut + [("early", x) for x in self.raw]
        return [*cut, ("open", self.raw[0]), *(("tail", x) for x in self.raw[1:])]


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, value) in file order -> records, and rows that hold cut-off pieces (``kind`` not null)."""
    at, own, rows, size = None, _Range(), [], 0

    def left() -> list[tuple]:
        return [] if at is None else [(*at, kind, x) for kind, x in own.left()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["record_type", "record_id", "target_uri", "refers_to", "declared_digest", "declared_bytes", "payload", "path", "start", "kind", "piece"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    cut = lambda xs: [(None,) * 7 + (p, s, k, x) for p, s, k, x in xs]
    for b in batches:
        for path, start, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if (path, start) != at:
                rows += cut(left())
                at, own = (path, start), _Range()
                if start == 0:
                    continue  # what stands before the first magic of a file
            for found in own.feed(MAGIC + value.as_py()):
                if (r := parse(found)) is not None:
                    rows.append((*r, None, None, None, None))
                    size += len(found)
            if size > 4 << 20:
                yield batch(rows)
                rows, size = [], 0
    rows += cut(left())
    if rows:
        yield batch(rows)


def _join_pieces(table: pa.Table) -> pa.Table:
    """Grouped by file: open members and the pieces that the ranges after them begin with."""
    rows = sorted(zip(table.column("start").to_pylist(), range(table.num_rows), table.column("kind").to_pylist(), table.column("piece").to_pylist(), strict=True), key=lambda r: (r[0], ("early", "open", "tail").index(r[2]), r[1]))
    out, own = [], _Range()
    for _, _, kind, piece in rows:
        if kind == "open":
            own = _Range()
        out += [r for found in own.feed(piece) if (r := parse(found)) is not None]
    types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``, in the columns of RECORD."""
    small_batches(spark)
    lines = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").option("pathGlobFilter", "*").text(path)
    ranges = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    decoded = ranges.mapInArrow(_decode, f"{RECORD}, path string, start long, kind string, piece binary")
    names = [x.split()[0] for x in RECORD.split(", ")]
    cut = decoded.where("kind is not null").select("path", "start", "kind", "piece")
    return decoded.where("kind is null").select(*names).unionByName(cut.groupBy("path").applyInArrow(_join_pieces, RECORD))


def archive(pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read these back."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, **columns)
    return read(pages.sparkSession, path)


def describe(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)``; of responses from the payload itself."""
    response = F.col("record_type") == "response"
    return records.select(
        F.col("record_id").try_cast("long").alias("page_id"),
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").try_cast("long").alias("refers_to"),
    )
