"""Binary register logs (VGM, plain or gzipped) as tables, and the writer for them.

``read_events`` gives a row for each command, ``read_headers`` one for each file and stops before the
commands, ``read_tags`` only the tag block: three tables, so a query reads no more than it needs.
A file that cannot be read is a row with ``error`` and never fails the job.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from seqmill.session import small_batches

#: Kinds of events.
PORT0, PORT1, PSG, WAIT, END, DAC = range(6)
RATE = 44100
TAGS = ("track_en", "track_jp", "game_en", "game_jp", "system_en", "system_jp", "author_en", "author_jp", "date", "ripper", "notes")
#: Fixed values of the format: field -> offset of a little-endian 32-bit number.
FIELDS = {"eof": 0x04, "version": 0x08, "psg_clock": 0x0C, "ym2413_clock": 0x10, "gd3": 0x14, "total_samples": 0x18, "loop": 0x1C, "loop_samples": 0x20, "fm_clock": 0x2C, "data": 0x34}
HEADER_SCHEMA = ", ".join(f"{f} long" for f in FIELDS) + ", version_string string, seconds double"
EVENT_SCHEMA = "track_id string, seq int, type tinyint, register smallint, value int, sample_pos long, pcm_offset long, error string"


def gunzip(data: bytes) -> bytes:
    """Undo gzip as often as it was applied, whatever the file is called."""
    while data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 31)
    return data


def header(data: bytes) -> dict:
    if len(data) < 64 or data[:4] != b"Vgm ":
        raise ValueError("not a VGM file")
    h = {f: struct.unpack_from("<I", data, at)[0] for f, at in FIELDS.items()}
    for f, at in (("eof", 0x04), ("gd3", 0x14), ("loop", 0x1C)):
        h[f] = h[f] + at if h[f] else 0
    h["data"] = h["data"] + 0x34 if h["version"] >= 0x150 and h["data"] else 0x40
    h["version_string"] = f"{h['version'] >> 8:x}.{h['version'] & 0xFF:02x}"
    h["seconds"] = h["total_samples"] / RATE
    return h


def tags(data: bytes, at: int) -> dict | None:
    """Eleven strings; a missing or cut tag block gives None, a missing string an empty one."""
    if not at or data[at : at + 4] != b"Gd3 ":
        return None
    text = data[at + 12 :]
    text = text[: len(text) // 2 * 2].decode("utf-16-le", "replace")
    parts = text.split("\0")[: len(TAGS)]
    return dict(zip(TAGS, parts + [""] * (len(TAGS) - len(parts)), strict=True))


#: Fixed values of the format: bytes of the commands from one to another, themselves included; all others have one.
SPANS = ((0x30, 0x3F, 2), (0x40, 0x4E, 3), (0x4F, 0x50, 2), (0x51, 0x5F, 3), (0x61, 0x61, 3), (0x67, 0x67, 7), (0xA0, 0xBF, 3), (0xC0, 0xDF, 4), (0xE0, 0xFF, 5))
SIZES = [next((size for low, high, size in SPANS if low <= op <= high), 1) for op in range(256)]
FRAME, PAL_FRAME = 735, 882


class _Log:
    """What the commands so far have put out, and the state that they work on."""

    def __init__(self, data: bytes) -> None:
        self.data, self.rows, self.bank, self.cursor, self.clock, self.ended = data, [], b"", 0, 0, False

    def wait(self, samples: int) -> None:
        """Waits in a row are one."""
        if samples and self.rows and self.rows[-1][0] == WAIT:
            _, _, before, begun, _ = self.rows.pop()
            self.rows.append((WAIT, 0, before + samples, begun, -1))
        elif samples:
            self.rows.append((WAIT, 0, samples, self.clock, -1))
        self.clock += samples

    def number(self, at: int) -> int:
        return int.from_bytes(self.data[at : at + 4], "little")

    def block_size(self, at: int) -> int:
        return self.number(at + 3) & 0x7FFFFFFF

    def fm(self, op: int, at: int) -> None:
        self.rows.append((PORT1 if op & 1 else PORT0, self.data[at + 1], self.data[at + 2], self.clock, -1))

    def psg(self, op: int, at: int) -> None:
        self.rows.append((PSG, 0, self.data[at + 1], self.clock, -1))

    def long_wait(self, op: int, at: int) -> None:
        self.wait(int.from_bytes(self.data[at + 1 : at + 3], "little"))

    def frame(self, op: int, at: int) -> None:
        self.wait(PAL_FRAME if op & 1 else FRAME)

    def short_wait(self, op: int, at: int) -> None:
        self.wait((op & 15) + 1)

    def sample(self, op: int, at: int) -> None:
        if self.cursor < len(self.bank):
            self.rows.append((DAC, 0x2A, self.bank[self.cursor], self.clock, self.cursor))
            self.cursor += 1
        self.wait(op & 15)

    def block(self, op: int, at: int) -> int:
        """A block of data, of which only the kind of sample banks counts; its bytes follow the command."""
        size = self.block_size(at)
        if self.data[at + 2] == 0:
            self.bank = self.data[at + 7 : at + 7 + size]
        return size

    def seek(self, op: int, at: int) -> None:
        self.cursor = self.number(at + 1)

    def end(self, op: int, at: int) -> None:
        self.rows.append((END, 0, 0, self.clock, -1))
        self.ended = True


#: What a command does; None: nothing that counts here.
HANDLERS: list = [None] * 256
for _ops, _handler in (
    ((0x52, 0x53), _Log.fm), ((0x50,), _Log.psg), ((0x61,), _Log.long_wait), ((0x62, 0x63), _Log.frame), ((0x66,), _Log.end), ((0x67,), _Log.block), (range(0x70, 0x80), _Log.short_wait), (range(0x80, 0x90), _Log.sample), ((0xE0,), _Log.seek),
):
    for _op in _ops:
        HANDLERS[_op] = _handler


def end_of(data: bytes, h: dict) -> int:
    """Where the header says that the log ends, if the file is that long; what follows is not read."""
    return min(h["eof"] or FIELDS["eof"], len(data))


def events(data: bytes, start: int, stop: int | None = None) -> tuple[list[tuple], bytes]:
    """Rows (type, register, value, sample_pos, pcm_offset) and the last PCM bank. A cut command ends the log."""
    log, at, n = _Log(data), start, len(data) if stop is None else stop
    while at < n and not log.ended:
        op = data[at]
        size, handler = SIZES[op], HANDLERS[op]
        if at + size > n:
            break
        if handler is not None:
            size += handler(log, op, at) or 0
        at += size
    return log.rows, log.bank


def has_notes(data: bytes, start: int, stop: int | None = None) -> bool:
    """Is any FM channel keyed on? Stops at the first. Of a block whose head is cut only the first byte is skipped."""
    log, at, n = _Log(data), start, len(data) if stop is None else stop
    while at < n and (op := data[at]) != 0x66:
        if op == 0x52 and at + 2 < n and data[at + 1] == 0x28 and data[at + 2] & 0xF0 and data[at + 2] & 3 != 3:
            return True
        if op == 0x67:
            at += 7 + log.block_size(at) if at + 7 <= n else 1
        else:
            at += SIZES[op]
    return False


# -- tables ---------------------------------------------------------------------------------------


def files(spark: SparkSession, path: str, pattern: str = "*.vg[mz]", most: int | None = None) -> DataFrame:
    """``track_id, content``: the files under ``path``; with ``most`` the first by name."""
    small_batches(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    found = found.select(F.col("path").alias("track_id"), "content").dropDuplicates(["track_id"])
    return found.orderBy("track_id").limit(most) if most is not None else found


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in EVENT_SCHEMA.split(", ")]
    types = [pa.string(), pa.int32(), pa.int8(), pa.int16(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    for b in batches:
        for track, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            try:
                data = gunzip(content.as_py() or b"")
                h = header(data)
                rows, _ = events(data, h["data"], end_of(data, h))
                out = [(track, k, t, r, v, s, p if p >= 0 else None, None) for k, (t, r, v, s, p) in enumerate(rows)]
            except (ValueError, zlib.error, struct.error) as e:
                out = [(track, *(None,) * 6, f"{type(e).__name__}: {e}")]
            for at in range(0, len(out), 100_000):
                part = list(zip(*out[at : at + 100_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, types, strict=True)], names=names)


def read_events(found: DataFrame) -> DataFrame:
    """A row for each command of files(); waits carry their length as value. Unreadable: one row with ``error``."""
    return found.select("track_id", "content").mapInArrow(_events, EVENT_SCHEMA)


def drum_writes(rows: DataFrame) -> DataFrame:
    """``track_id, seq, sample_pos, pcm_offset, value, seek``: writes of sample bytes; ``seek`` where one does not follow the byte before."""
    w = Window.partitionBy("track_id").orderBy("seq")
    own = rows.where((F.col("type") == DAC) & F.col("error").isNull()).select("track_id", "seq", "sample_pos", "pcm_offset", "value")
    return own.withColumn("seek", F.col("pcm_offset").isNotNull() & ~F.col("pcm_offset").eqNullSafe(F.lag("pcm_offset").over(w) + 1))


def _heads(notes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("track_id", pa.string()), *((f, pa.int64()) for f in FIELDS), ("version_string", pa.string()), ("seconds", pa.float64()), ("has_fm_notes", pa.bool_()), ("bytes", pa.int64()), *((t, pa.string()) for t in TAGS), ("error", pa.string())])
        for b in batches:
            rows = []
            for track, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                row: dict = {"track_id": track}
                try:
                    data = gunzip(content.as_py() or b"")
                    row |= header(data)
                    row |= {"has_fm_notes": has_notes(data, row["data"], end_of(data, row)) if notes else None, "bytes": len(data)} | (tags(data, row["gd3"]) or {})
                except (ValueError, zlib.error, struct.error) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_headers(found: DataFrame, notes: bool = True) -> DataFrame:
    """A row for each file: header, tags (empty ones null), whether it has FM notes, ``error``.

    Without ``notes`` the commands are not looked at, and ``has_fm_notes`` is null.
    """
    schema = f"track_id string, {HEADER_SCHEMA}, has_fm_notes boolean, bytes long, " + ", ".join(f"{t} string" for t in TAGS) + ", error string"
    heads = found.select("track_id", "content").mapInArrow(_heads(notes), schema)
    empty = {t: F.nullif(F.trim(t), F.lit("")) for t in TAGS}
    zero = {f: F.nullif(f, F.lit(0)) for f in ("gd3", "loop", "ym2413_clock")}
    return heads.withColumns(empty | zero)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for pack, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            try:
                z = zipfile.ZipFile(io.BytesIO(content.as_py()))
            except zipfile.BadZipFile:
                continue
            for name in sorted(z.namelist()):
                if name.lower().endswith((".vgm", ".vgz")):
                    data = z.read(name)
                    yield pa.RecordBatch.from_arrays([pa.array([pack]), pa.array([name]), pa.array([data], pa.binary())], names=["pack", "member", "content"])


def unpack(packs: DataFrame) -> DataFrame:
    """``pack, member, name, content``: the logs of zip files (pack, content), of equal contents the first by pack and member."""
    from seqmill.functions.text import safe_file_name
    from seqmill.operators.corpus import first_wins

    members = packs.select("pack", "content").mapInArrow(_members, "pack string, member string, content binary")
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    kept = first_wins(members, F.sha2("content", 256), ["pack", "member"])
    return kept.withColumn("name", safe_file_name(F.concat(F.regexp_replace(base("pack"), r"\.zip$", ""), F.lit("__"), base("member"))))


class VgmSource(DataSource):
    """``spark.read.format("vgm").load(folder)`` once registered; one partition for each file.

    For file systems that Python opens itself; read_events() goes through Spark's own reader.
    """

    @classmethod
    def name(cls) -> str:
        return "vgm"

    def schema(self) -> str:
        return EVENT_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _VgmReader(self.options["path"])


class _VgmReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        root = Path(self.path.removeprefix("file://"))
        found = [root] if root.is_file() else sorted({p.resolve() for p in root.rglob("*") if p.suffix.lower() in (".vgm", ".vgz")})
        return [InputPartition(str(p)) for p in found]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open(partition.value, "rb") as f:
            batch = pa.RecordBatch.from_arrays([pa.array([partition.value]), pa.array([f.read()], pa.binary())], names=["track_id", "content"])
        yield from _events(iter([batch]))


# -- writing --------------------------------------------------------------------------------------


def wait_bytes(samples: int) -> bytes:
    """The shortest usual commands for a wait: frames, short waits, and 16-bit waits."""
    out = bytearray()
    while samples > 0:
        if samples == 735:
            return bytes(out) + b"\x62"
        if samples == 882:
            return bytes(out) + b"\x63"
        if samples <= 16:
            return bytes(out) + bytes([0x70 + samples - 1])
        if samples % 735 == 0 and samples // 735 <= 3:
            return bytes(out) + b"\x62" * (samples // 735)
        part = min(samples, 65535)
        out += struct.pack("<BH", 0x61, part)
        samples -= part
    return bytes(out)


def write_bytes(rows: list[tuple], fm_clock: int = 7670453, psg_clock: int = 3579545, loop_row: int | None = None, bank: bytes = b"", version: int = 0x171, tags: dict[str, str] | None = None) -> bytes:
    """A file of rows (type, register, value, sample_pos, pcm_offset), with a loop from ``loop_row`` on, and tags by their names in TAGS."""
    body, total, loop_at, loop_from = bytearray(), 0, 0, 0
    if bank:
        body += struct.pack("<BBBI", 0x67, 0x66, 0, len(bank)) + bank
    cursor = -1 if bank else None
    for k, (kind, register, value, _, offset) in enumerate(rows):
        if k == loop_row:
            loop_at, loop_from = 0x100 + len(body), total
        if kind in (PORT0, PORT1):
            body += bytes([0x52 + kind, register, value])
        elif kind == PSG:
            body += bytes([0x50, value])
        elif kind == WAIT:
            body += wait_bytes(value)
            total += value
        elif kind == DAC:
            if cursor is None:
                body += bytes([0x52, 0x2A, value])
            else:
                if offset != cursor:
                    body += struct.pack("<BI", 0xE0, offset)
                body += b"\x80"
                cursor = offset + 1
        elif kind == END:
            break
    body += b"\x66"
    head, gd3 = bytearray(0x100), 0
    head[:4] = b"Vgm "
    if tags:
        gd3 = len(head) + len(body)
        text = "".join(tags.get(t, "") + "\0" for t in TAGS).encode("utf-16-le")
        body += b"Gd3 " + struct.pack("<II", 0x100, len(text)) + text
    size = len(head) + len(body)
    for f, v in {"eof": size - 4, "version": version, "psg_clock": psg_clock, "fm_clock": fm_clock, "total_samples": total, "data": 0x100 - 0x34}.items():
        struct.pack_into("<I", head, FIELDS[f], v)
    if gd3:
        struct.pack_into("<I", head, FIELDS["gd3"], gd3 - FIELDS["gd3"])
    if loop_at:
        struct.pack_into("<I", head, FIELDS["loop"], loop_at - FIELDS["loop"])
        struct.pack_into("<I", head, FIELDS["loop_samples"], total - loop_from)
    return bytes(head + body)


def write_tracks(rows: DataFrame, bank: bytes = b"") -> DataFrame:
    """``track_id, content``: event rows grouped back to files. One track is one task's work.

    With a ``bank`` of samples every file holds it, and drum writes play it from their ``pcm_offset`` on.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        cols = [table.column(c).to_pylist() for c in ("type", "register", "value", "sample_pos")]
        offsets = table.column("pcm_offset").to_pylist() if bank and "pcm_offset" in table.column_names else [None] * table.num_rows
        data = write_bytes([(*r, -1 if o is None else o) for *r, o in zip(*cols, offsets, strict=True)], bank=bank)
        return pa.table({"track_id": [table.column("track_id")[0].as_py()], "content": pa.array([data], pa.binary())})

    return rows.where("error IS NULL").groupBy("track_id").applyInArrow(run, "track_id string, content binary")
