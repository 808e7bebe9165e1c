import gzip
import io
import struct
import zipfile

import numpy as np
import pytest

from seqmill.sources import vgm, vtok
from seqmill.sources.vgm import DAC, END


def log(commands: bytes, version=0x171, gd3=None, samples=0, loop=0):
    head = bytearray(0x100 if version >= 0x150 else 0x40)
    head[:4] = b"Vgm "
    for f, v in {"version": version, "psg_clock": 3579545, "fm_clock": 7670453, "total_samples": samples, "loop_samples": loop}.items():
        struct.pack_into("<I", head, vgm.FIELDS[f], v)
    if version >= 0x150:
        struct.pack_into("<I", head, 0x34, 0x100 - 0x34)
    body = bytes(commands)
    if gd3 is not None:
        struct.pack_into("<I", head, 0x14, len(head) + len(body) - 0x14)
        text = "\0".join(gd3 + [""] * (12 - len(gd3))).encode("utf-16-le")
        body += b"Gd3 " + struct.pack("<II", 0x100, len(text)) + text
    struct.pack_into("<I", head, 0x04, len(head) + len(body) - 4)
    return bytes(head) + body


def rows(commands, **k):
    data = log(bytes(commands), **k)
    return vgm.events(data, vgm.header(data)["data"])[0]


@pytest.mark.parametrize(
    ("commands", "want"),
    [
        ([0x52, 0x28, 0xF0, 0x66], [(0, 0x28, 0xF0, 0, -1), (END, 0, 0, 0, -1)]),
        ([0x53, 0x30, 1], [(1, 0x30, 1, 0, -1)]),
        ([0x50, 0x9F], [(2, 0, 0x9F, 0, -1)]),
        ([0x61, 0x10, 0x27, 0x62, 0x63, 0x7F, 0x70], [(3, 0, 10000 + 735 + 882 + 16 + 1, 0, -1)]),
        ([0x62, 0x50, 1, 0x63, 0x50, 2], [(3, 0, 735, 0, -1), (2, 0, 1, 735, -1), (3, 0, 882, 735, -1), (2, 0, 2, 1617, -1)]),
        ([0x67, 0x66, 0, 3, 0, 0, 0, 7, 8, 9, 0x80, 0x83, 0xE0, 0, 0, 0, 0, 0x80], [(DAC, 0x2A, 7, 0, 0), (DAC, 0x2A, 8, 0, 1), (3, 0, 3, 0, -1), (DAC, 0x2A, 7, 3, 0)]),
        ([0x4F, 1, 0x40, 1, 2, 0xC0, 1, 2, 3, 0xE1, 1, 2, 3, 4, 0x64, 0x90, 0x50, 5], [(2, 0, 5, 0, -1)]),
        ([0x52, 0x28], []),
        ([0x66, 0x50, 1], [(END, 0, 0, 0, -1)]),
        ([0x61, 0, 0, 0x50, 1], [(2, 0, 1, 0, -1)]),
    ],
)
def test_commands(commands, want):
    assert rows(commands) == want


def test_headers_and_bad_files():
    assert vgm.header(log(b"\x66", version=0x110))["data"] == 0x40
    h = vgm.header(log(b"\x66", samples=88200))
    assert (h["version_string"], h["seconds"], h["data"]) == ("1.71", 2.0, 0x100)
    for bad in (b"", b"Vgm ", b"x" * 100):
        with pytest.raises(ValueError):
            vgm.header(bad)


@pytest.mark.parametrize("samples", [0, 1, 16, 17, 735, 882, 1470, 2205, 65535, 65536, 200_000])
def test_waits_add_up(samples):
    got = rows(vgm.wait_bytes(samples))
    assert sum(r[2] for r in got) == samples


def test_writer_round_trip():
    own = [(0, 0x22, 8, 0, -1), (3, 0, 735, 0, -1), (2, 0, 0x9F, 735, -1), (1, 0xB4, 0xC0, 735, -1), (3, 0, 70_000, 735, -1), (END, 0, 0, 70_735, -1)]
    data = vgm.write_bytes(own, loop_row=2)
    h = vgm.header(data)
    assert vgm.events(data, h["data"])[0] == own
    assert h["total_samples"] == 70_735 and h["loop_samples"] == 70_000 and data[h["loop"]] == 0x50
    bank = bytes(range(10))
    drums = [(DAC, 0x2A, 3, 0, 3), (DAC, 0x2A, 4, 0, 4), (3, 0, 9, 0, -1), (DAC, 0x2A, 1, 9, 1), (END, 0, 0, 9, -1)]
    data = vgm.write_bytes(drums, bank=bank)
    assert vgm.events(data, 0x100) == (drums, bank)


def test_tables(spark, tmp_path):
    good = log(bytes([0x52, 0x28, 0xF0, 0x62, 0x66]), gd3=["Boss", "", "Game (USA)", "", "", "", "A and B"], samples=735)
    (tmp_path / "a.vgm").write_bytes(good)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.vgz").write_bytes(gzip.compress(gzip.compress(log(b"\x50\x01\x66"))))
    (tmp_path / "c.vgm").write_bytes(b"broken")
    (tmp_path / "d.txt").write_bytes(good)
    files = vgm.files(spark, str(tmp_path))
    heads = {r.track_id.rsplit("/", 1)[1]: r for r in vgm.read_headers(files).collect()}
    assert set(heads) == {"a.vgm", "b.vgz", "c.vgm"}
    assert heads["a.vgm"].game_en == "Game (USA)" and heads["a.vgm"].author_jp is None and heads["a.vgm"].has_fm_notes and heads["a.vgm"].loop is None
    assert not heads["b.vgz"].has_fm_notes and "ValueError" in heads["c.vgm"].error
    got = vgm.read_events(files)
    assert got.where("error IS NULL").count() == 5 and got.where("error IS NOT NULL").count() == 1
    assert vgm.files(spark, str(tmp_path), most=1).count() == 1
    spark.dataSource.register(vgm.VgmSource)
    assert spark.read.format("vgm").load(str(tmp_path)).where("error IS NULL").count() == 5


def test_unpack_keeps_the_first_of_equal_logs(spark):
    def pack(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members.items():
                z.writestr(name.replace("_", "."), data)
        return out.getvalue()

    packs = spark.createDataFrame([("x/b.zip", pack(one_vgm=b"1", two_vgz=b"2", three_txt=b"3")), ("x/a.zip", pack(zwei_vgm=b"2")), ("bad.zip", b"no")], "pack string, content binary")
    got = sorted((r.name, bytes(r.content)) for r in vgm.unpack(packs).collect())
    assert got == [("a__zwei.vgm", b"2"), ("b__one.vgm", b"1")]


def test_token_files(spark, tmp_path):
    ids = np.array([0, 5, 1023])
    data = vtok.pack(ids, 1024)
    assert vtok.unpack(data)[0].tolist() == ids.tolist()
    for bad in (b"", b"X" + data[1:], data[:-1], data + b"\0"):
        with pytest.raises(ValueError):
            vtok.unpack(bad)
    with pytest.raises(ValueError):
        vtok.pack(np.array([1024]), 1024)
    (tmp_path / "a.vtok").write_bytes(data)
    (tmp_path / "b.vtok").write_bytes(b"bad")
    got = {r.path.rsplit("/", 1)[1]: r for r in vtok.read(spark, str(tmp_path)).collect()}
    assert got["a.vtok"].tokens == [0, 5, 1023] and got["b.vtok"].error
    df = spark.createDataFrame([([1, 2],)], "t array<int>")
    assert bytes(df.select(vtok.column("t", 10).alias("b")).first().b) == vtok.pack(np.array([1, 2]), 10)


def test_logs_end_where_their_header_says(spark):
    whole = log(bytes([0x50, 0x01, 0x52, 0x28, 0xF0]))  # no end mark
    end = len(whole)
    longer = whole + bytes([0x52, 0x28, 0xF1, 0x66])
    h = vgm.header(longer)
    assert h["eof"] == end and vgm.end_of(longer, h) == end and vgm.end_of(whole[:-2], h) == end - 2
    assert vgm.events(longer, h["data"], end)[0] == vgm.events(whole, h["data"])[0] == [(2, 0, 1, 0, -1), (0, 0x28, 0xF0, 0, -1)]
    early = longer[:4] + struct.pack("<I", 0x102 - 4) + longer[8:]  # the key-on lies behind the end
    none = longer[:4] + bytes(4) + longer[8:]  # no end given: nothing before it
    files = spark.createDataFrame([("whole", whole), ("longer", longer), ("early", early), ("none", none)], "track_id string, content binary")
    rows = vgm.read_events(files).where("error IS NULL").groupBy("track_id").count().collect()
    assert {r.track_id: r["count"] for r in rows} == {"whole": 2, "longer": 2, "early": 1}
    assert {r.track_id: r.has_fm_notes for r in vgm.read_headers(files).collect()} == {"whole": True, "longer": True, "early": False, "none": False}
