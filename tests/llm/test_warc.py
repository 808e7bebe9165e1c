import base64
import gzip
import hashlib
import random
import struct
import zlib

from seqmill.llm import warc


def test_members_end_in_zero_and_decode():
    for data in (b"", b"x", b"y" * 10_000, bytes(17 << 20)):
        m = warc.member(data)
        assert m[-1] == 0 and gzip.decompress(m) == data


def archive_bytes(n, seed=1):
    rng = random.Random(seed)
    out, payloads = [], []
    for k in range(n):
        payload = bytes(rng.randrange(256) for _ in range(rng.randrange(0, 400)))
        if k % 3 == 0:  # the magic inside a payload, stored as it is where it does not compress
            payload += warc.MAGIC + b"\0" + payload[:50] + warc.MAGIC
        payloads.append(payload)
        out.append(warc.member(warc.record(str(k), f"http://x/{k}", payload, hashlib.sha1(payload).hexdigest(), None)))
    return b"".join(out), payloads


def test_any_range_size_reads_each_record_once(spark, tmp_path):
    data, payloads = archive_bytes(120)
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(data)
    want = sorted(2 * [(str(k), p) for k, p in enumerate(payloads)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for size in (97, 1000, 4096, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            got = sorted((r.record_id, bytes(r.payload)) for r in warc.read(spark, str(tmp_path)).collect())
            assert got == want, size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_cut_members_are_put_together():
    """Ranges that end at a magic inside a member: by hand, as these are rare."""
    import pyarrow as pa

    body = warc.record("1", "u", bytes(range(256)) * 9, "00" * 20, None)
    z = warc.member(body)
    cut = len(z) // 2
    rows = [{"path": "p", "start": 0, "kind": "open", "piece": z[:cut]}, {"path": "p", "start": 50, "kind": "early", "piece": z[cut : cut + 5]}, {"path": "p", "start": 90, "kind": "early", "piece": z[cut + 5 :]}]
    table = pa.Table.from_pylist(rows[::-1])
    assert warc._join_pieces(table).column("record_id").to_pylist() == ["1"]


def test_response_and_revisit(spark):
    big, small = "p" * 1000, "q" * 999
    rows = [(1, "http://a\r\nX: y", big), (7, None, big), (3, "u", big), (2, "u", small), (9, "u", small), (4, "u", None), (5, "u", ""), (None, "u", big), (7, "u", big), (6, "u", "é" * 500), (8, "u", "é" * 500)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.describe(warc.archive(df)).collect())
    sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    want = [(0, "revisit", 7, 1000, sha(big)), (1, "revisit", 7, 1000, sha(big)), (2, "response", None, 999, sha(small)), (3, "revisit", 7, 1000, sha(big)), (4, "response", None, 0, sha("")), (5, "response", None, 0, sha("")), (6, "revisit", 8, 1000, sha("é" * 500)), (7, "response", None, 1000, sha(big)), (7, "response", None, 1000, sha(big)), (8, "response", None, 1000, sha("é" * 500)), (9, "response", None, 999, sha(small))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.describe(warc.archive(df.limit(0))).count() == 0


def late_member(data, extra, cuts):
    """A member with the magic in its header, before any output, and again in stored blocks that output letter by letter."""
    z = zlib.compressobj(0, zlib.DEFLATED, -15)
    body = b"".join(z.compress(data[k : k + 1]) + z.flush(zlib.Z_FULL_FLUSH) for k in range(cuts)) + z.compress(data[cuts:]) + z.flush()
    extra = b"xx" + struct.pack("<H", len(extra)) + extra
    out = warc.MAGIC + b"\x04" + bytes(6) + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data))
    return out if out[-1] == 0 else out + warc._EMPTY


def test_the_magic_before_any_output(spark, tmp_path):
    """Pieces too short to tell wait for what follows, across range ends as well."""
    out = []
    for k in range(60):
        payload = bytes(k * j % 251 for j in range(40 * (k % 7)))
        data = warc.record(str(k), f"http://x/{k}", payload, hashlib.sha1(payload).hexdigest(), None)
        out.append(late_member(data, b"a" * (k % 9) + warc.MAGIC + b"b" * (k % 40) + (warc.MAGIC + b"\0\0\0\0\0\0\3") * (k % 3), k % 6) if k % 4 else warc.member(data))
    assert b"".join(gzip.decompress(m) for m in out).count(b"WARC/1.1") == 60
    (tmp_path / "a.warc").write_bytes(b"".join(out))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for size in (1 << 20, 1000, 211):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            got = sorted(int(r.record_id) for r in warc.read(spark, str(tmp_path)).collect())
            assert got == list(range(60)), size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_records_of_others():
    """Malformed headers are null, records that are no HTTP message keep their block."""
    make = lambda *head, block=b"": ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    info = warc.parse(make("WARC-Type: warcinfo", "Content-Type: application/warc-fields", "Content-Length: 14", block=b"a: b\r\n\r\nc: d\r\n"))
    assert info == ("warcinfo", None, None, None, None, 14, b"a: b\r\n\r\nc: d\r\n")
    http = b"HTTP/1.1 200 OK\r\nContent-Length: x\r\n\r\nbody"
    sha = hashlib.sha1(b"body").hexdigest()
    for digest, want in ((f"sha1:{sha}", sha), ("sha1:" + base64.b32encode(bytes.fromhex(sha)).decode().lower(), sha), ("md5:00", None), ("sha1:!!", None), ("", None)):
        for length in (str(len(http)), "no number", "-3", "\u0663"):
            got = warc.parse(make("WARC-Type: response", f"WARC-Payload-Digest: {digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {length}", block=http))
            assert got[0] == "response" and got[4] == want and got[6].startswith(b"body") and got[5] == len(got[6])
    assert warc.parse(b"WARC/1.1") is not None and warc.parse(b"none") is None


def test_foreign_archives_are_read(spark, tmp_path):
    """Members of other writers, a broken one among them, by small ranges."""
    records = [warc.record(str(k), "u", bytes([65 + k % 26]) * (k * 37 % 3000), hashlib.sha1(b"").hexdigest(), None) for k in range(60)]
    odd = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: oops\r\nWARC-Payload-Digest: sha1:zz\r\n\r\nx\r\n\r\n"
    data = b"".join(gzip.compress(r) for r in [*records[:30], odd, *records[30:]])
    (tmp_path / "a.warc.gz.bin").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = warc.read(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((int(r.record_id), len(r.payload)) for r in got if r.record_type == "response") == [(k, k * 37 % 3000) for k in range(60)]
    assert sum(r.record_type == "metadata" for r in got) == 1
