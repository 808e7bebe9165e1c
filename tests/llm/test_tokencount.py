import numpy as np
import pytest

from seqmill.llm import bpe, tokencount
from seqmill.llm.queries import vocabulary


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
@pytest.mark.parametrize("cut", [False, True])
def test_scan_by_definition(spark, tmp_path, block, cut):
    rng = np.random.default_rng(block)
    want = []
    for f in range(3):
        sizes = rng.choice([0, 0, 1, 5, 40], 30).tolist()
        ids = np.concatenate([np.append(rng.integers(0, 50, n), 99) for n in sizes]).astype("<u2")
        if cut:  # a document without its separator at the end
            ids = np.append(ids, [1, 2, 3]).astype("<u2")
            sizes.append(3)
        (tmp_path / f"f{f}").write_bytes(ids.tobytes())
        want += [(f"f{f}", k, n) for k, n in enumerate(sizes)]
    (tmp_path / "none").write_bytes(b"")
    (tmp_path / "one").write_bytes(np.array([7, 7], "<u2").tobytes())
    want.append(("one", 0, 2))
    got = [(r.file.rsplit("/", 1)[1], r.place, r.n_tokens) for r in tokencount.count(spark, str(tmp_path), 99, 2, block).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize(("width", "end"), [(2, 50256), (2, 2), (4, 50256), (4, 7)])
@pytest.mark.parametrize("bytes_of_range", [151])
def test_ranges_meet_anywhere(spark, tmp_path, width, end, bytes_of_range):
    """Ids that hold bytes of the separator, ranges that end within documents and ids, files cut within an id."""
    rng = np.random.default_rng(end)
    mark = end.to_bytes(width, "little")
    odd = [int.from_bytes(mark[1:2] + mark[:1] + bytes(width - 2), "little"), int.from_bytes(bytes([9]) + mark[:1] + bytes(width - 2), "little"), int.from_bytes(mark[1:2] + bytes([9]) + bytes(width - 2), "little")]
    want = []
    for f in range(3):
        ids = rng.choice([*odd, 1, 300, end], 1200, p=[0.15, 0.25, 0.25, 0.15, 0.15, 0.05])
        (tmp_path / f"f{f}").write_bytes(ids.astype(f"<u{width}").tobytes() + b"\x01" * min(f, width - 1))
        ends = np.flatnonzero(ids == end)
        sizes = (np.diff(np.concatenate([[-1], ends])) - 1).tolist()
        if ids[-1] != end:
            sizes.append(len(ids) - int(ends[-1]) - 1)
        want += [(f"f{f}", k, n) for k, n in enumerate(sizes)]
    (tmp_path / "byte").write_bytes(b"\x01")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_of_range))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = tokencount.count(spark, str(tmp_path), end, width, 64)
        got = [(r.file.rsplit("/", 1)[1], r.place, r.n_tokens) for r in rows.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == sorted(want)
    with pytest.raises(ValueError):
        tokencount.count(spark, str(tmp_path), 0, width)


def test_documents(spark, tmp_path):
    texts = [None, "", "one two", "<|endoftext|> spelled", "w " * 50_000, "one two"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "x", 1)], "doc_id long, text string, part int")
    df.write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d")).repartition(3)
    own = bpe.codec(vocabulary())
    want = {k: len(own._plain(t)) // 4 if t else 0 for k, t in enumerate(texts)} | {None: 1}
    got = tokencount.count_documents(df, vocabulary(), block=1 << 10).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == 7
    assert tokencount.count_documents(df.limit(0), vocabulary()).count() == 0
