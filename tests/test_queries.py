"""Every registered query with SQL against DuckDB on the smallest tables, and the contract of the entry module."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def own():
    return sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return round(float(v), 5)
    return v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", own())
def test_same_rows_as_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_part():
    from pathlib import Path

    root = Path(entry.__file__).parent / "seqmill"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "seqmill.llm" not in p.read_text(), p


def test_results_do_not_depend_on_partitions(spark):
    names = ["vocab_encode", "window_pack", "onset_sessions", "dominant_patch", "topk_names"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for parts in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            seen.append([rows(entry.queries()[n](spark, SF).toPandas()) for n in names])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


@pytest.fixture(scope="module")
def long_training(spark, tmp_path_factory):
    """More documents than any schedule has steps, long ones throughout; null texts and ids, an id given twice, numbers with gaps, shuffled."""
    lengths = [(k * 7919) % 40 if k % 50 else 900 + k for k in range(10_400)]
    docs = [(3 * k, None if k % 97 == 1 else " ".join("w" * n)) for k, n in enumerate(lengths)] + [(None, "a b"), (30, "a b c"), (30, "a b c")]
    order = np.random.default_rng(1).permutation(len(docs))
    at = tmp_path_factory.mktemp("steps")
    spark.createDataFrame([docs[k] for k in order], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    return str(at), con, len(docs)


def test_curriculum_over_all_of_training(spark, long_training):
    at, con, n = long_training
    got = entry.queries()["curriculum_len"](spark, at).toPandas()
    assert rows(got) == rows(con.execute(entry.oracle_sql()["curriculum_len"]).fetchdf())
    assert sorted(got.step) == list(range(n))
    by_step = got.set_index("step")
    assert [by_step.seq_len[s] for s in (0, 178, 179, 1250, 4999, 5000, n - 1)] == [1024, 1024, 1280, 2816, 7936, 8192, 8192]
    assert (got.kept <= got.seq_len).all() and (got.kept == got.seq_len).any() and got.kept.max() == 8192


def test_rates_over_all_of_training(spark, long_training):
    at, con, n = long_training
    got = entry.queries()["lr_schedule"](spark, at).toPandas()
    want = con.execute(entry.oracle_sql()["lr_schedule"]).fetchdf()
    assert rows(got.assign(lr=got.lr * 1e9)) == rows(want.assign(lr=want.lr * 1e9))  # rows() rounds to five places
    assert sorted(got.step) == list(range(n))
    lr = got.set_index("step").lr
    assert [lr[s] for s in (0, 1, 250, 500, 5250, 10_000, n - 1)] == pytest.approx([0, 6e-7, 1.5e-4, 3e-4, 1.65e-4, 3e-5, 3e-5], abs=1e-12)
    assert got.words.sum() == con.execute("SELECT sum(len(string_split(text, ' '))) FROM documents").fetchone()[0]
