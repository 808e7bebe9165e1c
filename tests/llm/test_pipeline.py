"""The pipeline on a small corpus against plain versions of its stages' rules."""

import importlib

import pytest

from seqmill.llm import langid, packing, simhash, toxicity
from seqmill.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_stages_keep_columns_and_follow_their_rules(spark, pipeline, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    kept = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, at, SF)
        out.write.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert out.columns == docs.columns
        kept[name] = (at, spark.read.parquet(str(tmp_path / str(k))))
        at = kept[name][1]
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "language_id", "simhash_neardup", "best_fit_packing"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = kept["toxicity"]
    scored = toxicity.score(before, toxicity.learn(docs, labels)).collect()
    assert ids(after) == sorted(r.doc_id for r in scored if r.predicted == 0)
    before, after = kept["language_id"]
    told = langid.identify(before, langid.learn(before, host="source")).collect()
    assert ids(after) == sorted(r.doc_id for r in told if r.accepted)
    before, after = kept["simhash_neardup"]
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in before.collect()}
    label = {i: i for i in prints}
    while True:
        new = {i: min(label[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
        if new == label:
            break
        label = new
    assert ids(after) == sorted(set(label.values()))
    before, after = kept["best_fit_packing"]
    pieces = after.collect()
    assert {r.doc_id for r in pieces} == set(ids(before)) and max(r.offset + r.length for r in pieces) <= packing.WINDOW
    lengths = {}
    for r in pieces:
        lengths[r.length] = lengths.get(r.length, 0) + 1
    assert len({r.sequence_id for r in pieces}) <= packing.lower_bound([lengths.get(n, 0) for n in range(packing.WINDOW + 1)], packing.WINDOW) + 1


def test_run_is_the_stages_in_a_row(spark, pipeline):
    a = pipeline.run(spark, SF)
    assert a.count() > 0 and "sequence_id" in a.columns and vocabulary().endswith(".json")


def test_odd_tables_through_all_stages(spark, pipeline, tmp_path):
    """Nulls in every column, repeated rows, columns of other names, no labels, no rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (1, None, "fr", None, 3), (-5, "twice the same text of some length here", "en", "s", 1), (-5, "twice the same text of some length here", "en", "s", 1)], docs.schema)
    both = docs.limit(60).union(odd).selectExpr("*", "'x' AS score", "1 AS fp", "2 AS component_id", "'y' AS __score", "'z' AS host", "3 AS part", "4 AS rank")
    for case, table, labels in (("odd", both, False), ("unlabelled", docs.limit(50), True), ("none", docs.limit(0), False)):
        at = tmp_path / case
        table.write.parquet(f"{at}/documents.parquet")
        marks = spark.read.parquet(f"{SF}/labels.parquet")
        (marks.limit(0) if labels else marks).write.parquet(f"{at}/labels.parquet")
        now = spark.read.parquet(f"{at}/documents.parquet")
        ids = set()
        for k, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, now, str(at))
            out.write.parquet(f"{at}/{k}")
            if k < 3:
                assert out.columns == table.columns
            now = spark.read.parquet(f"{at}/{k}")
            ids = {r.doc_id for r in now.select("doc_id").collect()}
        assert (case == "none") == (not ids)
        if case == "odd":
            assert -5 in ids and sum(r.doc_id == -5 for r in now.collect()) == 1
