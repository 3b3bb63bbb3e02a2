"""The pipeline's stages over a small table of odd rows."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def test_stages_keep_odd_rows(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, marks string, voter int, spans int, score double"
    text = "A plain text of its own that nobody else has written down before today."
    rows = [(1, None), (2, ""), (3, " \n"), (4, text), (4, text), (None, "Another text without an id, of some words."), (5, "one two"), (6, "long " * 30_000)]
    docs = spark.createDataFrame([(*r, None, None, None, "m", 1, 2, 0.5) for r in rows], schema)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        left = out.collect()
        assert {r.doc_id for r in left} == {1, 2, 3, 4, 5, 6, None}, name
        assert all((r.marks, r.voter, r.spans, r.score) == ("m", 1, 2, 0.5) for r in left), name
        docs = spark.createDataFrame(left, schema)
    assert docs.where("doc_id = 4").count() == 1 and docs.where("doc_id = 4").first().text == text
    last = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(str(r.doc_id) for r in last) == ["1", "2", "3", "4", "5", "6", "None"]


def test_ids_are_stored_before_they_are_decoded(spark):
    """A task of byte_bpe has one Python step: a second would hold a second worker's memory."""
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(1, "One text of some words."), (2, None), (None, "")], "doc_id bigint, text string")
    out = pipeline.byte_bpe(spark, docs, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert sorted((str(r.doc_id), r.n_tokens > 0) for r in out.collect()) == [("1", True), ("2", False), ("None", False)]


def test_passages_are_found_before_they_are_cut(spark):
    """So it is in decontamination: one Python step in the job that cuts."""
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(1, "One text of some words."), (2, None)], "doc_id bigint, text string")
    out = pipeline.benchmark_decontamination(spark, docs, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "One text of some words."), (2, None)]
