"""The pipeline against the same steps by hand, and its stages' columns."""

import pytest

from tarn.llm import bpe, mixing, pii, quality_rules, queries
from tarn.llm.common import table, written

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_rows(spark, sf):
    docs = table(spark, sf, "documents")
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    out = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = written(f(spark, out, sf), name)
        assert out.columns == docs.columns
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= set(kept)
    last = {r["doc_id"]: r["ids"] for r in stage["encoding"](spark, out, sf).collect()}
    coder = bpe.ForcedBoundaryBpe(queries.tokenizer_json(queries.BYTE_TOKENIZER))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: coder.decode(x) for i, x in last.items()}
    good = {r["doc_id"] for r in quality_rules.quality(docs).where("kept").collect()}
    assert set(last) <= good
    assert not any(pii.base_spans(r["text"]) for r in out.collect())


def test_stages_on_nothing_and_nulls(spark, sf):
    docs = table(spark, sf, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, None, None, None)], docs.schema)
    for rows in (docs.where("false"), odd):
        for _, f in corpus_pipeline.STAGES:
            assert f(spark, rows, sf).count() <= rows.count()
    assert mixing.drawn_documents(odd).columns == docs.columns
