"""The registered corpus queries: SQL twins, results and the pipeline."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import twins  # noqa: E402

import corpus_pipeline  # noqa: E402
from tablemend.llm import catalog  # noqa: E402
from tablemend.llm.decontaminate import contamination  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_twin(spark, name):
    assert twins.differences(spark, twins.connect(FOLDER), catalog.QUERIES[name], catalog.SQL[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_rows(spark, name):
    table, each = ("embeddings", 4) if name.startswith("op12") else ("pages" if name.startswith("op8") else "documents", 1)
    assert catalog.QUERIES[name](spark, FOLDER).count() == each * catalog.read(spark, FOLDER, table).count() or name.startswith("op6")


def test_pipeline(spark):
    docs = catalog.read(spark, FOLDER, "documents")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, before, FOLDER), name)
        assert docs.columns == before.columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids
        ids = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in packed.collect()} == ids
    assert not contamination(docs, catalog.read(spark, FOLDER, "benchmark")).filter("contaminated").count()
    empty = catalog.read(spark, FOLDER, "documents").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
