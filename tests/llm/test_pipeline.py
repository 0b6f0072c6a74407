"""The pipeline's stages on a given table and on odd rows."""

import corpus_pipeline
from conftest import DATA
from odd_rows import no_docs, odd_docs  # noqa: F401  fixtures

from sensorloom.llm.common import stored


def test_stages_follow_one_another(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and {"doc_id", "piece", "length", "sequence_id", "offset"} <= set(rows[0].asDict())
    held = {}
    for r in rows:
        held[r["sequence_id"]] = held.get(r["sequence_id"], 0) + r["length"]
    assert max(held.values()) <= 1024


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, DATA), name)
            assert name == "pack_sequences" or docs.columns == names
    assert docs.count() == 0
