"""Each pipeline stage on sf0.001 keeps the columns of documents, and the decisions take effect."""

import corpus_pipeline as cp
from pagesieve.llm import secretscan
from pagesieve.llm.common import documents, stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, SF)
    columns, before = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        if name == "near duplicates":
            assert docs.count() < before
        if name == "secrets":
            assert not any(secretscan.base_spans(r.text or "") for r in docs.collect())
    packed = cp.pack(spark, docs, SF)
    assert packed.count() == docs.count()
