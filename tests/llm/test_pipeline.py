"""The stages over a small corpus: columns, decisions, and the packing of what is left."""

import corpus_pipeline
from complyspark.llm import packing
from complyspark.llm.common import cut


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = cut(stage(spark, now, sf_dir))
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        seen[name] = [(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()]
    assert {i for i, _ in seen["toxicity"]} <= ids
    assert {i for i, _ in seen["simhash"]} <= {i for i, _ in seen["toxicity"]}
    assert len({t for _, t in seen["simhash"]}) == len(seen["simhash"])
    assert [i for i, _ in sorted(seen["secrets"])] == [i for i, _ in sorted(seen["simhash"])]
    assert set(seen["mixing"]) <= set(seen["secrets"])
    last = cut(corpus_pipeline.STAGES[-1][1](spark, now, sf_dir))
    assert last.filter("piece = 0").count() == len(seen["mixing"])
    total = last.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in total) <= packing.CAPACITY


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "secrets", "mixing", "packing"]


def test_stages_on_odd_documents(spark, sf_dir, make_docs, messy):
    """Nulls, repeats and columns whose names the operators use themselves go through every stage; an empty table stays empty."""
    docs = make_docs([*messy, (None, None), (None, None), (8, messy[7][1])])
    for first in (docs, docs.limit(0)):
        now = cut(first)
        n = now.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = cut(stage(spark, now, sf_dir))
            assert now.columns == docs.columns, name
        last = cut(corpus_pipeline.STAGES[-1][1](spark, now, sf_dir))
        assert last.filter("piece = 0").count() == now.count()
        assert (now.count() > 0) == (n > 0)
