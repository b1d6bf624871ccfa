"""The pipeline, stage by stage, on the smallest tables."""

import corpus_pipeline
from toposim.llm import jaccard, packing, quality, toxicity
from toposim.llm.common import materialize, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf_dir), "test")
        seen[name] = (docs, out)
        if name != names[-1]:
            assert out.columns == docs.columns
            assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs = out
    before, after = seen["quality_rules"]
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    assert ids(after) == ids(quality.judge(before).where("kept"))
    before, after = seen["ngram_jaccard_join"]
    assert ids(after) == ids(jaccard.link(before).where("doc_id = component_id"))
    before, after = seen["secret_scans"]
    assert ids(after) == ids(before)
    before, after = seen["best_fit_packing"]
    assert ids(after) == ids(before)
    assert after.groupBy("sequence_id").sum("length").where(f"`sum(length)` > {packing.CAPACITY}").count() == 0
    run = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(key).collect())) == sorted(map(tuple, after.select(key).collect()))
