import corpus_pipeline
from traceaudit.llm import decontaminate, jaccard, quality
from traceaudit.llm.common import clear_stored, table

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_does_its_work(spark):
    docs = table(spark, FOLDER, "documents")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER).cache()
        before, after = ({r.doc_id for r in d.select("doc_id").collect()} for d in (docs, out))
        assert after <= before
        if k < 4:
            assert out.columns == names
        if k == 0:
            model = quality.fit_quality(docs, table(spark, FOLDER, "labels"))
            rejected = {r.doc_id for r in quality.with_quality(docs, model).filter("score < 0.3").collect()}
            assert after == before - rejected
        if k == 1:
            assert jaccard.jaccard_components(out).filter("doc_id <> component_id").count() == 0
            assert after == {r.component_id for r in jaccard.jaccard_components(docs).collect()}
        if k == 2:
            report = decontaminate.contamination_report(docs, table(spark, FOLDER, "benchmark"))
            assert before - after == {r.doc_id for r in report.filter("contaminated").collect()}
        if k == 4:
            assert out.count() == docs.count() and after == before
        docs = out


def test_run_is_the_stages_in_turn(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert 0 < out.count() and clear_stored(spark) > 0
