import corpus_pipeline
import odd
import pytest
from pyspark.sql import functions as F

from siteframe.llm import decontaminate, langid, quality

FOLDER = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert set(columns) <= set(after.columns) and (after.columns == columns or i == len(corpus_pipeline.STAGES) - 1)
        before_ids, ids = {r[0] for r in docs.select("doc_id").collect()}, [r[0] for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before_ids
        if name == "language":
            gone = langid.identify(docs).filter("rejected")
            assert {r["doc_id"] for r in gone.collect()} == before_ids - set(ids) and len(ids) > 0.98 * len(before_ids)
        if name == "quality_rules":
            assert set(ids) == {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
        if name == "decontamination":
            bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
            assert before_ids - set(ids) == {r["doc_id"] for r in decontaminate.report(docs, bench).filter("contaminated").collect()}
        docs = after
    assert docs.filter("copies < 1 or taken <> copies * size or copies > 2").isEmpty()
    ran = corpus_pipeline.run(spark, FOLDER)
    assert odd.same_rows(ran, docs)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, name, stage):
    docs = odd.docs(spark)
    out = stage(spark, docs, FOLDER)
    if name != "mix":
        assert out.columns == docs.columns
    assert out.count() <= len(odd.DOCS)
    assert stage(spark, docs.filter(F.lit(False)), FOLDER).isEmpty()
