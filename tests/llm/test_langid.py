import odd

from siteframe.llm import catalog, langid


def test_accuracy_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = catalog.op8_language(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").collect()
    assert len(held) > 200 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert got.count() == 1000 and all(0 <= r["score"] <= 1 for r in held)


def test_the_query_does_not_look_at_labels_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    relabelled = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 4 = 2, 'xx', lang) lang")
    assert odd.same_rows(langid.identify(docs), langid.identify(relabelled))


def test_rejection(spark):
    model = langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    language, score, rejected = model.predict("Привет, как дела сегодня".encode())
    assert rejected and score == 0 and language in model.languages
    assert model.predict(b"the of and to with this that")[0] == "en"
    for nothing in (None, b"", b"123 -- \n"):
        assert model.predict(nothing) == (langid.UNKNOWN, 0.0, True)


def test_odd_rows(spark):
    docs = odd.docs(spark)
    got = langid.identify(docs).collect()
    assert len(got) == len(odd.DOCS)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 5, 7))
    assert by[6]["lang_pred"] in ("en", "de", "fr")
    assert not by[None]["held_out"]
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (3, 4, 5, 7)").isEmpty()
    assert langid.identify(odd.empty(spark)).isEmpty() and langid.accepted(odd.empty(spark)).isEmpty()
    unlabelled = docs.withColumn("lang", odd.F.lit(None).cast("string"))
    assert langid.identify(unlabelled).filter("lang_pred <> 'und'").isEmpty()
