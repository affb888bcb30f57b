import corpus_pipeline
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark int, n_lines int"


def odd_documents(spark):
    texts = [None, "", " \n", "the word and the cat", "the word and the cat", "x " * 9000, "1234"]
    rows = [(i, t, "en", "s", 0, 1, 1) for i, t in enumerate(texts)] + [(None, "some text here", None, None, None, 2, 2)]
    return spark.createDataFrame(rows, SCHEMA)



def test_stages_keep_columns_and_odd_rows(spark):
    table = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, "/root/testdata/sf0.001")
        assert out.columns == table.columns
        assert out.count() <= table.count()
        assert stage(spark, table.where("false"), "/root/testdata/sf0.001").count() == 0


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 50 and rows.where("offset + length > 1024").isEmpty()
