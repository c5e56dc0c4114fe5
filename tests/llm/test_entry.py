import __spark_entry__ as entry
import corpus_pipeline


def test_pipeline_and_registered_queries(spark):
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() <= before, name
    assert corpus_pipeline.run(spark, sf).agg({"length": "sum"}).first()[0] > 0


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and repeated rows, an empty table."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    good = "\n".join(f"This is line {i} of a plain text that says a few different things about topic {i * 7}." for i in range(8))
    rows = [(1, None, None, None, None), (2, "", None, None, 0), (3, good, "en", None, None), (3, good, "en", None, None), (None, good.replace("plain", "long"), None, "s", 1), (4, good + "\nand one more line that no other text has, at the end of it.", "en", "s", 9)]
    for table in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, "").collect(), kind)
            assert docs.columns == table.columns, name
        assert docs.filter("text IS NULL OR text = ''").count() == 0
        packed = corpus_pipeline.packing(spark, docs, "")
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
