from quillmill.operators.jobs import latest_status
from quillmill.plans import fixtures as fx
from quillmill.streaming import jobs as sj

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    events = fx.job_events(spark, SF)
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = sj.read_events(spark, str(tmp_path / "in"), files_per_trigger=2)
    query = sj.write_status(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    key = lambda df: sorted(tuple(r) for r in df.select("job_id", "seq", "status", "done").collect())
    assert key(sj.read_status(spark, str(tmp_path / "out"))) == key(latest_status(events))


def test_windows_in_update_mode(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = sj.events_per_window(stream).writeStream.format("memory").queryName("per_window").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM per_window").first()[0] == events.count()


def test_review_of_arriving_documents(spark, tmp_path):
    from quillmill.plans.review import RuleSuggester, review
    from quillmill.sources.elements import from_documents
    from quillmill.streaming import review as sr

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id < 40")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    query = sr.review_stream(sr.read_documents(spark, str(tmp_path / "in"), 2), RuleSuggester(fx.LEXICON), "p", str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(200)
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "change_no", "element_id", "verdict").collect())
    assert key(spark.read.parquet(str(tmp_path / "out" / "verdicts"))) == key(review(from_documents(docs), RuleSuggester(fx.LEXICON), "p").verdicts)
