import datetime
import random

from pyspark.sql import functions as F

from corposcope.streaming import streams


def test_stream_equals_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(seconds=37 * i), ("a", "b")[i % 2], i % 5, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, user_id int, value double")
    df.write.parquet(str(tmp_path / "in"))
    events = streams.read_events(spark, str(tmp_path / "in"), df.schema)
    q = streams.stream_metrics(events).writeStream.format("memory").queryName("metrics_").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("metrics_").collect())) == sorted(map(tuple, streams.rolling_metrics(df).collect()))
    q = streams.stream_dedupe(events.withColumn("k", F.col("user_id")), "k", "1 day").writeStream.format("memory").queryName("dedupe_").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dedupe_").count() == 5


def test_ingest_replaces_documents(spark, tmp_path):
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "a\nb\n\nc"), (2, "x")], schema).write.parquet(str(tmp_path / "in"))
    run = lambda: streams.stream_ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    run()
    spark.createDataFrame([(1, "new")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = streams.current_blocks(spark, str(tmp_path / "out")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "new"), (2, "x")]


def test_a_library_stream_equals_its_batch_twin(spark, tmp_path):
    """Good, bad and repeated documents over three files, with a restart between them and a batch that is run again."""
    schema = "doc_id long, text string, changed_at int"
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(("graph", "net", "data", "the")) for _ in range(n))
    files = [
        [(1, words(40) + "\n" + words(300), 1), (2, words(50), 1), (3, None, 1), (None, "lost", 1), (4, "\x01\x02\x03" * 20, 1), (5, words(5), 1)],
        [(1, words(60), 2), (1, words(30), 3), (2, None, 2), (6, words(400), 2)],
        [(5, " ", 3), (3, words(20), 3), (7, words(10), 3), (7, words(10), 3)],
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i != 1:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            streams.stream_library(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(240)
    streams.library_batch(str(tmp_path / "out"))(spark.createDataFrame(files[0], schema), 0)
    good = {}
    for d, t, at in (r for rows in files for r in rows):
        if d is not None and t is not None and "\x01" not in t and (at, t) > good.get(d, (0, "")):
            good[d] = (at, t)
    twin = streams.ingested(spark.createDataFrame([(d, t, at) for d, (at, t) in good.items()], schema))
    for name in ("pages", "chunks", "postings"):
        want = twin[name]
        got = streams.current_table(spark, str(tmp_path / "out"), name).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and not want.isEmpty()
    errors = spark.read.parquet(str(tmp_path / "out" / "errors")).collect()
    assert sorted((str(r.doc_id), r.error) for r in errors) == [("2", "no text"), ("3", "no text"), ("4", "unreadable text"), ("None", "no id")]
