from pyspark.sql import functions as F

from leafmill.streaming import ingest


def test_ingest_twice(spark, tmp_path):
    landing, store = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()
    (landing / "a.txt").write_text("one\n\ntwo")
    ingest.ingest(spark, str(landing), store, str(tmp_path / "cp")).awaitTermination()
    (landing / "b.csv").write_text("a,b\n1,2\n")
    (landing / "c.pdf").write_bytes(b"%PDF-1.4")
    ingest.ingest(spark, str(landing), store, str(tmp_path / "cp")).awaitTermination()
    ingest.ingest(spark, str(landing), store, str(tmp_path / "cp2")).awaitTermination()
    got = spark.read.parquet(store)
    assert got.count() == 4 and got.where("type = 'error'").count() == 1


def test_documents_complete_once(spark, tmp_path):
    src = tmp_path / "pages"
    rows = [(1, 0, 2), (2, 0, 1), (1, 0, 2), (1, 1, 2), (1, 1, 2), (3, 0, 2)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "doc_id bigint, page_idx int, page_count int").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("doc_id bigint, page_idx int, page_count int").option("maxFilesPerTrigger", 3).parquet(str(src))
    q = ingest.complete_documents(stream, wait=None).writeStream.format("memory").queryName("complete").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted((r["doc_id"], r["pages"]) for r in spark.table("complete").where("complete").collect()) == [(1, 2), (2, 1)]


def test_late_events_are_dropped(spark, tmp_path):
    for i, ts in enumerate(["2024-01-01 00:10:00", "2024-01-05 00:00:00", "2024-01-01 00:20:00", "2024-01-09 00:00:00"]):
        spark.createDataFrame([(ts, "click", 1.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"e{i}"))
    schema = "ts timestamp, event_type string, value double"
    out = str(tmp_path / "out")
    for i in range(4):
        import shutil

        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"e{i}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{i}.parquet")
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest.windowed_counts(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {str(r["w"]["start"])[:10]: r["n"] for r in spark.read.schema("w struct<start:timestamp,end:timestamp>, event_type string, n bigint, total double").parquet(out).collect()} == {"2024-01-01": 1, "2024-01-05": 1}
