from titlegrain.streaming import open_loans


def test_stream_of_loans(spark, tmp_path):
    kind = "doc_id string, ref string, seq int, event string"
    first = [("d", "1/2001", 1, "mortgage"), ("d", "2/2001", 2, "mortgage"), ("d", "9/2001", 3, "discharge")]
    second = [("d", "1/2001", 5, "discharge"), ("d", "9/2001", 9, "mortgage"), ("d", "2/2001", 2, "mortgage")]
    for n, part in enumerate((first, second)):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    for n in (0, 1):
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / f"in/{n}"))
        q = open_loans.open_loans(stream).writeStream.outputMode("update").format("memory").queryName(f"loans{n}").start()
        q.processAllAvailable()
        q.stop()
    both = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = open_loans.open_loans(both).writeStream.outputMode("update").format("memory").queryName("all_loans").start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.sql("SELECT * FROM all_loans").collect():
        last[r["ref"]] = r["status"] if last.get(r["ref"]) != "closed" else "closed"
    assert last == {"1/2001": "closed", "2/2001": "open", "9/2001": "closed"}
