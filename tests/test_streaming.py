from pyspark.sql import functions as F

from clauseworks.streaming import arrivals


def test_documents_are_chunked_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, "c")], "doc_id bigint, text string")
    full = rows.select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("doc_format", "string"), ("hash", "binary"), ("mtime", "bigint"), ("lang", "string"), ("source", "string"))), "text", F.lit(None).cast("bigint").alias("n_chars"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("indexed_at"))
    full.write.mode("append").parquet(src)
    for _ in range(2):
        arrivals.index_stream(arrivals.arriving_documents(spark, src), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [1, 3]
    full.where("doc_id = 3").withColumn("doc_id", F.lit(4).cast("bigint")).write.mode("append").parquet(src)
    arrivals.index_stream(arrivals.arriving_documents(spark, src), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [1, 3, 4]


def test_counts_by_window(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "ab", 0), (2, "s", "c", 10), (3, "s", "d", 400_000)], "doc_id bigint, source string, text string, t bigint")
    rows.select("doc_id", "source", "text", F.timestamp_seconds("t").alias("indexed_at")).write.parquet(str(tmp_path / "in"))
    stream = arrivals.arriving_documents(spark, str(tmp_path / "in"), "doc_id bigint, source string, text string, indexed_at timestamp")
    q = arrivals.arrivals(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.documents, r.characters) for r in spark.table("counted").collect()) == [(1, 1), (2, 3)]
