"""The same operators on a stream give the rows of the batch."""

from auditloom.operators import claims as cl
from auditloom.streaming import audit


def test_scan_stream_equals_batch(spark, tmp_path):
    rows = [(1, "能治疗湿疹"), (2, "最佳选择"), (3, "不能治疗"), (4, None)]
    batch = spark.createDataFrame(rows, "id long, text string")
    batch.write.parquet(path := str(tmp_path / "posts"))
    stream = audit.scan_stream(spark.readStream.schema(batch.schema).parquet(path))
    query = stream.writeStream.format("memory").queryName("hits").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.sql("SELECT id, word, law_key FROM hits").collect()))
    assert got == sorted(map(tuple, cl.with_laws(cl.hit_table(batch, ["id"])).select("id", "word", "law_key").collect())) and len(got) == 3


def test_flood_windows(spark, tmp_path):
    rows = [("a", "绝了", f"2024-01-01 00:0{i}:00") for i in range(4)] + [("a", "x", "2024-01-01 01:00:00")]
    batch = spark.createDataFrame(rows, "thread string, text string, s string").selectExpr("thread", "text", "cast(s as timestamp) at")
    batch.write.parquet(path := str(tmp_path / "c"))
    stream = audit.flood_windows(spark.readStream.schema(batch.schema).parquet(path))
    query = stream.writeStream.format("memory").queryName("floods").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("SELECT n, short_rate, repeat_rate FROM floods").collect()
    assert [tuple(r) for r in got] == [(4, 1.0, 0.75)]
