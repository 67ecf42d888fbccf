from pyspark.sql import functions as F

from recallforge.streaming import oplog


def test_follow(spark, tmp_path):
    schema = "seq long, op string, id string, v int"
    rows = [(1, "put", "a", 1), (2, "put", "b", 2), (3, "put", "a", 3)]
    for n, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
        oplog.follow(stream, str(tmp_path / "state"), str(tmp_path / "cp"), ("id",)).awaitTermination()
        got = {r.id: r.v for r in spark.read.parquet(str(tmp_path / f"state/version={n}")).collect()}
    assert got == {"a": 3, "b": 2}


def test_windows_and_supersession(spark, tmp_path):
    schema = "tenant_id string, id string, seq long, by string, ts timestamp"
    df = spark.createDataFrame([("t", "a", 1, None), ("t", "a", 2, "b"), ("t", "c", 3, None)], "tenant_id string, id string, seq long, by string").withColumn("ts", F.timestamp_seconds(F.col("seq") * 1800))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = oplog.supersession(stream).writeStream.outputMode("update").format("memory").queryName("marks").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.id, r.superseded_by) for r in spark.table("marks").collect()] == [("a", "b")]
    q = oplog.windowed_counts(stream.withColumn("op", F.lit("put"))).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 2]
