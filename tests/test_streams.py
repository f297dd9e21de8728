"""Streams: models that are loaded anew, and rows that come too late."""

import time

from pyspark.sql import functions as F

from quietsignal.streaming import scorers

SCHEMA = "k string, i long, s string"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_the_model_is_loaded_anew_for_each_batch(spark, tmp_path):
    versions = iter([1.0, 10.0, 100.0, 1000.0])
    put(spark, tmp_path / "in", [("x", 1, "a")])
    put(spark, tmp_path / "in", [("x", 2, "a")])
    stream = scorers.read_files(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    seen = []
    load = lambda: spark.createDataFrame([("x", next(versions))], "k string, m double")
    query = scorers.with_refreshed_model(stream, load, lambda batch, model: batch.join(model, "k"), lambda scored, n: seen.extend((n, r["i"], r["m"]) for r in scored.collect()), str(tmp_path / "state"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert sorted(x[0] for x in seen) == [0, 1] and sorted(x[2] for x in seen) == [1.0, 10.0] and {x[1] for x in seen} == {1, 2}


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    """Files in the order of time; a row behind the watermark that an earlier batch left is in no window."""
    for minutes in ([1, 2, 3], [40, 41], [43], [4, 42, 39], [200], [300]):
        frame = spark.createDataFrame([(m, float(m)) for m in minutes], "m int, v double").withColumn("ts", F.timestamp_seconds(F.col("m") * 60))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = scorers.read_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    stats = scorers.windowed_stats(stream, [], "ts", "v", "10 minutes", None, "15 minutes")
    scorers.run_to_folder(stats.select(F.unix_seconds("w.start").alias("start"), "n"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r["start"] // 60: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0] == 3 and got[30] == 1 and got[40] == 4  # minute 4 came after minute 43
