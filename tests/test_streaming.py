from pyspark.sql import functions as F

from tessera.operators import measures as ms
from tessera.streaming.incremental import states, values

MEASURES = [ms.count_rows("n"), ms.sum_("value"), ms.Aggregator("mean", "value", "AVG"), ms.Aggregator("top", "value", "MAX")]


def test_a_stream_gives_what_one_pass_does(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    kept = str(tmp_path / "states")
    q = states(stream, MEASURES, ["event_type"], "ts", "1 day").writeStream.outputMode("complete").format("memory").queryName("kept_states").trigger(availableNow=True).option("checkpointLocation", kept).start()
    assert q.awaitTermination(120)
    got = sorted(map(tuple, values(spark.table("kept_states"), MEASURES, ["event_type"]).collect()))
    expected = sorted(map(tuple, events.groupBy("event_type").agg(F.count(F.lit(1)), F.sum("value"), F.avg("value"), F.max("value")).collect()))
    assert [g[:2] + g[4:] for g in got] == [e[:2] + e[4:] for e in expected]
    assert all(abs(a - b) < 1e-6 for g, e in zip(got, expected, strict=True) for a, b in zip(g[2:4], e[2:4], strict=True))


def test_watermarks_in_append_mode(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    source = str(tmp_path / "in")
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    q = states(stream, MEASURES[:2], [], "ts", "1 day", late="1 day").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    closed = {r["window_start"]: r["n"] for r in values(spark.read.parquet(out), MEASURES[:2], ["window_start"]).collect()}
    days = {r["d"]: r["count"] for r in events.groupBy(F.date_trunc("day", "ts").alias("d")).count().collect()}
    assert closed and all(days[d] == n for d, n in closed.items())
