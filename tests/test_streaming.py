"""Streams give what batches give, however the ticks are cut into files."""

from pyspark.sql import functions as F

from quantloom.operators import bars as batch
from quantloom.operators import events
from quantloom.sources import tape
from quantloom.streaming import bars as stream

DATA = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    walk = tape.price_walk(tape.tape(spark, DATA)).select("symbol", "seq", F.col("ts").cast("timestamp").alias("ts"), "price", F.col("size").cast("double").alias("size"))
    for k in range(3):
        walk.filter((F.col("seq") >= k * 350) & (F.col("seq") < (k + 1) * 350)).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    source = spark.readStream.schema(walk.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    for name, made, want in (
        ("bars", stream.dollar_bars(source, 50_000), batch.dollar_bars(walk, 50_000)),
        ("events", stream.cusum_events(source, 0.02), events.cusum_events(walk, 0.02)),
    ):
        q = made.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        key = "bar_no" if name == "bars" else "seq"
        got = sorted((r.symbol, r[key], round(r["close" if name == "bars" else "price"], 6)) for r in spark.table(name).collect())
        assert got == sorted((r.symbol, r[key], round(r["close" if name == "bars" else "price"], 6)) for r in want.collect())
        assert got
