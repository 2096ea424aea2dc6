"""Streamed bars equal those of the batch, but for the last ones that the watermark has not passed."""

from tickloom.operators.bars import ohlcv
from tickloom.sources.ticks import events_as_ticks
from tickloom.streaming.bars import stream_bars


def test_bars(spark, data, tmp_path):
    ticks = events_as_ticks(spark, data).select("symbol", "seq", "timestamp_ns", "ts", "bid", "ask")
    ticks.repartitionByRange(3, "timestamp_ns").sortWithinPartitions("timestamp_ns").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    query = stream_bars(source, "6 hours").writeStream.format("memory").queryName("streamed").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    names = ["symbol", "bar_start", "open", "high", "low", "close", "n_ticks"]
    found = set(map(tuple, spark.table("streamed").select(names).collect()))
    batch = set(map(tuple, ohlcv(ticks, "6 hours").select(names).collect()))
    assert found and found <= batch
    assert len(batch - found) <= 2 * len({b[0] for b in batch})


def test_recurrences(spark, data, tmp_path):
    """A stream in several batches, stopped and started again from its checkpoint, gives what the batch gives."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tickloom.operators import recurrences as R
    from tickloom.sources.ticks import delta_t, with_mid
    from tickloom.streaming.recurrences import stream

    ticks = with_mid(events_as_ticks(spark, data)).withColumns({"delta_t": delta_t() / 1000, "equity": 50 * F.col("mid") + 2500, "day": F.to_date("ts").cast("string")})
    ticks = ticks.select("symbol", "seq", "timestamp_ns", "mid", "delta_t", "equity", "day")
    ops = (R.Kalman(), R.Cusum("mid"), R.DailyGuard())
    batch = {r["seq"]: r for r in R.run(ticks, *ops).collect()}
    parts = ticks.withColumn("part", F.ntile(3).over(Window.orderBy("timestamp_ns"))).persist()
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    for part in (1, 2, 3):
        rows = parts.where(F.col("part") == part)
        rows = rows if part == 1 else rows.unionByName(parts.where("part = 1").limit(5))  # late rows are dropped
        rows.drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream(source, *ops).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").start()
        query.processAllAvailable()
        query.stop()
    found = {r["seq"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(found) == set(batch)
    for seq, r in found.items():
        assert abs(r["kf_price"] - batch[seq]["kf_price"]) < 1e-9 and abs(r["cusum_up"] - batch[seq]["cusum_up"]) < 1e-9
        assert (r["cusum_event"], r["allowed"], r["halt_reason"]) == tuple(batch[seq][c] for c in ("cusum_event", "allowed", "halt_reason"))
