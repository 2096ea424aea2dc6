"""Streams with timers and bounded state: tests move the watermark and the clock."""

import datetime as dt
import time

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tickloom.streaming import timers


def feed(spark, folder, schema):
    """A stream over a folder, and what writes one batch into it."""
    folder.mkdir()
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).parquet(str(folder)), put


def running(df, tmp_path):
    return df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").start()


def results(spark, tmp_path):
    try:
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
    except AnalysisException:  # nothing is there yet
        return []
    return [tuple(r) for r in rows]


def test_end_of_day(spark, tmp_path):
    at = lambda day, hour, minute=0: dt.datetime(2024, 1, day, hour, minute)
    source, put = feed(spark, tmp_path / "in", "symbol string, ts timestamp, equity double")
    batches = [
        [("a", at(1, 9), 100.0), ("a", at(1, 22), 90.0), ("b", at(1, 23, 55), 50.0)],
        [("a", at(1, 23, 50), 130.0), ("a", at(2, 0, 5), 95.0)],  # the first is still within the lateness
        [("b", at(2, 3), 51.0)],  # the watermark passes midnight, also for a, which has no row here
        [("a", at(1, 23), 1.0), ("b", at(4, 1), 60.0)],  # the first is too late; the second day ends for both
    ]
    for rows in batches:
        put(rows)
        query = running(timers.days_closed(source), tmp_path)  # stopped and started again each time
        query.processAllAvailable()
        query.stop()
    day = lambda d: dt.date(2024, 1, d)
    assert sorted(results(spark, tmp_path)) == [
        ("a", day(1), 100.0, 130.0, 90.0, 130.0, 3), ("a", day(2), 95.0, 95.0, 95.0, 95.0, 1),
        ("b", day(1), 50.0, 50.0, 50.0, 50.0, 1), ("b", day(2), 51.0, 51.0, 51.0, 51.0, 1),
    ]


def until(n, spark, tmp_path, seconds=60):
    """Waits for ``n`` results: a query with timers of the clock runs on without new rows."""
    end = time.time() + seconds
    while time.time() < end and len(results(spark, tmp_path)) < n:
        time.sleep(0.5)


def test_silence(spark, tmp_path):
    source, put = feed(spark, tmp_path / "in", "symbol string, timestamp_ns long")
    put([("a", 5), ("a", 3), ("b", 7)])
    query = running(timers.silences(source, 1500), tmp_path)
    until(2, spark, tmp_path)
    put([("a", 9)])
    until(3, spark, tmp_path)
    query.stop()
    found = results(spark, tmp_path)
    assert sorted(r[:2] for r in found) == [("a", 5), ("a", 9), ("b", 7)]
    assert all(r[2] >= 1500 for r in found)


def test_history(spark, tmp_path):
    source, put = feed(spark, tmp_path / "in", "symbol string, timestamp_ns long, mid double")
    rows = [("a" if k % 3 else "b", k, k / 2) for k in range(60)]
    for part in (rows[:5], rows[5:40], rows[40:]):
        put(part)
        query = running(timers.history(source, 12), tmp_path)
        query.processAllAvailable()
        query.stop()
    kept = {s: [(k, m) for x, k, m in rows if x == s][-12:] for s in "ab"}
    want = {(s, 12, v[0][0], v[-1][0], sum(m for _, m in v) / 12) for s, v in kept.items()}
    assert want <= set(results(spark, tmp_path)) and max(r[1] for r in results(spark, tmp_path)) == 12
    found = [tuple(r) for r in timers.latest(spark, str(tmp_path / "check")).collect()]
    assert sorted(found) == sorted((s, k, m) for s, v in kept.items() for k, m in v)
    assert sorted(tuple(r) for r in timers.latest(spark, str(tmp_path / "check"), 2).collect()) == sorted((s, k, m) for s, v in kept.items() for k, m in v[-2:])


def test_cache_expires(spark, tmp_path):
    source, put = feed(spark, tmp_path / "in", "symbol string, at long, request string")
    query = running(timers.cached(source, lambda request: len(request), ttl_ms=20_000, entries=2), tmp_path)
    put([("a", 0, "xx"), ("a", 1, "xx"), ("b", 2, "xx")])
    until(3, spark, tmp_path)
    put([("a", 3, "xx")])
    until(4, spark, tmp_path)
    time.sleep(21)
    put([("a", 4, "xx"), ("a", 5, "y"), ("a", 6, "zzz"), ("a", 7, "xx")])  # the third request drops the oldest
    until(8, spark, tmp_path)
    query.stop()
    found = {r[1]: (r[2], r[3], r[4]) for r in results(spark, tmp_path)}
    assert {k: v[2] for k, v in found.items()} == {0: False, 1: True, 2: False, 3: True, 4: False, 5: False, 6: False, 7: False}
    assert all(v[1] == len(v[0]) for v in found.values())
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("cached")).count() == 2
