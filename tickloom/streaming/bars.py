"""Bars over streams of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.sources.ticks import with_mid


def stream_bars(ticks: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Bars of mid prices and spreads that are complete once the watermark has passed them; later ticks are dropped."""
    at = F.struct("timestamp_ns", "seq")
    bars = (
        with_mid(ticks)
        .withWatermark("ts", lateness)
        .groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("mid", at).alias("open"),
            F.max("mid").alias("high"),
            F.min("mid").alias("low"),
            F.max_by("mid", at).alias("close"),
            F.avg("spread").alias("spread_avg"),
            F.max("spread").alias("spread_max"),
            F.count("*").alias("n_ticks"),
        )
    )
    return bars.select("symbol", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "spread_avg", "spread_max", "n_ticks")
