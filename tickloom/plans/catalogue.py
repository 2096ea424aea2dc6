"""Named queries of the library, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.plans import bar_queries, model_queries, risk_queries, tick_queries
from tickloom.sources import ticks as S

PARTS = (tick_queries, bar_queries, risk_queries, model_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of every symbol with the average range of the last 14."""
    bars = B.ohlcv(S.events_as_ticks(spark, sf_dir), "1 hour")
    last14 = B.by_bar().rowsBetween(-13, 0)
    return bars.withColumn("atr", F.avg(F.col("high") - F.col("low")).over(last14))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in PARTS for name, text in part.ORACLE.items()}
