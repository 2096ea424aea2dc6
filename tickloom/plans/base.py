"""What the named queries share: rounded columns, and the common tables in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import tick_features as T
from tickloom.operators import bars as B
from tickloom.sources import ticks as S

KEYS = ("symbol", "seq")
BAR_KEYS = ("symbol", "bar_start")


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded, as sums of floats differ in their last digits by order; never minus zero."""
    return F.round(x, digits) + 0.0


def rounded(df: DataFrame, keys: tuple[str, ...], columns: dict[str, Column] | list[str], digits: int = 6) -> DataFrame:
    named = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    return df.select(*keys, *(r(v, digits).alias(k) for k, v in named.items()))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_mid(S.events_as_ticks(spark, sf_dir))


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.events_as_path(spark, sf_dir)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path with the log return of each row and its number in the symbol (``__row``)."""
    return S.events_as_walk(spark, sf_dir).withColumn("log_return", T.log_return("price", before=F.col("before"))).drop("before")


def six_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of all bar queries and of ``BARS``: six hours wide."""
    return B.ohlcv(S.events_as_ticks(spark, sf_dir), "6 hours")


W = "PARTITION BY symbol ORDER BY timestamp_ns, seq"
BW = "PARTITION BY symbol ORDER BY bar_start"


def last(n: int, w: str = W) -> str:
    return f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


SO_FAR = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

TICKS = """ticks AS (
  SELECT *, (bid + ask) / 2 AS mid, ask - bid AS spread FROM (
    SELECT event_type AS symbol, event_id AS seq, CAST(epoch_us(ts) AS BIGINT) * 1000 AS timestamp_ns, ts,
      value - (0.01e0 + 0.01e0 * (event_id % 5)) / 2 AS bid, value + (0.01e0 + 0.01e0 * (event_id % 5)) / 2 AS ask,
      CAST(1 + event_id % 7 AS DOUBLE) AS volume
    FROM events))"""
SIGNED = (
    TICKS
    + f""",
moved AS (SELECT *, sign(mid - lag(mid) OVER ({W})) AS m FROM ticks),
signed AS (SELECT * EXCLUDE (m), CAST(coalesce(m, 0) AS INTEGER) AS sign,
  CAST(coalesce(last_value(nullif(m, 0) IGNORE NULLS) OVER {SO_FAR}, 0) AS INTEGER) AS lee_ready FROM moved)"""
)
PATH = TICKS + f""",
path AS (SELECT *, 100 * exp(sum((mid - 50) / 5000) OVER {SO_FAR}) AS price FROM ticks)"""


def bars_sql(hours: int) -> str:
    width = hours * 3600
    return (
        SIGNED
        + f""",
bars AS (SELECT symbol, make_timestamp((CAST(epoch_us(ts) AS BIGINT) // {width}000000) * {width}000000) AS bar_start,
  arg_min(mid, (timestamp_ns, seq)) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, (timestamp_ns, seq)) AS close,
  sum(volume) AS volume, sum(lee_ready * volume) / greatest(sum(volume), 1e-10) AS tib, avg(spread) AS spread_avg, max(spread) AS spread_max,
  count(*) AS n_ticks FROM signed GROUP BY 1, 2)"""
    )


BARS = bars_sql(6)


def sql(with_: str, keys: tuple[str, ...], columns: dict[str, str], source: str, where: str = "", digits: int = 6) -> str:
    """A query of rounded columns over the common tables."""
    items = ", ".join([*keys, *(f"round({v}, {digits}) + 0.0 AS {k}" for k, v in columns.items())])
    return f"WITH {with_} SELECT {items} FROM {source}" + (f" WHERE {where}" if where else "")
