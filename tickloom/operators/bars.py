"""Bars: resampling of ticks and bars, and prices on a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.ticks import sign, with_mid


def _first(value: str, *order: str) -> Column:
    return F.min_by(value, F.struct(*order))


def _last(value: str, *order: str) -> Column:
    return F.max_by(value, F.struct(*order))


def ohlcv(ticks: DataFrame, width: str = "1 hour", tib_sign: int = 1) -> DataFrame:
    """Bars of mid prices with volume, order-flow imbalance and spread; empty bars do not exist.

    The sign of a tick needs the one before it, so ticks are dealt and sorted by symbol once; the bars are
    then made in the same tasks.
    """
    priced = with_mid(ticks).withColumn("sign", sign("lee_ready"))
    if "volume" not in ticks.columns:
        priced = priced.withColumn("volume", F.lit(1.0))
    at = ("timestamp_ns", "seq")
    bars = priced.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        _first("mid", *at).alias("open"),
        F.max("mid").alias("high"),
        F.min("mid").alias("low"),
        _last("mid", *at).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum(F.col("sign") * F.col("volume")).alias("signed_volume"),
        F.avg("spread").alias("spread_avg"),
        F.max("spread").alias("spread_max"),
        F.count("*").alias("n_ticks"),
    )
    tib = tib_sign * F.col("signed_volume") / F.greatest(F.col("volume"), F.lit(1e-10))
    return bars.select("symbol", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume", tib.alias("tib"), "spread_avg", "spread_max", "n_ticks")


def quote_bars(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """Bars of bid and ask, and their mean as mid bars."""
    at = ("timestamp_ns", "seq")
    aggs = [f(s, *at).alias(f"{s}_{n}") for s in ("bid", "ask") for n, f in (("open", _first), ("close", _last))]
    aggs += [f(s).alias(f"{s}_{n}") for s in ("bid", "ask") for n, f in (("high", F.max), ("low", F.min))]
    bars = ticks.groupBy("symbol", F.window("ts", width).alias("w")).agg(*aggs)
    mids = {n: (F.col(f"bid_{n}") + F.col(f"ask_{n}")) / 2 for n in ("open", "high", "low", "close")}
    return bars.select("symbol", F.col("w.start").alias("bar_start"), *(v.alias(n) for n, v in mids.items()))


def rebar(bars: DataFrame, width: str) -> DataFrame:
    """Longer bars of bars."""
    grouped = bars.groupBy("symbol", F.window("bar_start", width).alias("w")).agg(
        _first("open", "bar_start").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), _last("close", "bar_start").alias("close"), F.sum("volume").alias("volume")
    )
    return grouped.select("symbol", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume")


def by_bar():
    return Window.partitionBy("symbol").orderBy("bar_start")


def last_bars(n: int):
    return by_bar().rowsBetween(-(n - 1), 0)


def as_of_grid(ticks: DataFrame, step_ms: int = 100, span_s: int = 300, value: str = "mid") -> DataFrame:
    """The last value at or before each point of a grid over the last ``span_s`` seconds of every symbol.

    Grid points and ticks are merged and filled, so that no range join is needed; of the ticks before a
    symbol's grid only the last is wanted, however old it is.
    """
    ends = ticks.groupBy("symbol").agg(F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))
    begin = F.greatest(F.col("first_ns"), F.col("last_ns") - span_s * 1_000_000_000)
    grid = ends.select("symbol", F.explode(F.sequence(begin, F.col("last_ns"), F.lit(step_ms * 1_000_000))).alias("timestamp_ns"))
    bounded = ticks.join(F.broadcast(ends), "symbol").select("symbol", "timestamp_ns", "seq", F.col(value).alias("value"), begin.alias("begin"))
    near = bounded.where("timestamp_ns >= begin").drop("begin")
    before = bounded.where("timestamp_ns < begin and value is not null").groupBy("symbol").agg(F.max(F.struct("timestamp_ns", F.col("seq").cast("long").alias("seq"), "value")).alias("tick"))
    near = near.unionByName(before.select("symbol", "tick.*"))
    merged = near.withColumn("kind", F.lit(0)).unionByName(grid.select("symbol", "timestamp_ns", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("kind")))
    past = Window.partitionBy("symbol").orderBy("timestamp_ns", "kind", F.asc_nulls_last("seq")).rowsBetween(Window.unboundedPreceding, 0)
    filled = merged.withColumn("price", F.last("value", ignorenulls=True).over(past))
    return filled.where("kind = 1").select("symbol", "timestamp_ns", "price")


def fill_after(ticks: DataFrame, latency_ns: int, value: str = "ask") -> DataFrame:
    """Adds ``fill``: the value of the first tick at or after each tick's time plus a latency, else the last tick's.

    Ticks and the points wanted are merged and filled backwards, which is one sort and one pass: in descending
    time a point follows the ticks of its time, of which the first by ``seq`` comes last.
    """
    points = ticks.withColumns({"__at": F.col("timestamp_ns") + latency_ns, "__point": F.lit(True), "__value": F.lit(None).cast("double")})
    values = ticks.withColumns({"__at": F.col("timestamp_ns"), "__point": F.lit(False), "__value": F.col(value)})
    back = Window.partitionBy("symbol").orderBy(F.desc("__at"), "__point", F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    ends = ticks.groupBy("symbol").agg(F.max_by(value, F.struct("timestamp_ns", "seq")).alias("__last"))
    filled = points.unionByName(values).withColumn("__after", F.last("__value", ignorenulls=True).over(back))
    filled = filled.where("__point").join(ends, "symbol")
    return filled.withColumn("fill", F.coalesce("__after", "__last")).drop("__at", "__point", "__value", "__after", "__last")


def event_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))
