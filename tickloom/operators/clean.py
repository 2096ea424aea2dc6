"""Cleaning: validity filters, stateful gates, filling and sampling."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import draw
from tickloom.sources.ticks import by_symbol


def valid_quotes(ticks: DataFrame) -> DataFrame:
    """Quotes with positive prices that are not crossed."""
    return ticks.where((F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("ask") >= F.col("bid")))


def spread_gate(ticks: DataFrame, max_pips: float = 20.0, pip_scale: float = 10_000.0) -> DataFrame:
    """Quotes with a spread above 0 and up to a limit in pips."""
    spread = F.col("ask") - F.col("bid")
    return ticks.where((spread > 0) & (spread <= max_pips / pip_scale))


def monotonic(ticks: DataFrame) -> DataFrame:
    """Ticks later than all before them, by arrival; exact where no other gate rejects ticks."""
    before = Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max("timestamp_ns").over(before)
    return ticks.withColumn("__latest", latest).where("__latest is null or timestamp_ns > __latest").drop("__latest")


@dataclass
class GateState:
    """What the tick gate keeps of a symbol: the last accepted tick and its window of accepted prices."""

    last_ns: int = -(1 << 62)
    last_mid: float | None = None
    history: deque = field(default_factory=deque)


@dataclass(frozen=True)
class TickGate:
    """The gates in order: time must advance, the spread must be in bounds, and a price must not jump.

    A jump is over ``multiple`` times the median absolute deviation of the last ``window`` accepted
    prices, once there are ten. A rejected tick leaves the state alone.
    """

    max_spread: float = 20.0 / 10_000.0
    window: int = 60
    multiple: float = 5.0

    def step(self, state: GateState, timestamp_ns: int, bid: float, ask: float) -> bool:
        spread = ask - bid
        if timestamp_ns <= state.last_ns or not 0 < spread <= self.max_spread:
            return False
        mid = (bid + ask) / 2
        if len(state.history) >= 10:
            middle = median(state.history)
            deviation = median(abs(x - middle) for x in state.history)
            if abs(mid - state.last_mid) > self.multiple * (deviation if deviation >= 1e-6 else 1e-5):
                return False
        state.last_ns, state.last_mid = timestamp_ns, mid
        state.history.append(mid)
        if len(state.history) > self.window:
            state.history.popleft()
        return True

    def apply(self, ticks: DataFrame) -> DataFrame:
        """The accepted ticks of a batch, gated by arrival; a symbol's rows stream through in Arrow batches."""
        order = ticks.repartition("symbol").sortWithinPartitions("symbol", "seq")
        gate = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            states: dict[str, GateState] = {}
            for batch in batches:
                keep = [
                    gate.step(states.setdefault(s, GateState()), t, b, a)
                    for s, t, b, a in zip(batch["symbol"], batch["timestamp_ns"], batch["bid"], batch["ask"], strict=True)
                ]
                yield batch[keep]

        return order.mapInPandas(run, ticks.schema)


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are neither null, NaN nor infinite."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def zero_if_odd(x: Column) -> Column:
    """0 for null, NaN and infinite values."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    """Bounds a value; NaN becomes the upper bound, as it is greater than all numbers here."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def forward_fill(name: str) -> Column:
    return F.last(name, ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))


def backward_fill(name: str) -> Column:
    """The next value that is not null; rows in descending order, so that the frame only grows."""
    back = Window.partitionBy("symbol").orderBy(F.desc("timestamp_ns"), F.desc("seq"))
    return F.last(name, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))


def every_nth(df: DataFrame, stride: int, first: int = 0) -> DataFrame:
    """Rows whose number in their symbol, from 0, is a multiple of the stride, from a warm-up on."""
    row = F.row_number().over(by_symbol()) - 1
    return df.withColumn("row", row).where((F.col("row") % stride == 0) & (F.col("row") >= first))


def stable_sample(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """``n`` rows without replacement by the digest of their key, so a rerun gives the same ones; in order of the key."""
    return df.orderBy(draw(*(F.col(k) for k in key), F.lit(seed)), *key).limit(n).orderBy(*key)


def complete_rows(df: DataFrame, *columns: str) -> DataFrame:
    return finite(df, *columns)


def forbid_odd(df: DataFrame, *columns: str) -> DataFrame:
    """``df``; reading a row with a null, NaN or infinite value in the columns is an error."""
    odd = F.lit(False)
    for c in columns:
        odd = odd | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    stop = F.when(odd, F.raise_error(F.lit("a value is missing or not finite"))).otherwise(F.lit(0.0))
    return df.withColumns({c: F.col(c) + stop for c in columns})


def train_test(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds ``part``: the first rows of a symbol are ``train``, the rest ``test``."""
    everything = Window.partitionBy("symbol")
    row = F.row_number().over(by_symbol())
    return df.withColumn("part", F.when(row <= F.floor(F.count("*").over(everything) * share), "train").otherwise("test"))
