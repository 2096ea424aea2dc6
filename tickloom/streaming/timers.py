"""Streams with timers and bounded state: end of day, silence, history, and results that expire.

States are rows of named fields by symbol. Event-time timers run by the watermark and processing-time ones by the clock;
either also fires in a batch without rows of its symbol.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

DAY_MS = 86_400_000


def _by(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str) -> DataFrame:
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=StructType.fromDDL(schema), outputMode="Append", timeMode=time)


def _utc_ms(column: pd.Series) -> pd.Series:
    return pd.to_datetime(column).astype("datetime64[ms]").astype("int64")


class _EndOfDay(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "first_at long, first double, last_at long, last double, low double, high double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            at = _utc_ms(frame["ts"])
            for day, part in frame.assign(at=at, day=at // DAY_MS).sort_values("at", kind="stable").groupby("day"):
                first, last = part.iloc[0], part.iloc[-1]
                if self.days.containsKey((int(day),)):
                    a, b, c, d, low, high, n = self.days.getValue((int(day),))
                else:
                    a, b, c, d, low, high, n = None, None, None, None, float("inf"), float("-inf"), 0
                    self.handle.registerTimer((int(day) + 1) * DAY_MS)
                if a is None or first["at"] < a:
                    a, b = int(first["at"]), float(first["equity"])
                if c is None or last["at"] >= c:
                    c, d = int(last["at"]), float(last["equity"])
                low, high = min(low, float(part["equity"].min())), max(high, float(part["equity"].max()))
                self.days.updateValue((int(day),), (a, b, c, d, low, high, n + len(part)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        _, first, _, last, low, high, n = self.days.getValue((day,))
        self.days.removeKey((day,))
        yield pd.DataFrame({"symbol": [key[0]], "day": [pd.Timestamp(day * DAY_MS, unit="ms").date()], "first": [first], "last": [last], "low": [low], "high": [high], "n": [n]})

    def close(self) -> None:
        pass


def days_closed(equity: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """(symbol, day, first, last, low, high, n) of a stream (symbol, ts, equity), once the watermark has passed a day's midnight in UTC.

    Rows that the watermark has passed are dropped before. A timer each open day and symbol; a closed day leaves no state.
    """
    named = equity.withWatermark("ts", lateness).select("symbol", "ts", "equity")
    return _by(named, "symbol", _EndOfDay(), "symbol string, day date, first double, last double, low double, high double, n long", "EventTime")


class _Silence(StatefulProcessor):
    def __init__(self, after: int):
        self.after = after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "timestamp_ns long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(frame["timestamp_ns"].max()) for frame in rows)
        if self.last.exists():
            before, due = self.last.get()
            newest = max(newest, before)
            if due >= 0:
                self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.after
        self.handle.registerTimer(due)
        self.last.update((newest, due))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, due = self.last.get()
        if due == expiredTimerInfo.getExpiryTimeInMs():
            self.last.update((newest, -1))
            yield pd.DataFrame({"symbol": [key[0]], "timestamp_ns": [newest], "silent_ms": [timerValues.getCurrentProcessingTimeInMs() - due + self.after]})

    def close(self) -> None:
        pass


def silences(ticks: DataFrame, after_ms: int = 500) -> DataFrame:
    """(symbol, timestamp_ns, silent_ms): a row each time that a symbol has had no tick for ``after_ms`` of the clock, with its newest tick."""
    return _by(ticks.select("symbol", "timestamp_ns"), "symbol", _Silence(after_ms), "symbol string, timestamp_ns long, silent_ms long", "ProcessingTime")


class _History(StatefulProcessor):
    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("history", "timestamp_ns long, mid double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), float(m)) for frame in rows for t, m in zip(frame["timestamp_ns"], frame["mid"], strict=True)]
        kept = sorted([*(tuple(x) for x in self.history.get()), *new])[-self.n :] if self.history.exists() else sorted(new)[-self.n :]
        self.history.put(kept)
        mids = [m for _, m in kept]
        yield pd.DataFrame({"symbol": [key[0]], "n": [len(kept)], "oldest_ns": [kept[0][0]], "newest_ns": [kept[-1][0]], "mean": [sum(mids) / len(mids)]})

    def close(self) -> None:
        pass


def history(ticks: DataFrame, n: int = 5000) -> DataFrame:
    """(symbol, n, oldest_ns, newest_ns, mean) of a symbol's latest ``n`` ticks, after each batch that brings some; ``latest`` reads those ticks back."""
    return _by(ticks.select("symbol", "timestamp_ns", "mid"), "symbol", _History(n), "symbol string, n long, oldest_ns long, newest_ns long, mean double", "None")


def latest(spark, checkpoint: str, n: int | None = None) -> DataFrame:
    """(symbol, timestamp_ns, mid): what a ``history`` query keeps, read from its checkpoint while it runs or after; the latest ``n`` of each symbol."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "history").option("flattenCollectionTypes", "true").load()
    rows = state.select(F.col("key.symbol").alias("symbol"), "list_element.timestamp_ns", "list_element.mid")
    if n is None:
        return rows
    newest = Window.partitionBy("symbol").orderBy(F.desc("timestamp_ns"), F.desc("mid"))
    return rows.withColumn("__place", F.row_number().over(newest)).where(F.col("__place") <= n).drop("__place")


class _Cached(StatefulProcessor):
    def __init__(self, compute: Callable[[str], float], ttl: int, entries: int):
        self.compute, self.ttl, self.entries = compute, ttl, entries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "request string", "value double, at long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        known = {k[0]: tuple(v) for k, v in self.held.iterator()} if self.held.exists() else {}
        out = []
        for frame in rows:
            for at, request in zip(frame["at"], frame["request"], strict=True):
                cached = request in known
                if not cached:
                    if len(known) >= self.entries:
                        oldest = min(known, key=lambda k: (known[k][1], k))
                        del known[oldest]
                        self.held.removeKey((oldest,))
                    known[request] = float(self.compute(request)), now
                    self.held.updateValue((request,), known[request])
                out.append((key[0], at, request, known[request][0], cached))
        yield pd.DataFrame(out, columns=["symbol", "at", "request", "value", "cached"])

    def close(self) -> None:
        pass


def cached(requests: DataFrame, compute: Callable[[str], float], ttl_ms: int = 500, entries: int = 1024) -> DataFrame:
    """(symbol, at, request, value, cached) for a stream (symbol, at, request): values are worked out once and used again for ``ttl_ms``.

    A symbol holds ``entries`` of them at most; a further one takes the place of the oldest.
    """
    schema = "symbol string, at long, request string, value double, cached boolean"
    return _by(requests.select("symbol", "at", "request"), "symbol", _Cached(compute, ttl_ms, entries), schema, "ProcessingTime")
