"""Trading simulation: gates, sizes, positions and challenges."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import clean, risk


def position_size(equity: Column, budget: Column, stop_pips: Column, pip_value: Column, fraction: float = 1.0, most: float = 0.02, half_kelly: float = 0.25) -> Column:
    """Lots to two decimals (half to even), at least 0.01, cut to what the day's budget allows."""
    risk = F.least(equity * most * half_kelly * fraction, equity * 0.01)
    pips = F.greatest(stop_pips, F.lit(2.0))
    lots = F.greatest(F.lit(0.01), F.bround(risk / (pips * pip_value), 2))
    return F.when(lots * pips * pip_value > budget, F.bround(budget / (pips * pip_value), 2)).otherwise(lots)


def fuse_signals(direction: Column, risk: Column, regime: Column, hidden: Column, var: Column, budget: Column) -> Column:
    """A direction, or 0 where a model's score vetoes it; scores are given by key and not by place."""
    veto = (risk > 0.5) | (F.get(regime, F.lit(2)) > 0.6) | (F.get(regime, F.lit(3)) > 0.6) | (F.get(hidden, F.lit(3)) > 0.7) | (var >= budget)
    return F.when(veto, 0).otherwise(direction)


def triple_gate(reversal: Column, trend: Column, strength: Column, quality: Column, limit: float = 0.6, strong: float = 0.5, good: float = 0.5) -> dict[str, Column]:
    """Whether all three gates pass, each strictly, and the direction: -1 for reversal, 1 for trend."""
    regime = F.greatest(reversal, trend) > limit
    every = regime & (strength > strong) & (quality > good)
    return {"all_pass": every, "direction": F.when(~every, 0).when(reversal > trend, -1).otherwise(1)}


#: What a gate asks for, by mode: of the regime's chance, and of the momentum for long and short.
GATES = ("MOMENTUM", "MEAN_REV", "EXHAUSTION", "SLINGSHOT")


def gate(mode: str, reversal: Column, trend: Column, momentum: Column, quality: Column, slope: Column | None = None, confident: float = 0.6) -> dict[str, Column]:
    """Of one mode whether its gates pass, and the direction, 0 where they don't.

    MOMENTUM follows a momentum beyond 0.1 in a trend more than ``confident``; SLINGSHOT any momentum in a trend of 0.51 or more.
    MEAN_REV turns against one beyond 1.5 in a likely reversal of middling quality; EXHAUSTION buys a dip (momentum and quality
    below -0.4) over a rising ``slope``, and sells its mirror, in a likely reversal or where neither regime is likely.
    """
    likely = reversal > 0.5
    if mode == "MOMENTUM":
        regime, long, short = trend > confident, momentum > 0.1, momentum < -0.1
    elif mode == "SLINGSHOT":
        regime, long, short = trend >= 0.51, momentum > 0, momentum < 0
    elif mode == "MEAN_REV":
        regime, long, short = likely & (quality > 0.5) & (quality < 2.5), momentum < -1.5, momentum > 1.5
    elif mode == "EXHAUSTION":
        steep = F.lit(0.0) if slope is None else slope
        regime = likely | (1 - trend - reversal > 0.5)
        long, short = (steep > 0) & (momentum < -0.4) & (quality < -0.4), (steep < 0) & (momentum > 0.4) & (quality > 0.4)
    else:
        raise ValueError(f"no such mode: {mode}; there are {', '.join(GATES)}")
    direction = F.when(regime & long, 1).when(regime & short, -1).otherwise(0)
    return {"all_pass": direction != 0, "direction": direction}


def signals(bars: DataFrame, mode: str = "MOMENTUM", at: str = "bar_start", by: tuple[str, ...] = ("symbol",), **limits) -> DataFrame:
    """Trades to make, with their sizes, stops and targets: rows whose gate passes and that risk does not veto.

    Reads ``p_reversal``, ``p_trend``, ``p_stress``, ``momentum``, ``quality``, ``slope``, ``atr`` and ``close``, in all of which a null, NaN or
    infinite value is an error, as no order may rest on one. ``pnl`` is the outcome of a row's trade, where it has one, and
    counts for the rows after it. A symbol's first row makes no trade.
    """
    names = ("p_reversal", "p_trend", "p_stress", "momentum", "quality", "slope", "atr", "close")
    number = F.row_number().over(Window.partitionBy(*by).orderBy(at))
    late = clean.forbid_odd(bars.withColumn("__number", number).where("__number > 1").drop("__number"), *names)
    reversal, trend, stress, momentum, quality, slope = (F.col(n) for n in names[:6])
    found = gate(mode, reversal, trend, momentum, quality, slope)
    regime = F.when(trend >= F.greatest(reversal, stress), "TREND").when(reversal >= stress, "MEAN_REV").otherwise("STRESS")
    basis = trend if mode in ("MOMENTUM", "SLINGSHOT") else reversal
    ready = late.withColumns(
        {"direction": found["direction"], "regime": regime, "p": basis, "price": F.col("close"), "scale": F.lit(1.0), "n_open": F.lit(0), "held": F.lit(False)}
    )
    decided = risk.decide(ready, at, "pnl", by, risk.RiskLimits(**limits))
    return decided.where((F.col("direction") != 0) & (F.col("atr") > 0) & F.col("veto").isNull())


def friction(asset: Column) -> Column:
    """Cost as a share of the price by asset class."""
    return F.when(asset == "fx", 0.0001).when(asset == "index", 0.0002).when(asset == "crypto", 0.001).otherwise(0.0005)


@dataclass(frozen=True)
class Rules:
    """What a backtest runs by."""

    initial: float = 5000.0
    pip_size: float = 0.0001
    pip_value: float = 10.0
    daily_limit: float = 125.0
    total_limit: float = 250.0
    stop_multiple: float = 1.5
    take_multiple: float = 3.0
    half_kelly: float = 0.25
    most: float = 0.02
    slippage_pips: float = 0.2
    commission: float = 7.0
    lock: float = 0.02
    latency_ns: int = 50_000_000


def _positions(frame: pd.DataFrame, r: Rules) -> list[tuple]:
    """Trades of one symbol's ticks in time order.

    An open position is tested against its levels at every later tick; the first tick beyond either
    closes it, so the scan jumps from an entry to its exit with array searches.
    """
    t, bid, ask = (frame[c].to_numpy() for c in ("timestamp_ns", "bid", "ask"))
    direction, atr, day = frame["direction"].to_numpy(), frame["atr"].to_numpy(), frame["day"].to_numpy()
    n, slip = len(t), r.slippage_pips * r.pip_size
    equity, day_start, today, halted, trades = r.initial, r.initial, day[0] if n else None, False, []
    signals = np.flatnonzero(direction)
    at = 0
    while True:
        k = np.searchsorted(signals, at)
        if k == len(signals):
            return trades
        i = int(signals[k])
        if day[i] != today:
            today, day_start, halted = day[i], equity, False
        lost = day_start - equity
        halted = halted or equity >= day_start * (1 + r.lock) or lost >= r.daily_limit or r.initial - equity >= r.total_limit
        budget = r.daily_limit - lost
        pips = max(atr[i] / r.pip_size * r.stop_multiple, 2.0)
        lots = max(0.01, round(min(equity * r.most * r.half_kelly, equity * 0.01) / (pips * r.pip_value), 2))
        if lots * pips * r.pip_value > budget:
            lots = round(budget / (pips * r.pip_value), 2) if budget > 0 else 0.0
        if halted or budget <= 0 or lots < 0.01:
            at = i + 1
            continue
        d = int(direction[i])
        e = min(n - 1, int(np.searchsorted(t, t[i] + r.latency_ns)))
        entry = ask[e] + slip if d == 1 else bid[e] - slip
        stop, take = entry - d * atr[i] * r.stop_multiple, entry + d * atr[i] * r.take_multiple
        begin, width, out = i + 1, 64, None
        while begin < n and out is None:
            price = (bid if d == 1 else ask)[begin : begin + width]
            hit = (price <= stop) | (price >= take) if d == 1 else (price >= stop) | (price <= take)
            if hit.any():
                out = begin + int(hit.argmax())
            begin, width = begin + width, width * 2
        if out is None:
            return trades
        price = bid[out] if d == 1 else ask[out]
        stopped = price <= stop if d == 1 else price >= stop
        leave = (stop if stopped else take) - d * slip
        if day[out] != today:  # a day begins before the exit is booked
            today, day_start = day[out], equity
        pnl = (leave - entry) * d / r.pip_size * r.pip_value * lots - r.commission * lots
        equity += pnl
        trades.append((int(t[e]), int(t[out]), "LONG" if d == 1 else "SHORT", float(entry), float(leave), float(pnl), "stop" if stopped else "take"))
        at = out


def backtest(ticks: DataFrame, rules: Rules = Rules(), by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Trades of ticks with ``direction`` and ``atr``, one position at a time by group; groups run side by side.

    A position's exit decides what follows, so a group is sequential work and is one task's.
    """
    from tickloom.schema import TRADE

    key = ", ".join(f"`{c}` {dict(ticks.dtypes)[c]}" for c in by)
    schema = key + ", " + TRADE.split(", ", 1)[1]
    needed = ticks.select(*by, "timestamp_ns", "seq", "bid", "ask", "direction", "atr", F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("day"))

    def trade(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["timestamp_ns", "seq"])
        names = [f.split()[0].strip("`") for f in schema.split(", ")]
        return pd.DataFrame([(*(frame[c].iloc[0] for c in by), *x) for x in _positions(frame, rules)], columns=names)

    return needed.groupBy(*by).applyInPandas(trade, schema)


def challenge_windows(df: DataFrame, days: int = 30) -> DataFrame:
    """Adds ``challenge``: consecutive windows of so many days from a symbol's first row; the incomplete last one is left out."""
    w = Window.partitionBy("symbol")
    length = days * 86_400_000_000_000
    number = F.floor((F.col("timestamp_ns") - F.min("timestamp_ns").over(w)) / length)
    full = F.floor((F.max("timestamp_ns").over(w) - F.min("timestamp_ns").over(w)) / length)
    return df.withColumns({"challenge": number, "__full": full}).where("challenge < __full").drop("__full")


def challenge_results(equity: DataFrame, initial: float = 5000.0, target: float = 0.08, total_limit: float = 0.10) -> DataFrame:
    """(symbol, challenge, passed, failed) of equity by row: passed if its highest reaches the target, tested before failure."""
    top, bottom = F.max("equity"), F.min("equity")
    passed = top >= initial * (1 + target)
    return equity.groupBy("symbol", "challenge").agg(passed.alias("passed"), (~passed & (bottom <= initial * (1 - total_limit))).alias("failed"))


def challenge_tally(results: DataFrame) -> DataFrame:
    return results.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.count_if("failed").alias("n_failed"), F.avg(F.col("passed").cast("int")).alias("pass_rate"))


def bar_trades(bars: DataFrame, stop: float = 1.0, take: float = 2.0, horizon: int = 24, spread: float = 1e-4, stressed: float = 10.0) -> DataFrame:
    """Exit of a position opened at each signal bar's close (columns ``direction``, ``atr`` and, where there is one, ``stress``).

    Gives ``exit_type`` (STOP, TAKE, TIME after ``horizon`` bars, EOD at the data's end), ``bars_held``, ``ret`` before costs and ``net`` of half
    a ``spread`` on either side, of which the entry's counts ``stressed`` times under stress. Every signal stands for itself; the exit is the
    first bar of the window that crosses a level, the stop being tested first.
    """
    w = Window.partitionBy("symbol").orderBy("bar_start").rowsBetween(1, horizon)
    d, close = F.col("direction"), F.col("close")
    marked = bars.withColumns({"__ahead": F.collect_list(F.struct("high", "low", "close")).over(w), "__stop": close - d * stop * F.col("atr"), "__take": close + d * take * F.col("atr")})
    stopped = lambda b: F.when(d == 1, b["low"] <= F.col("__stop")).otherwise(b["high"] >= F.col("__stop"))
    taken = lambda b: F.when(d == 1, b["high"] >= F.col("__take")).otherwise(b["low"] <= F.col("__take"))
    at = F.array_min(F.transform("__ahead", lambda b, i: F.when(stopped(b) | taken(b), i)))
    hit, size = F.get("__ahead", at), F.size("__ahead")
    kind = F.when(at.isNull(), F.when(size < horizon, "EOD").otherwise("TIME")).when(stopped(hit), "STOP").otherwise("TAKE")
    out = F.when(at.isNull(), F.get("__ahead", size - 1)["close"]).when(stopped(hit), F.col("__stop")).otherwise(F.col("__take"))
    stress = F.when(F.col("stress"), stressed).otherwise(1.0) if "stress" in bars.columns else F.lit(1.0)
    gain = d * (out - close) / close
    traded = marked.where((d != 0) & (size > 0))
    return traded.select("symbol", "bar_start", "direction", kind.alias("exit_type"), F.coalesce(at + 1, size).alias("bars_held"), gain.alias("ret"), (gain - 0.5 * spread * (stress + out / close)).alias("net"))


def bar_backtest(bars: DataFrame, stop: float = 1.0, take: float = 2.0, horizon: int = 24) -> DataFrame:
    """``bar_trades`` before costs, in which a position at the data's end leaves by TIME."""
    found = bar_trades(bars, stop, take, horizon)
    return found.select("symbol", "bar_start", "direction", F.when(F.col("exit_type") == "EOD", "TIME").otherwise(F.col("exit_type")).alias("exit_type"), "ret")
