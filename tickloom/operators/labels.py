"""Labels from what follows a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import splits
from tickloom.operators.bars import by_bar
from tickloom.operators.quantiles import quantiles
from tickloom.sources.ticks import by_symbol, next_rows


def first_passage(high: np.ndarray, low: np.ndarray, upper: np.ndarray, lower: np.ndarray, horizon: int) -> np.ndarray:
    """For each place the first of the ``horizon`` places after it where ``high`` reaches its upper or ``low`` its lower bound; -1 for none.

    Maxima and minima of stretches of 1, 2, 4, ... places tell which stretches hold no such place; each place passes over those,
    the longest first, so a long horizon costs its logarithm.
    """
    n = len(high)
    tops, bottoms = [np.where(np.isnan(high), -np.inf, high)], [np.where(np.isnan(low), np.inf, low)]
    while 1 << len(tops) <= min(horizon, n):
        half = 1 << (len(tops) - 1)
        tops.append(np.maximum(tops[-1][:-half], tops[-1][half:]))
        bottoms.append(np.minimum(bottoms[-1][:-half], bottoms[-1][half:]))
    upper, lower = np.where(np.isnan(upper), np.inf, upper), np.where(np.isnan(lower), -np.inf, lower)
    at = np.arange(1, n + 1)
    end = np.minimum(at + horizon, n)
    for k in range(len(tops) - 1, -1, -1):
        inside = np.flatnonzero(at + (1 << k) <= end)
        here = at[inside]
        at[inside[(tops[k][here] < upper[inside]) & (bottoms[k][here] > lower[inside])]] += 1 << k
    return np.where(at < end, at, -1)


def triple_barrier(df: DataFrame, price: str, variance: str, up: float = 2.0, down: float = 2.0, horizon: int = 900, chunk_rows: int = 20_000) -> DataFrame:
    """Adds ``label``: 1 or -1 for the barrier that the price touches first in the next ``horizon`` - 1 rows, 0 for none.

    A symbol's rows are looked at in chunks, with the rows after them that they need.
    """

    def mark(f: pd.DataFrame) -> dict:
        p, w = f[price].to_numpy(float), np.sqrt(f[variance].to_numpy(float))
        high, low = p * (1 + up * w), p * (1 - down * w)
        at = first_passage(p, p, high, low, horizon - 1)
        reached = p[at]
        return {"label": np.where(at < 0, 0, np.where(reached >= high, 1, -1)).astype(np.int32)}

    return splits.in_chunks(df, mark, "label int", 1, max(chunk_rows, horizon), horizon - 1).drop("row")


def bar_outcome(bars: DataFrame, atr: str, take: float = 2.0, stop: float = 1.0, horizon: int = 24) -> DataFrame:
    """Adds ``outcome``: 1 if within the next bars the high reaches the take level before, or when, the low reaches the stop, -1 if the stop comes first, else 0."""
    ahead = F.collect_list(F.struct("high", "low")).over(by_bar().rowsBetween(1, horizon))
    marked = bars.withColumns({"__ahead": ahead, "__up": F.col("close") + take * F.col(atr), "__down": F.col("close") - stop * F.col(atr)})
    hit = F.get(F.filter("__ahead", lambda b: (b["high"] >= F.col("__up")) | (b["low"] <= F.col("__down"))), F.lit(0))
    outcome = F.when(hit.isNull(), 0).when(hit["high"] >= F.col("__up"), 1).otherwise(-1)
    return marked.withColumn("outcome", outcome).drop("__ahead", "__up", "__down")


def bar_barrier(bars: DataFrame, atr: str, take: float = 2.0, stop: float = 1.0, horizon: int = 24) -> DataFrame:
    """Adds ``target``: 1 if the take level comes first, else 0."""
    return bar_outcome(bars, atr, take, stop, horizon).withColumn("target", (F.col("outcome") == 1).cast("int")).drop("outcome")


def exact_returns(bars: DataFrame, atr: str, take: float = 2.0, stop: float = 1.0, horizon: int = 24, leverage: float = 10.0, margin: float = 0.005, funding: float = 1e-4, pip: float = 1e-4) -> DataFrame:
    """Adds ``trade_return`` of a long position opened at each bar's close, after costs and with leverage.

    The take level is tested before the stop, which is not below the liquidation price; at that everything
    is lost. Costs are spread, slippage that grows with the range, and commission; funding is paid every
    eight bars. Without an exit the position ends at the last close of the window.
    """
    ahead = F.collect_list(F.struct("high", "low", "close")).over(by_bar().rowsBetween(1, horizon))
    c = F.col("close")
    dead = c * (1 - 1 / leverage + margin)
    marked = bars.withColumns({"__ahead": ahead, "__up": c + take * F.col(atr), "__dead": dead, "__down": F.greatest(c - stop * F.col(atr), dead)})
    out = lambda b: (b["high"] >= F.col("__up")) | (b["low"] <= F.col("__down"))
    at = F.array_min(F.transform("__ahead", lambda b, i: F.when(out(b), i)))
    hit = F.get("__ahead", at)
    end = F.coalesce(F.get("__ahead", F.size("__ahead") - 1)["close"], c)
    price = F.when(at.isNull(), end).when(hit["high"] >= F.col("__up"), F.col("__up")).otherwise(F.col("__down"))
    gain = F.when(at.isNotNull() & (hit["high"] < F.col("__up")) & (hit["low"] <= F.col("__dead")), -1.0).otherwise((price - c) / c)
    held = F.coalesce(at + 1, F.size("__ahead"))
    cost = (1.5 + 0.1 * 0.1 * F.col(atr)) * pip + 5.0 / 100_000
    return marked.withColumn("trade_return", leverage * (gain - cost / c - F.floor(held / 8) * funding)).drop("__ahead", "__up", "__dead", "__down")


def toxicity(df: DataFrame, price: str = "price", forward: int = 100, stride: int = 50, equity: float = 5000.0, limit: float = 125.0) -> DataFrame:
    """(symbol, timestamp_ns, label, price) of every stride-th row: 1 toxic, 0 clean; others are left out.

    A window is toxic for a Sortino ratio below -0.5, a drawdown above the limit or a value at risk above
    1.5 times its mean over the last 50 windows; clean if the ratio is positive and the price is within
    three deviations of the window's mean.
    """
    # a window starts at a multiple of the stride, so a row goes to the few windows that hold it, and no other window is made
    row = F.row_number().over(by_symbol()) - 1
    rows = df.select("symbol", "timestamp_ns", "seq", F.col(price).alias("price"), row.alias("row"))
    first = F.greatest(F.ceil((F.col("row") - forward + 1) / stride), F.lit(0)).cast("long")
    spread_out = rows.withColumn("k", F.explode(F.sequence(first, F.floor(F.col("row") / stride).cast("long"))))
    item = F.struct("row", "price", "timestamp_ns", "seq")
    taken = spread_out.groupBy("symbol", "k").agg(F.array_sort(F.collect_list(item)).alias("items")).where(F.size("items") == forward)
    head = F.get("items", F.lit(0))
    taken = taken.select("symbol", head["timestamp_ns"].alias("timestamp_ns"), head["seq"].alias("seq"), head["price"].alias("price"), F.transform("items", lambda x: x["price"]).alias("w"))
    logs = F.transform("w", lambda x: F.ln(F.greatest(x, F.lit(1e-12))))
    taken = taken.withColumn("r", F.zip_with(F.slice(logs, 2, forward - 1), F.slice(logs, 1, forward - 1), lambda a, b: a - b))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    taken = taken.withColumn("neg", F.filter("r", lambda x: x < 0))
    n = F.size("neg")
    taken = taken.withColumn("neg_mean", F.when(n > 0, total("neg") / n).otherwise(0.0))
    spread = total(F.transform("neg", lambda x: (x - F.col("neg_mean")) * (x - F.col("neg_mean"))))
    taken = taken.withColumn("down", F.when(n > 0, F.sqrt(spread / F.greatest(n - 1, F.lit(1)))).otherwise(0.0) + 1e-8)
    begin = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))

    def fall(s, x):
        peak = F.greatest(s["peak"], x)
        return F.struct(peak.alias("peak"), F.greatest(s["dd"], (peak - x) / (peak + 1e-8)).alias("dd"))

    mean = total("w") / forward
    taken = taken.withColumns(
        {
            "sortino": total("r") / (forward - 1) / F.col("down"),
            "dd_usd": F.aggregate("w", begin, fall)["dd"] * equity,
            "var_usd": F.abs(F.get(F.array_sort("r"), F.lit(int(0.05 * (forward - 1))))) * equity,
            "mean": mean,
        }
    )
    taken = taken.withColumn("std", F.sqrt(total(F.transform("w", lambda x: (x - F.col("mean")) * (x - F.col("mean")))) / forward))
    usual = F.avg("var_usd").over(by_symbol().rowsBetween(-49, 0))
    toxic = (F.col("sortino") < -0.5) | (F.col("dd_usd") > limit) | (F.col("var_usd") > 1.5 * F.greatest(usual, F.lit(1e-8)))
    clean = (F.col("sortino") > 0) & (F.abs(F.col("price") - F.col("mean")) <= 3 * F.greatest(F.col("std"), F.lit(1e-8)))
    labelled = taken.withColumn("label", F.when(toxic, 1).when(clean, 0).otherwise(-1))
    return labelled.where("label != -1").select("symbol", "timestamp_ns", "label", "price")


def rule_regimes(df: DataFrame, hf: str, returns: str, velocity: str) -> DataFrame:
    """Adds ``regime``: 3 for high-frequency energy, 2 for little variance of the last 20 returns, 0 rising, 1 falling."""
    variance = F.coalesce(F.var_samp(returns).over(by_symbol().rowsBetween(-19, 0)), F.lit(0.0))
    return df.withColumn("regime", F.when(F.abs(hf) > 0.3, 3).when(variance < 1e-6, 2).when(F.col(velocity) > 0, 0).otherwise(1))


def deepest_falls(steps: np.ndarray, length: int) -> np.ndarray:
    """For each place the deepest fall, from a peak or the start, of the sums of the ``length`` steps from it on; NaN where there are fewer.

    Stretches of 1, 2, 4, ... steps are put together from two halves: sum, highest and lowest sum on the way, and deepest fall.
    """
    n = len(steps) - length + 1
    out = np.full(len(steps), np.nan)
    if n <= 0:
        return out

    def joined(a, b):
        (s, top, low, fall), (s2, top2, low2, fall2) = a, b
        return s + s2, np.maximum(top, s + top2), np.minimum(low, s + low2), np.maximum(np.maximum(fall, fall2), top - (s + low2))

    part = (steps, np.maximum(steps, 0), steps, np.maximum(-steps, 0))
    taken, size, whole = 0, 1, None
    while size <= length:
        if length & size:
            piece = tuple(v[taken : taken + n] for v in part)
            whole = piece if whole is None else joined(whole, piece)
            taken += size
        if 2 * size <= length:
            part = joined(tuple(v[:-size] for v in part), tuple(v[size:] for v in part))
        size *= 2
    out[:n] = whole[3]
    return out


def risk_window(df: DataFrame, returns: str, skip: int = 10, length: int = 100, equity: float = 5000.0, limit: float = 50.0, chunk_rows: int = 20_000) -> DataFrame:
    """Adds ``risky``: whether the path of the log returns from ``skip`` rows on falls by more than a limit of money.

    Rows without a whole path ahead are left out. A symbol's rows are looked at in chunks, with the rows after them that they need.
    """
    reach = skip + length - 1

    def mark(f: pd.DataFrame) -> dict:
        falls = np.full(len(f), np.nan)
        falls[: max(0, len(f) - skip)] = deepest_falls(f[returns].to_numpy(float), length)[skip:]
        return {"__fall": falls}

    found = splits.in_chunks(df, mark, "__fall double", 1, max(chunk_rows, reach), reach).drop("row")
    risky = ((1 - F.exp(-F.col("__fall"))) * equity > limit).cast("int")
    return found.where(F.col("__fall").isNotNull() & ~F.isnan("__fall")).withColumn("risky", risky).drop("__fall")


def learned_bins(df: DataFrame, x: str, train: Column, bins: int = 4) -> list[float]:
    """Bounds between equal shares of a column's training rows, for ``scalar.bucket`` on any rows."""
    return quantiles(df.where(train), [x], [k / bins for k in range(1, bins)])[x]


def meta_targets(df: DataFrame, target: str, prediction: str, regime: str, regimes: list[str]) -> DataFrame:
    """Adds the residual of a prediction and fixed one-hot columns of a regime."""
    from tickloom.functions.scalar import one_hot

    return df.withColumn("delta", F.col(target) - F.col(prediction)).withColumns(one_hot(F.col(regime), regimes, "regime"))
