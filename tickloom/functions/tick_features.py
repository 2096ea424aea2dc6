"""Features of ticks over frames of rows of a symbol; columns ``mid``, ``spread``, ``sign`` and ``delta_t`` are given."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.operators.clean import clip
from tickloom.sources.ticks import by_symbol, last_rows, so_far


def log_return(price: str = "mid", step: int = 1, before: Column | None = None) -> Column:
    """Null for the first rows, which have nothing before them; ``before`` is the earlier price, where it is known."""
    before = F.lag(price, step).over(by_symbol()) if before is None else before
    return F.when(before.isNotNull(), F.ln(F.col(price) / F.greatest(before, F.lit(1e-12))))


def last_returns(n: int = 5) -> dict[str, Column]:
    return {f"ret_{k}": F.coalesce(F.lag("log_return", k).over(by_symbol()), F.lit(0.0)) for k in range(n)}


def lagged_returns(n: int = 5) -> dict:
    """``last_returns`` as functions of a window, for chunks."""
    return {f"ret_{k}": lambda w, k=k: F.coalesce(F.lag("log_return", k).over(w), F.lit(0.0)) for k in range(n)}


def momentum(n: int) -> Column:
    base = F.lag("mid", n).over(by_symbol())
    return F.when(base >= 1e-12, clip((F.col("mid") - base) / base, -1, 1)).otherwise(0.0)


def atr(n: int = 14) -> Column:
    """Mean of the last absolute moves (column ``move``)."""
    return F.avg("move").over(last_rows(n))


def move() -> Column:
    """Absolute move of the mid price, 0 at first."""
    return F.coalesce(F.abs(F.col("mid") - F.lag("mid").over(by_symbol())), F.lit(0.0))


def frozen_z(x: Column, mean: Column, std: Column) -> Column:
    return clip((x - mean) / F.greatest(std, F.lit(1e-8)), -5, 5)


def expanding_z(name: str) -> Column:
    """Standard score among all values so far, this one included; 0 with fewer than two."""
    mean, std = F.avg(name).over(so_far()), F.stddev_samp(name).over(so_far())
    return F.when(F.count(name).over(so_far()) >= 2, frozen_z(F.col(name), mean, std)).otherwise(0.0)


def forward_return(stride: int, price: str = "mid") -> Column:
    ahead = F.lead(price, stride).over(by_symbol())
    return F.coalesce(F.ln(F.greatest(ahead, F.lit(1e-12)) / F.greatest(F.col(price), F.lit(1e-12))), F.lit(0.0))


def wavelet_kernels(scales: int = 32) -> list[list[float]]:
    """Half Morlet kernels, of unit length and rounded to single precision; the last weight is for the newest value."""
    out = []
    for i in range(1, scales + 1):
        s = 2 ** (3 * i / scales)
        t = np.arange(-max(4, int(3 * s)), 1) / s
        k = np.exp(-0.5 * t * t) * np.cos(5 * t)
        out.append((k / np.linalg.norm(k)).astype(np.float32).astype(float).tolist())
    return out


def rule_regime(hf_energy: Column, velocity_var: Column, cusum_energy: Column) -> Column:
    """volatile, sideways, up or down, by fixed rules in this order."""
    return F.when(hf_energy > 0.3, "volatile").when(velocity_var < 1e-5, "sideways").when(cusum_energy > 0, "up").otherwise("down")


def sideways_confidence(velocity_var: Column) -> Column:
    return clip(1 / (1 + velocity_var / 1e-4), 0, 1)


def vector_history(vector: str, n: int = 10) -> Column:
    """The last ``n`` feature vectors as one array."""
    return F.flatten(F.collect_list(vector).over(last_rows(n)))


# Features over long frames: a chunk of a symbol's rows and the frame before it, in numpy.


def _sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sums of the last ``n`` values; NaN counts as 0."""
    total = np.concatenate(([0.0], np.cumsum(np.nan_to_num(x))))
    at = np.arange(1, len(total))
    return total[at] - total[np.maximum(0, at - n)]


def rolling_mean(x: np.ndarray, n: int) -> np.ndarray:
    """Means of the last ``n`` values that are not NaN."""
    with np.errstate(invalid="ignore"):
        return _sums(x, n) / _sums((~np.isnan(x)).astype(float), n)


def rolling_variance(x: np.ndarray, n: int) -> np.ndarray:
    """Population variances; the chunk's own mean is taken off first, so that squares stay small."""
    x = x - np.nanmean(x) if not np.isnan(x).all() else x
    return np.maximum(rolling_mean(x * x, n) - rolling_mean(x, n) ** 2, 0.0)


def rolling_quantile(x: np.ndarray, n: int, q: float, step: int = 2048) -> np.ndarray:
    """Interpolated quantiles of the last ``n`` values, by sorting every frame; shorter frames at the start."""
    out = np.empty(len(x))
    for i in range(min(n - 1, len(x))):
        out[i] = np.quantile(x[: i + 1], q)
    if len(x) >= n:
        frames = np.lib.stride_tricks.sliding_window_view(x, n)
        at = q * (n - 1)
        low = int(at)
        for a in range(0, len(frames), step):
            part = np.partition(frames[a : a + step], (low, min(low + 1, n - 1)), axis=1)
            out[n - 1 + a : n - 1 + a + len(part)] = part[:, low] + (at - low) * (part[:, min(low + 1, n - 1)] - part[:, low])
    return out


def chunk_imbalance(f: pd.DataFrame, window: int = 500) -> dict[str, np.ndarray]:
    s = f["sign"].to_numpy(float)
    return {
        "tib": np.rint(_sums(s, window)).astype(np.int64), "cib": rolling_mean(s, window),
        "up_share": rolling_mean((s == 1).astype(float), window), "down_share": rolling_mean((s == -1).astype(float), window),
    }


def chunk_volatility_ratio(f: pd.DataFrame, short: int = 5, long: int = 512) -> dict[str, np.ndarray]:
    x = f["log_return"].to_numpy(float)
    a, b = rolling_variance(x, short), rolling_variance(x, long - 1)
    return {"vol_ratio": np.clip(np.log((a + 1e-12) / (b + 1e-12)), -5, 5)}


def chunk_realised_variance(f: pd.DataFrame, window: int = 1001) -> dict[str, np.ndarray]:
    return {"variance": rolling_variance(f["log_return"].to_numpy(float), window - 1)}


def chunk_spread_features(f: pd.DataFrame, window: int = 512) -> dict[str, np.ndarray]:
    s = f["spread"].to_numpy(float)
    mean, std = rolling_mean(s, window), np.sqrt(rolling_variance(s, window))
    return {
        "spread_z": np.clip((s - (mean + 1e-8)) / (std + 1e-8), -5, 5),
        "spread_ratio": np.clip(rolling_mean(s, 10) / (mean + 1e-8), 0, 10),
        "spread_spike": np.clip(s / (rolling_quantile(s, window, 0.95) + 1e-8), 0, 10),
    }


def _before(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([np.full(min(n, len(x)), np.nan), x[: max(0, len(x) - n)]])


def chunk_moves(f: pd.DataFrame, returns: int = 5, momenta: tuple[int, ...] = (5, 20)) -> dict[str, np.ndarray]:
    """``log_return``, ``last_returns`` and ``momentum`` of the mid price; a price that is not positive has no logarithm."""
    x = f["mid"].to_numpy(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        logs = np.log(np.where(x > 0, x, np.nan) / np.maximum(_before(x, 1), 1e-12))
        out = {"log_return": logs, **{f"ret_{k}": np.nan_to_num(_before(logs, k)) for k in range(returns)}}
        for n in momenta:
            base = _before(x, n)
            out[f"momentum_{n}"] = np.where(base >= 1e-12, np.clip((x - base) / base, -1, 1), 0.0)
    return out


def chunk_gaps(f: pd.DataFrame) -> np.ndarray:
    """``delta_t``: seconds since the last tick, from a microsecond to a minute; a first row takes the second one's."""
    at = f["timestamp_ns"].to_numpy()
    gaps = np.diff(at) / 1e9
    return np.clip(np.concatenate([gaps[:1] if len(gaps) else [1e-6], gaps]), 1e-6, 60.0)


def chunk_wavelet_energy(f: pd.DataFrame, scales: int = 32) -> np.ndarray:
    """Shares of energy by row and scale, of the last ``delta_t`` values; before a symbol's first value that stands for all."""
    kernels = wavelet_kernels(scales)
    taps = max(map(len, kernels))
    x = np.log1p(np.clip(f["delta_t"].to_numpy(float), 0, 1e6))
    frames = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(taps - 1, x[0]), x]), taps)
    table = np.zeros((taps, scales))
    for i, k in enumerate(kernels):
        table[taps - len(k) :, i] = k
    energy = (frames @ table) ** 2
    total = energy.sum(axis=1, keepdims=True)
    return np.where(total > 1e-8, energy / np.where(total > 1e-8, total, 1), energy)
