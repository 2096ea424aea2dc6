"""Features of bars over frames of a symbol's bars (columns open, high, low, close, volume, tib)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.operators.bars import by_bar, last_bars
from tickloom.operators.clean import clip

C = F.col


def _lag(name: str, n: int = 1) -> Column:
    return F.lag(name, n).over(by_bar())


def _mean(name: str, n: int) -> Column:
    return F.avg(name).over(last_bars(n))


def sma_distance(n: int) -> Column:
    return (C("close") - _mean("close", n)) / _mean("close", n)


def roc(n: int) -> Column:
    base = F.coalesce(_lag("close", n), C("close"))
    return (C("close") - base) / base


def true_range() -> Column:
    before = F.coalesce(_lag("close"), C("close"))
    return F.greatest(C("high") - C("low"), F.abs(C("high") - before), F.abs(C("low") - before))


def atr_ratio(short: int = 5, long: int = 20) -> Column:
    """Of column ``tr``."""
    return _mean("tr", short) / (_mean("tr", long) + 1e-12)


def bollinger_width(n: int) -> Column:
    return F.stddev_samp("close").over(last_bars(n)) / _mean("close", n)


def log_return() -> Column:
    return F.ln(C("close") / _lag("close"))


def return_variance(n: int) -> Column:
    """Of column ``log_return``."""
    return F.var_samp("log_return").over(last_bars(n))


def volume_surge(short: int = 5, long: int = 20) -> Column:
    return _mean("volume", short) / F.greatest(_mean("volume", long), F.lit(1e-10))


def volume_roc(n: int = 5) -> Column:
    base = F.coalesce(_lag("volume", n), C("volume"))
    return (C("volume") - base) / F.greatest(base, F.lit(1e-10))


def flow() -> Column:
    """Volume with the direction of its bar, for order-flow imbalance."""
    return C("volume") * (C("close") - C("open")) / F.greatest(C("high") - C("low"), F.lit(1e-10))


def rolling_z(name: str, n: int = 90, least: int = 5) -> Column:
    w = last_bars(n)
    z = (C(name) - F.avg(name).over(w)) / F.greatest(F.stddev_samp(name).over(w), F.lit(1e-10))
    return F.when(F.count(name).over(w) >= least, clip(z, -10, 10))


def fractional_weights(d: float = 0.45, least: float = 1e-5, most: int = 500) -> list[float]:
    """Weights of fractional differencing, newest first."""
    out = [1.0]
    while len(out) < most:
        w = -out[-1] * (d - len(out) + 1) / len(out)
        if abs(w) < least:
            break
        out.append(w)
    return out


def fractional_difference(name: str, d: float = 0.45, most: int = 500) -> Column:
    """Null until there is a value for each weight; one pass over an array of the last values."""
    weights = fractional_weights(d, most=most)
    values = F.collect_list(name).over(last_bars(len(weights)))
    dot = F.aggregate(F.zip_with(values, F.array(*(F.lit(w) for w in reversed(weights))), lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(values) == len(weights), dot)


def micro_momentum() -> Column:
    """Of column ``roc5``, in percent: over its largest size among the last 60."""
    big = F.max(F.abs("roc5")).over(last_bars(60))
    return F.when(F.count("roc5").over(last_bars(60)) >= 5, clip(C("roc5") / F.greatest(big, F.lit(1e-8)), -1, 1))


def volatility_clustering(short: int = 10, long: int = 100) -> Column:
    a, b = (F.greatest(return_variance(n), F.lit(1e-12)) for n in (short, long))
    return clip(F.ln(a / b), -5, 5)


def realised_skew(n: int = 20) -> Column:
    """Biased skewness of the last log returns, bounded by 3."""
    return clip(F.skewness("log_return").over(last_bars(n)), -3, 3)


def macro_alignment(n: int = 60) -> Column:
    """Of column ``trend``, the distance to a long mean: over its own deviation."""
    return clip(C("trend") / F.greatest(F.stddev_samp("trend").over(last_bars(n)), F.lit(1e-10)), -5, 5)


def liquidity_surge() -> Column:
    return clip(_mean("volume", 12) / F.greatest(_mean("volume", 288), F.lit(1e-10)), 0, 10)


def ofi_normalised(n: int = 60) -> Column:
    """Of columns ``flow`` and ``volume``: flow over its largest size among the last bars; the direction of the bar without volume."""
    raw = F.when(C("volume") > 0, C("flow")).otherwise(F.signum(C("close") - C("open")))
    return raw / F.greatest(F.max(F.abs(raw)).over(last_bars(n)), F.lit(1e-10))


def floored(name: str, n: int = 50) -> Column:
    """A column, at least its median over the last bars."""
    return F.greatest(C(name), F.percentile(name, 0.5).over(last_bars(n)))


def lagged(name: str) -> Column:
    """The column's last known value up to the bar before, 0 at first."""
    from pyspark.sql import Window

    return F.coalesce(F.last(name, ignorenulls=True).over(by_bar().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))


def extremes(name: str, n: int) -> dict[str, Column]:
    w = last_bars(n)
    return {"highest": F.max(name).over(w), "lowest": F.min(name).over(w), "middle": F.percentile(name, 0.5).over(w)}


def cumulative_delta() -> Column:
    from pyspark.sql import Window

    return F.sum(C("tib") * C("volume")).over(by_bar().rowsBetween(Window.unboundedPreceding, 0))


def recent(flag: str, n: int = 4) -> Column:
    return F.max(C(flag).cast("int")).over(last_bars(n)) == 1


def slope(name: str, n: int = 5) -> Column:
    return C(name) - _lag(name, n)
