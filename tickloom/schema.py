"""Schemas of the engine's tables, and their check."""

from __future__ import annotations

from pyspark.sql import DataFrame

TICK = "symbol string, seq bigint, timestamp_ns bigint, ts timestamp, bid double, ask double, delta_t double, sign tinyint"
BAR = "symbol string, bar_start timestamp, open double, high double, low double, close double, volume double, tib double"
TRADE = "symbol string, entry_time bigint, exit_time bigint, direction string, entry_price double, exit_price double, pnl double, reason string"
PROP_PROFILE = "name string, profit_target_pct double, max_daily_dd_usd double, max_total_dd_pct double, trading_days int, min_trading_days int"
SYMBOL = "symbol string, pip_size double, pip_value double"


def require(df: DataFrame, columns: str) -> DataFrame:
    """``df``, if it has the ``columns`` (as in a schema text) by name and simple type; an error names those that are missing or differ."""
    wanted = dict(c.split() for c in columns.split(", "))
    have = dict(df.dtypes)
    wrong = [f"{n}: {have.get(n, 'missing')} instead of {t}" for n, t in wanted.items() if have.get(n) != t]
    if wrong:
        raise ValueError("schema: " + ", ".join(wrong))
    return df


def feature_columns(df: DataFrame, prefix: str = "f_", width: int | None = None) -> list[str]:
    """Columns of a prefix, in order of their number; ``width`` is their required count."""
    found = sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: (len(c), c))
    if width is not None and len(found) != width:
        raise ValueError(f"{len(found)} columns begin with {prefix}, not {width}")
    return found
