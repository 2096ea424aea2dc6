"""Risk decisions on proposed trades: drawdown halts, Kelly fractions, vetoes, stops and sizes, all as windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# fixed values: stop and target in average true ranges, by regime
STOPS = {"TREND": (3.0, 8.0), "MEAN_REV": (1.5, 3.0)}
OTHER_STOPS = (2.0, 5.0)


@dataclass(frozen=True)
class RiskLimits:
    """Falls are shares of the day's first equity and of the peak; both are exceeded strictly."""

    initial: float = 5000.0
    daily: float = 0.05
    total: float = 0.10
    least_p: float = 0.65
    most_open: int = 3
    most_fraction: float = 0.02
    share_of_kelly: float = 0.25
    window: int = 100
    least_outcomes: int = 30


def kelly(p: Column, pnl: str, rows: WindowSpec, limits: RiskLimits = RiskLimits()) -> Column:
    """The part of Kelly's fraction to stake: from the last outcomes before the row, of a probability while they are few.

    An outcome of 0 is a loss and null is none.
    """
    past = rows.rowsBetween(-limits.window, -1)
    n, wins = F.count(pnl).over(past), F.count_if(F.col(pnl) > 0).over(past)
    gain = F.sum(F.greatest(pnl, F.lit(0.0))).over(past) / F.greatest(wins, F.lit(1))
    loss = -F.sum(F.least(pnl, F.lit(0.0))).over(past) / F.greatest(n - wins, F.lit(1))
    odds, share = gain / F.greatest(loss, F.lit(1e-10)), wins / n
    learnt = (share * odds - (1 - share)) / F.greatest(odds, F.lit(1e-10))
    full = F.when(n >= limits.least_outcomes, learnt).otherwise(2 * p - 1)
    return F.greatest(F.lit(0.0), full * limits.share_of_kelly)


def halts(df: DataFrame, pnl: str, at: str, by: tuple[str, ...] = ("symbol",), limits: RiskLimits = RiskLimits()) -> DataFrame:
    """``df`` with ``equity`` before each row and ``halt_reason``, null until an earlier outcome broke a limit.

    A halt is for good and bears the reason of the last breach, of both that of the total. A row without outcome
    (null) changes nothing; a day begins with its first outcome.
    """
    so_far = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    today = Window.partitionBy(*by, F.to_date(at)).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    after = df.withColumn("__after", F.when(F.col(pnl).isNotNull(), limits.initial + F.sum(pnl).over(so_far)))
    begin, peak = F.first("__after", ignorenulls=True).over(today), F.greatest(F.lit(limits.initial), F.max("__after").over(so_far))
    broken = F.when(F.col("__after") / peak - 1 < -limits.total, "total").when(F.col("__after") / begin - 1 < -limits.daily, "daily")
    found = after.withColumn("__broken", broken)
    equity = F.coalesce(F.last("__after", ignorenulls=True).over(before), F.lit(limits.initial))
    return found.withColumns({"equity": equity, "halt_reason": F.last("__broken", ignorenulls=True).over(before)}).drop("__after", "__broken")


def decide(df: DataFrame, at: str, pnl: str = "pnl", by: tuple[str, ...] = ("symbol",), limits: RiskLimits = RiskLimits()) -> DataFrame:
    """``df`` with ``veto``, null for a trade to make, and its ``fraction``, ``units``, ``stop_loss`` and ``take_profit``.

    Reads ``direction``, ``p``, ``atr``, ``price``, ``scale``, ``regime``, ``n_open`` and ``held``, and the outcome of
    each row's trade, which counts for the rows after it. Vetoes are tried in the order halt, probability, full, held.
    """
    halted = halts(df, pnl, at, by, limits)
    veto = (
        F.when(F.col("halt_reason").isNotNull(), F.col("halt_reason"))
        .when(F.col("p") < limits.least_p, "probability")
        .when(F.col("n_open") >= limits.most_open, "full")
        .when(F.col("held"), "held")
    )
    stop, take = F.lit(OTHER_STOPS[0]), F.lit(OTHER_STOPS[1])
    for regime, (s, t) in STOPS.items():
        stop, take = F.when(F.col("regime") == regime, s).otherwise(stop), F.when(F.col("regime") == regime, t).otherwise(take)
    fraction = F.least(kelly(F.col("p"), pnl, Window.partitionBy(*by).orderBy(at), limits), F.lit(limits.most_fraction)) * F.col("scale")
    sized = halted.withColumns({"veto": veto, "fraction": fraction})
    side = F.when(F.col("direction") == 1, 1).otherwise(-1)
    made = {
        "fraction": F.col("fraction"),
        "units": F.col("fraction") * F.col("equity") / F.greatest(F.col("atr") * stop, F.lit(1e-10)),
        "stop_loss": F.col("price") - side * F.col("atr") * stop,
        "take_profit": F.col("price") + side * F.col("atr") * take,
    }
    return sized.withColumns({name: F.when(F.col("veto").isNull(), value) for name, value in made.items()})
