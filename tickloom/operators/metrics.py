"""Performance and risk metrics as aggregates, so that each is one pass with partial sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import normal_cdf
from tickloom.operators.staging import kept

INF = float("inf")


def sharpe(x: Column, periods: float = 252, sample: bool = True) -> Column:
    """Mean over deviation, annualised; 0 without spread or with one value."""
    std = F.stddev_samp(x) if sample else F.stddev_pop(x)
    return F.when((F.count(x) > 1) & (std >= 1e-8), F.avg(x) / std * math.sqrt(periods)).otherwise(0.0)


def downside(x: Column) -> Column:
    """Deviation of the negative values; 0 with fewer than two."""
    negative = F.when(x < 0, x)
    return F.when(F.count(negative) > 1, F.stddev_samp(negative)).otherwise(0.0)


def sortino(x: Column) -> Column:
    std = downside(x)
    return F.when(std >= 1e-8, F.avg(x) / std).otherwise(INF)


def value_at_risk(x: Column, confidence: float = 0.95) -> Column:
    return -F.percentile(x, 1 - confidence)


def expected_shortfall(df: DataFrame, by: str, x: str, confidence: float = 0.95) -> DataFrame:
    """(by, var, cvar): the mean of the values that are at or beyond the value at risk."""
    risk = df.groupBy(by).agg(value_at_risk(F.col(x), confidence).alias("var"))
    beyond = df.join(risk, by).groupBy(by).agg(F.first("var").alias("var"), F.avg(F.when(F.col(x) <= -F.col("var"), F.col(x))).alias("mean"))
    return beyond.select(by, "var", F.coalesce(-F.col("mean"), F.col("var")).alias("cvar"))


def tail_ratio(x: Column, c: float = 0.05) -> Column:
    return F.percentile(x, 1 - c) / (F.abs(F.percentile(x, c)) + 1e-8)


def profit_factor(x: Column) -> Column:
    gain, loss = F.sum(F.when(x > 0, x).otherwise(0.0)), -F.sum(F.when(x < 0, x).otherwise(0.0))
    return F.when(loss < 1e-8, INF).otherwise(gain / loss)


def drawdowns(df: DataFrame, by: str, order: list[str], x: str) -> DataFrame:
    """``df`` with the running peak of an equity column and the fall from it."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(x).over(w)
    return df.withColumns({"peak": peak, "drawdown": peak - F.col(x)})


def equity_curve(df: DataFrame, by: str, order: list[str], returns: str, share: float = 0.05, initial: float = 100_000.0) -> DataFrame:
    """``df`` with compounded equity, its peak and the relative drawdown."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    equity = initial * F.exp(F.sum(F.log1p(share * F.col(returns))).over(w))
    out = df.withColumn("equity", equity)
    peak = F.max("equity").over(w)
    return out.withColumns({"peak": peak, "drawdown": F.col("equity") / peak - 1})


def calmar(mean: Column, drawdown_share: Column, periods: float = 252) -> Column:
    return F.when(drawdown_share < 1e-8, INF).otherwise(periods * mean / drawdown_share)


def trade_statistics(x: Column) -> dict[str, Column]:
    """Of profits and losses: a trade that gains nothing is a loss."""
    n, wins = F.count(x), F.count_if(x > 0)
    rate = wins / n
    win, loss = F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)), F.coalesce(F.avg(F.when(x <= 0, -x)), F.lit(0.0))
    return {
        "n_trades": n,
        "win_rate": rate,
        "avg_win": win,
        "avg_loss": loss,
        "expectancy": rate * win - (1 - rate) * loss,
        "kelly": F.when((win > 0) & (loss > 0), rate - (1 - rate) / (win / loss)).otherwise(0.0),
    }


def passes(max_drawdown: Column, calmar_ratio: Column, win_rate: Column, limit: float = 125.0, least_calmar: float = 4.5, least_rate: float = 0.48) -> dict[str, Column]:
    gates = {"pass_drawdown": max_drawdown <= limit, "pass_calmar": calmar_ratio >= least_calmar, "pass_win_rate": win_rate >= least_rate}
    every = F.lit(True)
    for g in gates.values():
        every = every & g
    return gates | {"pass_all": every}


def daily_sums(df: DataFrame, by: str, ts: str, x: str) -> DataFrame:
    """(by, day, total) of every calendar day from the first to the last, 0 on days without rows."""
    sums = df.groupBy(by, F.to_date(ts).alias("day")).agg(F.sum(x).alias("total"))
    ends = sums.groupBy(by).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select(by, F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(sums, [by, "day"], "left").select(by, "day", F.coalesce("total", F.lit(0.0)).alias("total"))


def by_period(df: DataFrame, periods: DataFrame, ts: str, x: str) -> DataFrame:
    """Counts, sums and profit factors of closed periods (name, begin, finish); the periods are few constants."""
    joined = df.join(F.broadcast(periods), (F.col(ts) >= F.col("begin")) & (F.col(ts) <= F.col("finish")))
    return joined.groupBy("name").agg(F.count("*").alias("n"), F.sum(x).alias("total"), profit_factor(F.col(x)).alias("profit_factor"))


def moments(x: Column) -> dict[str, Column]:
    """Biased skewness and excess kurtosis."""
    return {"skew": F.skewness(x), "excess_kurtosis": F.kurtosis(x)}


def ranks(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, x, rank) of the values of a column: equal values share the mean of their places.

    Counts of values are sorted over all tasks; a value's rank is what its task's part and the parts before hold. So neither a
    group nor a value is one task's work.
    """
    counts = kept(df.groupBy(*by, x).agg(F.count("*").alias("__c")).orderBy(*by, x)).withColumn("__part", F.spark_partition_id())
    parts = counts.groupBy(*by, "__part").agg(F.sum("__c").alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum")
    so_far = F.sum("__c").over(Window.partitionBy(*by, "__part").orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    return _matched(counts, before, [*by, "__part"]).select(*by, x, (F.col("__before") + so_far - (F.col("__c") - 1) / 2.0).alias("rank"))


def _matched(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """A join in which nulls are equal."""
    named = other.withColumnsRenamed({c: f"__r_{c}" for c in on})
    return df.join(named, [df[c].eqNullSafe(named[f"__r_{c}"]) for c in on]).drop(*(f"__r_{c}" for c in on))


def rank_correlation(df: DataFrame, by: str | list[str], x: str, y: str, least: int = 100) -> DataFrame:
    """(by, n, ic, p): correlation of ranks and its two-sided normal p-value; 0 and 1 up to ``least`` rows."""
    keys = [by] if isinstance(by, str) else by
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y"))
    ranked = known
    for c in ("__x", "__y"):
        ranked = _matched(ranked, ranks(known, keys, c).withColumnRenamed("rank", f"{c}_rank"), [*keys, c])
    found = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("__x_rank", "__y_rank").alias("ic"))
    z = F.abs("ic") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("ic") * F.col("ic"), F.lit(1e-12)))
    enough = F.col("n") > least
    return found.withColumn("p", F.when(enough, 2 * (1 - normal_cdf(z))).otherwise(1.0)).withColumn("ic", F.when(enough, F.col("ic")).otherwise(0.0))


def buy_and_hold(df: DataFrame, by: str, order: list[str], close: str, periods: float = 252) -> DataFrame:
    """Return, growth a year, largest fall over the highest price, and Sharpe ratio of holding each asset."""
    at, w = F.struct(*order), Window.partitionBy(by).orderBy(*order)
    peak = F.max(close).over(w.rowsBetween(Window.unboundedPreceding, 0))
    moved = df.withColumns({"__fall": F.col(close) - peak, "__ret": F.col(close) / F.lag(close).over(w) - 1})
    total = F.max_by(close, at) / F.min_by(close, at) - 1
    years = F.greatest(F.count("*") / periods, F.lit(0.1))
    return moved.groupBy(by).agg(
        total.alias("total_return"), (F.pow(1 + total, 1 / years) - 1).alias("cagr"), (F.min("__fall") / F.max(close)).alias("max_drawdown"),
        (F.avg("__ret") / (F.stddev_pop("__ret") + 1e-10) * math.sqrt(periods)).alias("sharpe"),
    )


def inverse_volatility(df: DataFrame, by: str, at: str, returns: str, window: int = 20) -> DataFrame:
    """Adds ``weight``: the inverse deviation up to the period before, normalised over the assets of a period."""
    w = Window.partitionBy(by).orderBy(at)
    std = F.stddev_samp(returns).over(w.rowsBetween(-(window - 1), 0))
    lagged = df.withColumn("__std", std).withColumn("__inv", 1 / F.nullif(F.lag("__std").over(w), F.lit(0.0)))
    total = F.sum("__inv").over(Window.partitionBy(at))
    return lagged.withColumn("weight", F.col("__inv") / total).drop("__std", "__inv")


def leaderboard(df: DataFrame, score: str, shape: list[str], n: int = 10, least: float = 0.95, exempt: int = 3) -> DataFrame:
    """The ``n`` best scores above a limit; after the ``exempt`` best ones, only the best of each shape.

    The best of each shape and the exempt ones are taken first, each by a top list, so none is lost to a shape of many rows.
    """
    good = df.where(F.col(score) > least)
    order = [F.desc(score), *df.columns]
    top = good.orderBy(*order).limit(exempt)
    best = good.withColumn("__of_shape", F.row_number().over(Window.partitionBy(*shape).orderBy(*order))).where("__of_shape = 1").drop("__of_shape")
    kept = top.unionByName(best.orderBy(*order).limit(n + exempt)).distinct()
    return kept.orderBy(*order).limit(n)


def trade_sharpe(x: Column, n_days: Column) -> Column:
    """Mean over population deviation of trades, annualised by the trades a year, at least one."""
    per_year = F.greatest(F.count(x) / (n_days / 252), F.lit(1.0))
    return F.when(F.stddev_pop(x) >= 1e-8, F.avg(x) / F.stddev_pop(x) * F.sqrt(per_year)).otherwise(0.0)


def annual_calmar(first: Column, last: Column, n_days: Column, drawdown_usd: Column, initial: float) -> Column:
    """Annualised growth over the largest fall as a share of the first equity."""
    growth = F.pow(last / first, 252 / n_days) - 1
    return F.when(drawdown_usd < 1e-8, INF).otherwise(growth / (drawdown_usd / initial))


def bar_metrics(equity: DataFrame, by: str, order: list[str], x: str = "equity", periods: float = 252, initial: float = 100_000.0) -> DataFrame:
    """Return, growth, fall and ratios of an equity column by group; 999 for a ratio without a fall."""
    w = Window.partitionBy(by).orderBy(*order)
    peak = F.max(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
    moved = equity.withColumns({"__ret": (F.col(x) - F.lag(x).over(w)) / (F.lag(x).over(w) + 1e-10), "__dd": (F.col(x) - peak) / (peak + 1e-10)})
    at = F.struct(*order)
    negative = F.when(F.col("__ret") < 0, F.col("__ret"))
    ratio = lambda std: F.avg("__ret") / (std + 1e-10) * math.sqrt(periods)
    years = F.greatest(F.count("*") / periods, F.lit(0.1))
    final, first = F.max_by(x, at), F.min_by(x, at)
    out = moved.groupBy(by).agg(
        ((final / initial - 1) * 100).alias("total_ret_pct"),
        ((F.pow(final / first, 1 / years) - 1) * 100).alias("cagr_pct"),
        (F.min("__dd") * 100).alias("max_drawdown_pct"),
        F.coalesce(ratio(F.stddev_pop("__ret")), F.lit(0.0)).alias("sharpe_ratio"),
        F.coalesce(F.when(F.count(negative) > 0, ratio(F.stddev_pop(negative))), F.lit(0.0)).alias("sortino_ratio"),
    )
    return out.withColumn("calmar_ratio", F.when(F.col("max_drawdown_pct") < 0, F.col("cagr_pct") / F.abs("max_drawdown_pct")).otherwise(999.0))


def exit_statistics(trades: DataFrame, by: str, initial: float = 100_000.0) -> DataFrame:
    """Of trades (pnl, direction, exit_type, bars_held): rates by direction, counts by exit, mean gains in percent."""
    share = lambda part, whole: F.coalesce(F.try_divide(100.0 * F.count_if(part), F.count_if(whole)), F.lit(0.0))
    won, long, short = F.col("pnl") > 0, F.col("direction") == 1, F.col("direction") == -1
    mean = lambda keep: F.coalesce(F.avg(F.when(keep, F.col("pnl") / initial * 100)), F.lit(0.0))
    return trades.groupBy(by).agg(
        F.count("*").alias("n_trades"), share(won, F.lit(True)).alias("win_rate_pct"), share(won & long, long).alias("long_win_rate"), share(won & short, short).alias("short_win_rate"),
        mean(won).alias("avg_win_pct"), mean(~won).alias("avg_loss_pct"), F.avg("bars_held").alias("avg_bars"),
        *(F.count_if(F.col("exit_type") == k).alias(f"{k.lower()}_count") for k in ("STOP", "TAKE", "TIME", "EOD")),
    )


def fold_metrics(trades: DataFrame, by: str, limit: float = 125.0, least_rate: float = 0.48, initial: float = 5000.0) -> DataFrame:
    """(by, n_trades, win_rate, max_drawdown, pass_all) of each fold's own equity, which begins at ``initial``."""
    w = Window.partitionBy(by).orderBy("entry").rowsBetween(Window.unboundedPreceding, 0)
    curve = trades.withColumn("__equity", initial + F.sum("pnl").over(w))
    fallen = curve.withColumn("__fall", F.greatest(F.max("__equity").over(w), F.lit(initial)) - F.col("__equity"))
    out = fallen.groupBy(by).agg(F.count("*").alias("n_trades"), (F.count_if(F.col("pnl") > 0) / F.count("*")).alias("win_rate"), F.max("__fall").alias("max_drawdown"))
    return out.withColumn("pass_all", (F.col("max_drawdown") <= limit) & (F.col("win_rate") >= least_rate))


def over_folds(folds: DataFrame) -> DataFrame:
    return folds.agg(F.count("*").alias("n_folds"), F.sum("n_trades").alias("n_trades"), F.coalesce(F.avg(F.col("pass_all").cast("int")), F.lit(0.0)).alias("pct_folds_pass"))


def portfolio(assets: DataFrame) -> DataFrame:
    """Of assets (n_trades, win_rate_pct, ret): all trades, wins counted asset by asset, and the mean return."""
    wins = F.sum(F.floor(F.col("n_trades") * F.col("win_rate_pct") / 100))
    return assets.agg(F.sum("n_trades").alias("n_trades"), wins.alias("n_wins"), (100.0 * wins / F.sum("n_trades")).alias("win_rate_pct"), F.avg("ret").alias("ret"))


def portfolio_ratios(returns: DataFrame, weights: DataFrame, asset: str, day: str, ret: str, periods: int = 252) -> DataFrame:
    """(n, sharpe, cagr_pct, max_drawdown_pct, total_pct) of the daily sums of returns times weights; a missing weight is an equal share of all assets."""
    n_assets = returns.select(asset).distinct().count()
    both = returns.join(weights.select(asset, day, "weight"), [asset, day], "left")
    daily = both.groupBy(day).agg(F.sum(F.coalesce(F.col(ret), F.lit(0.0)) * F.coalesce("weight", F.lit(1.0 / max(1, n_assets)))).alias("ret"))
    so_far = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    level = daily.withColumn("level", F.exp(F.sum(F.log1p("ret")).over(so_far)))
    fall = level.withColumn("fall", F.col("level") / F.max("level").over(so_far) - 1)
    end, years = F.max_by("level", day), F.count("*") / periods
    std = F.stddev_samp("ret") * math.sqrt(periods)
    return fall.agg(
        F.count("*").alias("n"), F.when(std > 0, F.avg("ret") * periods / std).otherwise(0.0).alias("sharpe"), (100 * (F.pow(end, 1 / years) - 1)).alias("cagr_pct"),
        (100 * F.min("fall")).alias("max_drawdown_pct"), (100 * (end - 1)).alias("total_pct"),
    )


def stability_index(*columns: str) -> Column:
    """Mean over the dimensions of their sample deviations."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.stddev_samp(c)
    return total / len(columns)


def merge_moments(states: DataFrame, by: str) -> DataFrame:
    """One state (n, mean, m2) by group of stored ones, by Chan's formula: the spread of means joins the spreads within."""
    n = F.sum("n")
    merged = states.groupBy(by).agg(n.alias("n"), (F.sum(F.col("n") * F.col("mean")) / n).alias("mean"), F.sum("m2").alias("__in"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("__sq"))
    between = F.greatest(F.col("__sq") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))
    return merged.withColumn("m2", F.col("__in") + between).drop("__in", "__sq")


def tuning_score(calmar_ratio: Column, win_rate: Column, drawdown_usd: Column, n_trades: Column) -> Column:
    """A ratio with penalties for a low win rate, a large fall and few trades."""
    low = F.when(win_rate < 0.45, win_rate / 0.45).otherwise(1.0)
    deep = F.when(drawdown_usd > 1000, 1000 / drawdown_usd).otherwise(1.0)
    return calmar_ratio * low * deep * F.when(n_trades < 200, 0.1).otherwise(1.0)
