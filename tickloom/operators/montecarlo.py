"""Resampling and its statistics; randomness is a hash of what is drawn and a seed, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalar import draw, normal_cdf, normal_ppf
from tickloom.operators.quantiles import quantiles


def uniform(*parts: Column) -> Column:
    """A number from 0 to below 1 from a hash of the parts."""
    return draw(*parts) / float(1 << 32)


def block_bootstrap(returns: DataFrame, simulations: int, length: int, block: int = 5, seed: int = 42) -> DataFrame:
    """(sim, step, ret): circular blocks of consecutive returns (step, ret; steps from 0), by an equi join on the step."""
    n = returns.count()
    spark = returns.sparkSession
    sims = spark.range(simulations).select(F.col("id").alias("sim"))
    steps = sims.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    start = F.pmod(draw(F.col("sim"), F.floor(F.col("step") / block), F.lit(seed)), F.lit(n))
    drawn = steps.withColumn("source", F.pmod(start + F.col("step") % block, F.lit(n)))
    return drawn.join(returns.select(F.col("step").alias("source"), "ret"), "source").select("sim", "step", "ret")


def stationary_bootstrap(returns: DataFrame, simulations: int, mean_block: int = 20, seed: int = 42) -> DataFrame:
    """The same with blocks of geometric length."""
    from pyspark.sql import Window

    n = returns.count()
    steps = returns.sparkSession.range(simulations).select(F.col("id").alias("sim")).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    new = (F.col("step") == 0) | (uniform(F.col("sim"), F.col("step"), F.lit(seed)) < 1 / mean_block)
    w = Window.partitionBy("sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    begun = steps.withColumn("from", F.last(F.when(new, F.col("step")), ignorenulls=True).over(w))
    start = F.pmod(draw(F.col("sim"), F.col("from"), F.lit(seed + 1)), F.lit(n))
    drawn = begun.withColumn("source", F.pmod(start + F.col("step") - F.col("from"), F.lit(n)))
    return drawn.join(returns.select(F.col("step").alias("source"), "ret"), "source").select("sim", "step", "ret")


def bootstrap_test(returns: DataFrame, simulations: int, mean_block: int = 20, seed: int = 42, periods: float = 252) -> DataFrame:
    """(actual, p_value): the Sharpe ratio of returns (step, ret; steps from 0), and the share of stationary resamples that reach it."""
    paths = stationary_bootstrap(returns, simulations, mean_block, seed).select("sim", "ret")
    both = paths.unionByName(returns.select(F.lit(-1).cast("long").alias("sim"), "ret"))
    spread = F.stddev_samp("ret")
    ratio = both.groupBy("sim").agg(F.when(spread > 0, F.avg("ret") / spread * periods**0.5).otherwise(0.0).alias("value"))
    found = ratio.agg(F.max(F.when(F.col("sim") < 0, F.col("value"))).alias("actual"), F.collect_list(F.when(F.col("sim") >= 0, F.col("value"))).alias("drawn"))
    return found.select("actual", F.try_divide(F.size(F.filter("drawn", lambda v: v >= F.col("actual"))), F.size("drawn")).alias("p_value"))


def challenges(paths: DataFrame, initial: float = 5000.0, target: float = 0.08, daily_usd: float = 125.0, total: float = 0.10) -> DataFrame:
    """(sim, passed, breached) of paths of daily returns: a day's loss or the total fall breaches, the final equity passes."""
    state = F.struct(F.lit(initial).alias("equity"), F.lit(False).alias("breached"))
    rows = F.array_sort(F.collect_list(F.struct("step", "ret")))

    def day(s, r):
        after = F.when(s["breached"], s["equity"]).otherwise(s["equity"] * (1 + r["ret"]))
        bad = (s["equity"] - after >= daily_usd) | (after <= initial * (1 - total))
        return F.struct(after.alias("equity"), (s["breached"] | bad).alias("breached"))

    end = paths.groupBy("sim").agg(F.aggregate(rows, state, day).alias("end"))
    return end.select("sim", (~F.col("end.breached") & (F.col("end.equity") >= initial * (1 + target))).alias("passed"), "end.breached")


def wilson(k: Column, n: Column, z: float = 1.645) -> dict[str, Column]:
    """Score interval of a rate, (0, 1) without trials."""
    p = F.try_divide(k, n)
    scale = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return {"low": F.when(n > 0, F.greatest(middle - half, F.lit(0.0))).otherwise(0.0), "high": F.when(n > 0, F.least(middle + half, F.lit(1.0))).otherwise(1.0)}


def beta_mean(k: Column, n: Column) -> Column:
    return (k + 1) / (n + 2)


def path_barrier(losses: DataFrame, by: str, loss: str, budget: Column, quantile: float = 0.999) -> DataFrame:
    """(by, var, allowed): a quantile of simulated losses against a budget, strictly."""
    return losses.groupBy(by).agg(F.percentile(loss, quantile).alias("var")).withColumn("allowed", F.coalesce(F.col("var") < budget, F.lit(False)))


def permutation_test(returns: DataFrame, simulations: int, seed: int = 42, periods: float = 252) -> DataFrame:
    """(actual, p_value) of the Sharpe ratio of the first half of the rows (step, ret; steps from 0), against halves drawn by hash.

    In a simulation a row is in the half if its draw is even, so halves are of about n / 2 rows. A row meets each
    simulation inside its task, which keeps sums by simulation; nothing but those is shuffled, whatever the number of rows.
    """
    n = returns.count()
    drawn = returns.withColumn("sim", F.explode(F.sequence(F.lit(-1), F.lit(simulations - 1))))  # -1 is the actual half
    inside = F.when(F.col("sim") < 0, F.col("step") < n // 2).otherwise(draw(F.col("step"), F.col("sim"), F.lit(seed)) % 2 == 0)
    each = drawn.where(inside).groupBy("sim").agg(F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("std"))
    ratio = each.select("sim", F.when(F.col("std") >= 1e-8, F.col("mean") / F.col("std") * periods**0.5).otherwise(0.0).alias("value"))
    found = ratio.agg(F.max(F.when(F.col("sim") < 0, F.col("value"))).alias("actual"), F.collect_list(F.when(F.col("sim") >= 0, F.col("value"))).alias("drawn"))
    return found.select("actual", (F.size(F.filter("drawn", lambda v: v >= F.col("actual"))) / F.size("drawn")).alias("p_value"))


def probabilistic_sharpe(sharpe: Column, n: Column, skew: Column, excess: Column, benchmark: float = 0.0) -> Column:
    """Chance that the true ratio is above a benchmark; one half where it is not defined."""
    spread = 1 - skew * sharpe + (excess + 2) / 4 * sharpe * sharpe
    z = (sharpe - benchmark) * F.sqrt(n - 1) / F.sqrt(spread)
    return F.when((n > 1) & (spread > 0), normal_cdf(z)).otherwise(0.5)


def deflated_benchmark(trials: int, spread: float) -> float:
    """Expected largest ratio of so many trials without skill."""
    gamma = 0.5772156649015329
    if trials < 2:
        return 0.0
    import math

    return spread * ((1 - gamma) * normal_ppf(1 - 1 / trials) + gamma * normal_ppf(1 - 1 / (trials * math.e)))


def cost_scenarios(spark: SparkSession, metrics: DataFrame, costs: dict[str, float]) -> DataFrame:
    """Net returns under each of a few constant costs a trade."""
    table = spark.createDataFrame(list(costs.items()), "scenario string, cost double")
    return metrics.crossJoin(F.broadcast(table)).withColumn("net", F.col("gross") - F.col("n_trades") * F.col("cost"))


def wasserstein(reference: DataFrame, current: DataFrame, x: str, points: int = 101) -> DataFrame:
    """(distance): mean difference of the quantiles of two columns."""
    at = [i / (points - 1) for i in range(points)]
    a, b = (quantiles(df, [x], at)[x] for df in (reference, current))
    known = None not in a + b
    return reference.sparkSession.createDataFrame([(sum(abs(p - q) for p, q in zip(a, b, strict=True)) / points if known else None,)], "distance double")


def position_scale(distance: Column, threshold: Column) -> Column:
    return F.when(distance > threshold, 0.25).otherwise(1.0)


def shaped_reward(pnl: Column, clean: Column) -> Column:
    """A gain counts more in clean states, a loss by the power 1.5."""
    return F.when(pnl > 0, pnl * F.when(clean, 1.5).otherwise(1.0)).otherwise(-F.pow(F.abs(pnl), F.lit(1.5)))
