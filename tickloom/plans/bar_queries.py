"""Queries over bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import bar_features as C
from tickloom.operators import bars as B
from tickloom.operators import labels, metrics, recurrences, simulate
from tickloom.plans.base import BAR_KEYS, BARS, BW, six_hourly, last, r, rounded, sql

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def keep(f):
        def naive(spark, d):
            df = f(spark, d)
            return df.withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz")) if "bar_start" in df.columns else df

        QUERIES[f.__name__] = naive
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return keep


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({BW})"


def mean(x: str, n: int) -> str:
    return f"avg({x}) OVER {last(n, BW)}"


def clip(x: str, lo: float, hi: float) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


TR = BARS + f", t AS (SELECT *, greatest(high - low, abs(high - coalesce({lag('close')}, close)), abs(low - coalesce({lag('close')}, close))) AS tr FROM bars)"
LR = BARS + f", l AS (SELECT *, ln(close / {lag('close')}) AS log_return FROM bars WHERE close > 0)"


def _with_returns(spark, d):
    return six_hourly(spark, d).where("close > 0").withColumn("log_return", C.log_return())


@query(sql(BARS, BAR_KEYS, {f"sma_{n}": f"(close - {mean('close', n)}) / ({mean('close', n)})" for n in (10, 20, 50, 100, 200)}, "bars"))
def sma_distance(spark, d):
    return rounded(six_hourly(spark, d), BAR_KEYS, {f"sma_{n}": C.sma_distance(n) for n in (10, 20, 50, 100, 200)})


@query(sql(BARS, BAR_KEYS, {f"roc_{n}": f"(close - coalesce({lag('close', n)}, close)) / coalesce({lag('close', n)}, close)" for n in (5, 10, 20, 50)}, "bars", digits=4))
def roc(spark, d):
    return rounded(six_hourly(spark, d), BAR_KEYS, {f"roc_{n}": C.roc(n) for n in (5, 10, 20, 50)}, 4)


@query(sql(TR, BAR_KEYS, {"tr": "tr", "atr_ratio": f"{mean('tr', 5)} / ({mean('tr', 20)} + 1e-12)"}, "t"))
def true_range(spark, d):
    return rounded(six_hourly(spark, d).withColumn("tr", C.true_range()), BAR_KEYS, {"tr": F.col("tr"), "atr_ratio": C.atr_ratio()})


@query(sql(BARS, BAR_KEYS, {f"width_{n}": f"stddev_samp(close) OVER {last(n, BW)} / ({mean('close', n)})" for n in (20, 50)}, "bars"))
def bollinger(spark, d):
    return rounded(six_hourly(spark, d), BAR_KEYS, {f"width_{n}": C.bollinger_width(n) for n in (20, 50)})


@query(sql(LR, BAR_KEYS, {f"var_{n}": f"var_samp(log_return) OVER {last(n, BW)}" for n in (10, 20)}, "l"))
def return_variance(spark, d):
    return rounded(_with_returns(spark, d), BAR_KEYS, {f"var_{n}": C.return_variance(n) for n in (10, 20)})


@query(sql(BARS, BAR_KEYS, {"surge": f"{mean('volume', 5)} / greatest({mean('volume', 20)}, 1e-10)", "volume_roc": f"(volume - coalesce({lag('volume', 5)}, volume)) / greatest(coalesce({lag('volume', 5)}, volume), 1e-10)",
  "liquidity": clip(f"{mean('volume', 12)} / greatest({mean('volume', 288)}, 1e-10)", 0, 10)}, "bars"))
def volume_surge(spark, d):
    return rounded(six_hourly(spark, d), BAR_KEYS, {"surge": C.volume_surge(), "volume_roc": C.volume_roc(), "liquidity": C.liquidity_surge()})


def _ema_sql(x: str, span: int, name: str, source: str) -> str:
    a = f"(2.0e0 / {span + 1})"
    return f"""n_{name} AS (SELECT symbol, bar_start, {x} AS x, row_number() OVER ({BW}) AS i FROM {source}),
    {name} AS (SELECT symbol, bar_start, i, x AS y FROM n_{name} WHERE i = 1 UNION ALL
      SELECT n.symbol, n.bar_start, n.i, {a} * n.x + (1 - {a}) * e.y FROM {name} e JOIN n_{name} n ON n.symbol = e.symbol AND n.i = e.i + 1)"""


def _emas(df, **spans):
    return recurrences.run(df, *(recurrences.Ema(x, span, name) for name, (x, span) in spans.items()), order=("bar_start",))


@query(f"WITH RECURSIVE {BARS}, {_ema_sql('close', 12, 'fast', 'bars')}, {_ema_sql('close', 26, 'slow', 'bars')} SELECT b.symbol, b.bar_start, round((f.y - s.y) / b.close, 6) + 0.0 AS macd FROM bars b JOIN fast f ON f.symbol = b.symbol AND f.bar_start = b.bar_start JOIN slow s ON s.symbol = b.symbol AND s.bar_start = b.bar_start")
def macd(spark, d):
    df = _emas(six_hourly(spark, d), fast=("close", 12), slow=("close", 26))
    return rounded(df, BAR_KEYS, {"macd": (F.col("fast") - F.col("slow")) / F.col("close")})


@query(f"WITH RECURSIVE {BARS}, {_ema_sql('volume * (close - open) / greatest(high - low, 1e-10)', 10, 'num', 'bars')}, {_ema_sql('volume', 10, 'den', 'bars')} SELECT n.symbol, n.bar_start, round(n.y / d.y, 6) + 0.0 AS ofi FROM num n JOIN den d ON n.symbol = d.symbol AND n.bar_start = d.bar_start")
def ofi(spark, d):
    df = _emas(six_hourly(spark, d).withColumn("flow", C.flow()), num=("flow", 10), den=("volume", 10))
    return rounded(df, BAR_KEYS, {"ofi": F.col("num") / F.col("den")})


@query(f"WITH RECURSIVE {BARS}, {_ema_sql('tib', 20, 'e', 'bars')} SELECT symbol, bar_start, round(y, 6) + 0.0 AS tib_ema FROM e")
def tib_ema(spark, d):
    return rounded(_emas(six_hourly(spark, d), tib_ema=("tib", 20)), BAR_KEYS, ["tib_ema"])


@query(sql(BARS, BAR_KEYS, {"z": f"CASE WHEN count(*) OVER {last(90, BW)} >= 5 THEN {clip(f'(volume - {mean('volume', 90)}) / greatest(stddev_samp(volume) OVER {last(90, BW)}, 1e-10)', -10, 10)} END"}, "bars"))
def rolling_z(spark, d):
    return rounded(six_hourly(spark, d), BAR_KEYS, {"z": C.rolling_z("volume")})


FLOW = "volume * (close - open) / greatest(high - low, 1e-10)"


@query(f"WITH RECURSIVE {BARS}, {_ema_sql(FLOW, 20, 'num', 'bars')}, {_ema_sql('volume', 20, 'den', 'bars')} SELECT n.symbol, n.bar_start, round(n.y / d.y, 6) + 0.0 AS ofi FROM num n JOIN den d ON n.symbol = d.symbol AND n.bar_start = d.bar_start")
def ofi_20(spark, d):
    df = _emas(six_hourly(spark, d).withColumn("flow", C.flow()), num=("flow", 20), den=("volume", 20))
    return rounded(df, BAR_KEYS, {"ofi": F.col("num") / F.col("den")})


@query(sql(BARS + f", f AS (SELECT *, CASE WHEN volume > 0 THEN {FLOW} ELSE sign(close - open) END AS flow FROM bars)", BAR_KEYS, {"ofi": f"flow / greatest(max(abs(flow)) OVER {last(60, BW)}, 1e-10)"}, "f"))
def ofi_normalised(spark, d):
    return rounded(six_hourly(spark, d).withColumn("flow", C.flow()), BAR_KEYS, {"ofi": C.ofi_normalised()})


@query(sql(BARS + f", c AS (SELECT *, sum(tib * volume) OVER ({BW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cvd FROM bars), v AS (SELECT *, cvd - {lag('cvd')} AS change FROM c)", BAR_KEYS,
  {"change": "change", "z": f"CASE WHEN count(cvd) OVER {last(90, BW)} >= 5 THEN {clip(f'(cvd - {mean('cvd', 90)}) / greatest(stddev_samp(cvd) OVER {last(90, BW)}, 1e-10)', -10, 10)} END"}, "v", digits=3))
def cvd_z(spark, d):
    df = six_hourly(spark, d).withColumn("cvd", C.cumulative_delta())
    return rounded(df, BAR_KEYS, {"change": C.slope("cvd", 1), "z": C.rolling_z("cvd")}, 3)


@query(sql(BARS + f", tf AS (SELECT *, {mean('close', 200)} AS sma, abs(close - {lag('close')}) > 20 AS jump FROM bars)", BAR_KEYS,
  {"slope": f"sma - {lag('sma', 5)}", "highest": f"max(close) OVER {last(20, BW)}", "lowest": f"min(close) OVER {last(20, BW)}", "middle": f"median(close) OVER {last(20, BW)}"}, "tf").replace(" FROM tf", f", coalesce(max(CAST(jump AS INTEGER)) OVER {last(4, BW)} = 1, false) AS jumped FROM tf"))
def trend_frames(spark, d):
    df = six_hourly(spark, d)
    df = df.withColumns({"sma": F.avg("close").over(B.last_bars(200)), "jump": F.abs(C.slope("close", 1)) > 20})
    found = df.withColumn("jumped", F.coalesce(C.recent("jump"), F.lit(False)))
    named = {"slope": C.slope("sma", 5), **C.extremes("close", 20)}
    return found.select(*BAR_KEYS, *(r(v).alias(k) for k, v in named.items()), "jumped")


@query(f"WITH RECURSIVE {TR}, {_ema_sql('tr', 14, 'e', 't')}, o AS (SELECT symbol, bar_start, y AS atr FROM e) SELECT symbol, bar_start, round(greatest(atr, median(atr) OVER {last(50, BW)}), 6) AS floored, round(coalesce({lag('atr')}, 0), 6) AS before FROM o")
def floored_atr(spark, d):
    df = _emas(six_hourly(spark, d).withColumn("tr", C.true_range()), atr=("tr", 14))
    return rounded(df, BAR_KEYS, {"floored": C.floored("atr"), "before": C.lagged("atr")})


@query(sql(LR, BAR_KEYS, {"fitted": f"coalesce(var_samp(log_return) OVER {last(50, BW)}, 0)", "applied": f"coalesce(var_samp(log_return) OVER {last(10, BW)}, 0)"}, "l"))
def hmm_features(spark, d):
    """Variances of the last 50 and 10 log returns; where there are too few returns the variance is 0."""
    df = _with_returns(spark, d)
    known = F.coalesce(C.return_variance(50), F.lit(0.0))
    return rounded(df, BAR_KEYS, {"fitted": known, "applied": F.coalesce(C.return_variance(10), F.lit(0.0))})


_WEIGHTS = C.fractional_weights(most=30)


@query(sql(BARS, BAR_KEYS, {"fracdiff": " + ".join(f"({w!r}::DOUBLE) * {lag('close', k) if k else 'close'}" for k, w in enumerate(_WEIGHTS))}, "bars"))
def fracdiff(spark, d):
    """The filter's first 30 weights only, as its SQL has a lag for each; ``fracdiff_full`` is the whole filter."""
    return rounded(six_hourly(spark, d), BAR_KEYS, {"fracdiff": C.fractional_difference("close", most=30)})


@query()
def fracdiff_full(spark, d):
    return rounded(six_hourly(spark, d), BAR_KEYS, {"fracdiff": C.fractional_difference("close")})


@query(sql(BARS + f", c AS (SELECT *, 100 * (close - coalesce({lag('close', 5)}, close)) / coalesce({lag('close', 5)}, close) AS roc5 FROM bars)", BAR_KEYS,
  {"micro": f"CASE WHEN count(roc5) OVER {last(60, BW)} >= 5 THEN {clip(f'roc5 / greatest(max(abs(roc5)) OVER {last(60, BW)}, 1e-8)', -1, 1)} END"}, "c"))
def micro_momentum(spark, d):
    return rounded(six_hourly(spark, d).withColumn("roc5", 100 * C.roc(5)), BAR_KEYS, {"micro": C.micro_momentum()})


@query(sql(LR, BAR_KEYS, {"cluster": clip(f"ln(greatest(var_samp(log_return) OVER {last(10, BW)}, 1e-12) / greatest(var_samp(log_return) OVER {last(100, BW)}, 1e-12))", -5, 5)}, "l") + f" QUALIFY row_number() OVER ({BW}) > 12")
def vol_cluster(spark, d):
    df = _with_returns(spark, d).withColumns({"cluster": C.volatility_clustering(), "row": F.row_number().over(B.by_bar())})
    return rounded(df.where("row > 12"), BAR_KEYS, ["cluster"])


@query(f"""WITH {LR}, m AS (SELECT symbol, bar_start, row_number() OVER ({BW}) AS row, list(log_return) OVER {last(20, BW)} AS v FROM l),
  c AS (SELECT symbol, bar_start, [x FOR x IN v IF x IS NOT NULL] AS v FROM m WHERE row > 3), a AS (SELECT *, list_avg(v) AS m FROM c)
  SELECT symbol, bar_start, round({clip("list_avg([(x - m) * (x - m) * (x - m) FOR x IN v]) / pow(list_avg([(x - m) * (x - m) FOR x IN v]), 1.5)", -3, 3)}, 6) + 0.0 AS skew FROM a""")  # fmt: skip
def skew20(spark, d):
    df = _with_returns(spark, d).withColumns({"skew": C.realised_skew(), "row": F.row_number().over(B.by_bar())})
    return rounded(df.where("row > 3"), BAR_KEYS, ["skew"])


@query(sql(BARS + f", t AS (SELECT *, (close - {mean('close', 200)}) / ({mean('close', 200)}) AS trend FROM bars)", BAR_KEYS, {"macro": clip(f"trend / greatest(stddev_samp(trend) OVER {last(60, BW)}, 1e-10)", -5, 5)}, "t") + f" QUALIFY row_number() OVER ({BW}) > 2")
def macro(spark, d):
    df = six_hourly(spark, d).withColumn("trend", C.sma_distance(200)).withColumns({"macro": C.macro_alignment(), "row": F.row_number().over(B.by_bar())})
    return rounded(df.where("row > 2"), BAR_KEYS, ["macro"])


@query(sql(BARS, BAR_KEYS, {"cvd": f"sum(tib * volume) OVER ({BW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}, "bars", digits=3))
def cvd(spark, d):
    return rounded(six_hourly(spark, d), BAR_KEYS, {"cvd": C.cumulative_delta()}, 3)


@query(sql(BARS, BAR_KEYS, {"bounded": f"least(greatest(close, quantile_cont(close, 0.01) OVER ({BW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), quantile_cont(close, 0.99) OVER ({BW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"}, "bars"))
def winsorise(spark, d):
    df = recurrences.run(six_hourly(spark, d), recurrences.ExpandingBounds("close"), order=("bar_start",))
    return rounded(df, BAR_KEYS, {"bounded": F.least(F.greatest("close", "low_bound"), "high_bound")})


ATR = TR + f", a AS (SELECT *, {mean('tr', 14)} AS atr FROM t)"


def _with_atr(spark, d):
    return six_hourly(spark, d).withColumn("tr", C.true_range()).withColumn("atr", F.avg("tr").over(B.last_bars(14)))


@query(f"""WITH {ATR}, n AS (SELECT *, row_number() OVER ({BW}) AS i FROM a),
  h AS (SELECT x.symbol, x.bar_start, min(y.i) AS i FROM n x JOIN n y ON x.symbol = y.symbol AND y.i > x.i AND y.i <= x.i + 24 AND (y.high >= x.close + 2 * x.atr OR y.low <= x.close - x.atr) GROUP BY 1, 2)
  SELECT x.symbol, x.bar_start, CAST(coalesce(y.high >= x.close + 2 * x.atr, false) AS INTEGER) AS target FROM n x LEFT JOIN h USING (symbol, bar_start) LEFT JOIN n y ON y.symbol = x.symbol AND y.i = h.i""")  # fmt: skip
def triple_barrier_bar(spark, d):
    return labels.bar_barrier(_with_atr(spark, d), "atr").select(*BAR_KEYS, "target")


@query(f"""WITH {ATR}, n AS (SELECT *, row_number() OVER ({BW}) AS i, CAST(sign(tib) AS INTEGER) AS direction FROM a), s AS (SELECT symbol, max(i) AS n FROM n GROUP BY 1),
  h AS (SELECT x.symbol, x.i, min(y.i) AS j FROM n x JOIN n y ON x.symbol = y.symbol AND y.i > x.i AND y.i <= x.i + 24
    AND CASE WHEN x.direction = 1 THEN y.low <= x.close - x.atr OR y.high >= x.close + 2 * x.atr ELSE y.high >= x.close + x.atr OR y.low <= x.close - 2 * x.atr END GROUP BY 1, 2),
  o AS (SELECT x.*, h.j, CASE WHEN x.direction = 1 THEN y.low <= x.close - x.atr ELSE y.high >= x.close + x.atr END AS stopped, z.close AS fin
    FROM n x JOIN s ON s.symbol = x.symbol LEFT JOIN h ON h.symbol = x.symbol AND h.i = x.i LEFT JOIN n y ON y.symbol = x.symbol AND y.i = h.j JOIN n z ON z.symbol = x.symbol AND z.i = least(x.i + 24, s.n) WHERE x.direction <> 0 AND x.i < s.n)
  SELECT symbol, bar_start, direction, CASE WHEN j IS NULL THEN 'TIME' WHEN stopped THEN 'STOP' ELSE 'TAKE' END AS exit_type,
    round(direction * (CASE WHEN j IS NULL THEN fin WHEN stopped THEN close - direction * atr ELSE close + direction * 2 * atr END - close) / close, 6) + 0.0 AS ret FROM o""")  # fmt: skip
def bar_backtest(spark, d):
    df = _with_atr(spark, d).withColumn("direction", F.signum("tib").cast("int"))
    return simulate.bar_backtest(df).select(*BAR_KEYS, "direction", "exit_type", r("ret").alias("ret"))


_DAY = BARS + ", day AS (SELECT symbol, CAST(bar_start AS DATE) AS day, arg_max(close, bar_start) AS close FROM bars GROUP BY 1, 2), dr AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM day)"


@query(f"""WITH {_DAY}, s AS (SELECT *, stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS std FROM dr),
  i AS (SELECT *, 1 / nullif(lag(std) OVER (PARTITION BY symbol ORDER BY day), 0) AS inv FROM s) SELECT symbol, CAST(day AS VARCHAR) AS day, round(inv / sum(inv) OVER (PARTITION BY day), 6) + 0.0 AS weight FROM i""")  # fmt: skip
def inverse_vol_portfolio(spark, d):
    bars = six_hourly(spark, d).groupBy("symbol", F.to_date("bar_start").alias("day")).agg(F.max_by("close", "bar_start").alias("close"))
    bars = bars.withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("day")) - 1)
    return metrics.inverse_volatility(bars, "symbol", "day", "ret", 10).select("symbol", F.col("day").cast("string").alias("day"), r("weight").alias("weight"))


@query(f"""WITH {_DAY}, s AS (SELECT *, stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS std FROM dr),
  i AS (SELECT *, 1 / nullif(lag(std) OVER (PARTITION BY symbol ORDER BY day), 0) AS inv FROM s), w AS (SELECT *, coalesce(inv / sum(inv) OVER (PARTITION BY day), 1.0e0 / (SELECT count(DISTINCT symbol) FROM dr)) AS weight FROM i),
  p AS (SELECT day, sum(0.001 * coalesce(ret, 0) * weight) AS ret FROM w GROUP BY 1), l AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY day)) AS level FROM p), f AS (SELECT *, level / max(level) OVER (ORDER BY day) - 1 AS fall FROM l),
  e AS (SELECT count(*) AS n, avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)) AS sharpe, arg_max(level, day) AS level, min(fall) AS fall FROM f)
  SELECT n, round(sharpe, 6) AS sharpe, round(100 * (pow(level, 252.0e0 / n) - 1), 4) AS cagr_pct, round(100 * fall, 6) AS max_drawdown_pct, round(100 * (level - 1), 6) AS total_pct FROM e""")  # fmt: skip
def portfolio_ratios(spark, d):
    """Sharpe ratio, growth and fall of the portfolio of inverse volatility, at a thousandth of the stake."""
    bars = six_hourly(spark, d).groupBy("symbol", F.to_date("bar_start").alias("day")).agg(F.max_by("close", "bar_start").alias("close"))
    bars = bars.withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("day")) - 1)
    weights = metrics.inverse_volatility(bars, "symbol", "day", "ret", 10)
    found = metrics.portfolio_ratios(bars.withColumn("ret", 0.001 * F.col("ret")), weights, "symbol", "day", "ret")
    return found.select("n", *(r(c, 4 if c == "cagr_pct" else 6).alias(c) for c in ("sharpe", "cagr_pct", "max_drawdown_pct", "total_pct")))
