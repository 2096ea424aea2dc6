"""Queries over returns, trades, labels, splits and simulations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import scalar as X
from tickloom.operators import clean, joins, labels, metrics, montecarlo, recurrences, risk, simulate, splits
from tickloom.operators.bars import by_bar
from tickloom.plans.base import BAR_KEYS, BW, KEYS, PATH, TICKS, W, last, path, r, returns, rounded, ticks
from tickloom.sources import ticks as S

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


def path_bars(spark, d):
    """Six-hour bars of the price path, with the return on the bar before and the bar's number from 0."""
    at = F.struct("timestamp_ns", "seq")
    bars = path(spark, d).groupBy("symbol", F.window("ts", "6 hours").alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close")
    )
    bars = bars.select("symbol", F.col("w.start").alias("bar_start"), "open", "high", "low", "close")
    ret = F.col("close") / F.lag("close").over(by_bar()) - 1
    return bars.withColumns({"ret": ret, "i": F.row_number().over(by_bar()) - 1})


PB = PATH + f""",
pb AS (SELECT symbol, make_timestamp((CAST(epoch_us(ts) AS BIGINT) // 21600000000) * 21600000000) AS bar_start, arg_min(price, (timestamp_ns, seq)) AS open,
  max(price) AS high, min(price) AS low, arg_max(price, (timestamp_ns, seq)) AS close FROM path GROUP BY 1, 2),
rt AS (SELECT *, close / lag(close) OVER ({BW}) - 1 AS ret, row_number() OVER ({BW}) - 1 AS i FROM pb)"""
BSO = f"({BW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def trades(spark, d):
    """A trade for each bar of the path: its entry, its number, and what the return gains on a fixed stake."""
    return path_bars(spark, d).where("ret is not null").select("symbol", F.col("bar_start").alias("entry"), "i", (5000 * F.col("ret")).alias("pnl"), "ret")


TR = PB + ", tr AS (SELECT symbol, bar_start AS entry, i, 5000 * ret AS pnl, ret FROM rt WHERE ret IS NOT NULL)"


def _o(**columns: str) -> str:
    """Rounded columns of a query by name."""
    return ", ".join(f"round({v}, 6) + 0.0 AS {k}" for k, v in columns.items())


SHARPE = "CASE WHEN count(ret) > 1 AND stddev_samp(ret) >= 1e-8 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END"
DOWN = "CASE WHEN count(*) FILTER (ret < 0) > 1 THEN stddev_samp(ret) FILTER (WHERE ret < 0) ELSE 0 END"


@query(f"WITH {TR} SELECT symbol, {_o(sharpe=SHARPE, downside=DOWN, sortino=f'avg(ret) / ({DOWN})', var='-quantile_cont(ret, 0.05)', tail_ratio='quantile_cont(ret, 0.95) / (abs(quantile_cont(ret, 0.05)) + 1e-8)', profit_factor='sum(ret) FILTER (ret > 0) / -sum(ret) FILTER (ret < 0)')} FROM tr GROUP BY symbol")
def risk_metrics(spark, d):
    x = F.col("ret")
    found = {"sharpe": metrics.sharpe(x), "downside": metrics.downside(x), "sortino": metrics.sortino(x), "var": metrics.value_at_risk(x), "tail_ratio": metrics.tail_ratio(x), "profit_factor": metrics.profit_factor(x)}
    return trades(spark, d).groupBy("symbol").agg(*(r(v).alias(k) for k, v in found.items()))


@query(f"WITH {TR}, v AS (SELECT symbol, -quantile_cont(ret, 0.05) AS var FROM tr GROUP BY 1) SELECT symbol, {_o(var='any_value(var)', cvar='coalesce(-avg(ret) FILTER (ret <= -var), any_value(var))')} FROM tr JOIN v USING (symbol) GROUP BY symbol")
def expected_shortfall(spark, d):
    return rounded(metrics.expected_shortfall(trades(spark, d), "symbol", "ret"), ("symbol",), ["var", "cvar"])


@query(f"WITH {TR}, c AS (SELECT *, ret - avg(ret) OVER (PARTITION BY symbol) AS x FROM tr) SELECT symbol, {_o(skew='sqrt(count(*)) * sum(x * x * x) / pow(sum(x * x), 1.5)', excess_kurtosis='count(*) * sum(x * x * x * x) / (sum(x * x) * sum(x * x)) - 3')} FROM c GROUP BY symbol")
def moments(spark, d):
    return trades(spark, d).groupBy("symbol").agg(*(r(v).alias(k) for k, v in metrics.moments(F.col("ret")).items()))


@query(f"WITH {TR}, e AS (SELECT *, 100000 * exp(sum(ln(1 + 0.05 * ret)) OVER (PARTITION BY symbol ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS equity FROM tr), p AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM e) SELECT symbol, i, {_o(equity='equity', peak='peak', drawdown='equity / peak - 1')} FROM p")
def equity_curve(spark, d):
    found = metrics.equity_curve(trades(spark, d), "symbol", ["entry"], "ret")
    return found.select("symbol", F.col("i").cast("long").alias("i"), *(r(c).alias(c) for c in ("equity", "peak", "drawdown")))


EQ = TR + """, eq AS (SELECT *, 5000 + sum(pnl) OVER (PARTITION BY symbol ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM tr),
dd AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - equity AS drawdown FROM eq)"""


def _equity(spark, d):
    w = Window.partitionBy("symbol").orderBy("entry").rowsBetween(Window.unboundedPreceding, 0)
    return metrics.drawdowns(trades(spark, d).withColumn("equity", 5000 + F.sum("pnl").over(w)), "symbol", ["entry"], "equity")


DAYS = "count(*) / 4.0"


@query(f"""WITH {EQ}, m AS (SELECT symbol, max(drawdown) AS max_dd, {DAYS} AS days, arg_min(equity, entry) AS a, arg_max(equity, entry) AS b, stddev_pop(ret) AS sd, avg(ret) AS m, count(*) AS n FROM dd GROUP BY 1)
  SELECT symbol, {_o(max_dd_usd='max_dd', sharpe='CASE WHEN sd >= 1e-8 THEN m / sd * sqrt(greatest(n / (days / 252), 1)) ELSE 0 END', calmar='(pow(greatest(b, 1) / a, 252 / days) - 1) / (max_dd / 5000)', library_calmar='252 * m / (max_dd / 5000)')} FROM m""")  # fmt: skip
def backtest_metrics(spark, d):
    days, at = F.count("*") / 4.0, "entry"
    found = _equity(spark, d).groupBy("symbol").agg(
        F.max("drawdown").alias("max_dd_usd"), metrics.trade_sharpe(F.col("ret"), days).alias("sharpe"), F.avg("ret").alias("m"),
        metrics.annual_calmar(F.min_by("equity", at), F.greatest(F.max_by("equity", at), F.lit(1.0)), days, F.max("drawdown"), 5000.0).alias("calmar"),
    )
    return rounded(found.withColumn("library_calmar", metrics.calmar(F.col("m"), F.col("max_dd_usd") / 5000)), ("symbol",), ["max_dd_usd", "sharpe", "calmar", "library_calmar"])


WIN, LOSS = "coalesce(avg(pnl) FILTER (pnl > 0), 0)", "coalesce(-avg(pnl) FILTER (pnl <= 0), 0)"
RATE = "(count(*) FILTER (pnl > 0))::DOUBLE / count(*)"


@query(f"""WITH {EQ}, s AS (SELECT symbol, count(*) AS n, {RATE} AS rate, {WIN} AS win, {LOSS} AS loss, max(drawdown) AS dd FROM dd GROUP BY 1)
  SELECT symbol, n AS n_trades, {_o(win_rate='rate', avg_win='win', avg_loss='loss', expectancy='rate * win - (1 - rate) * loss', kelly='CASE WHEN win > 0 AND loss > 0 THEN rate - (1 - rate) / (win / loss) ELSE 0 END')},
  dd <= 2000 AS pass_drawdown, rate >= 0.48 AS pass_win_rate, dd <= 2000 AND rate >= 0.48 AS pass_all FROM s""")  # fmt: skip
def trade_statistics(spark, d):
    stats = _equity(spark, d).groupBy("symbol").agg(*(v.alias(k) for k, v in metrics.trade_statistics(F.col("pnl")).items()), F.max("drawdown").alias("dd"))
    gates = metrics.passes(F.col("dd"), F.lit(5.0), F.col("win_rate"), limit=2000.0)
    return stats.select("symbol", "n_trades", *(r(c).alias(c) for c in ("win_rate", "avg_win", "avg_loss", "expectancy", "kelly")), *(gates[g].alias(g) for g in ("pass_drawdown", "pass_win_rate", "pass_all")))


@query(f"""WITH {TR}, s AS (SELECT symbol, CAST(entry AS DATE) AS day, sum(ret) AS total FROM tr WHERE i % 9 < 3 GROUP BY 1, 2),
  g AS (SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM s GROUP BY symbol)
  SELECT g.symbol, CAST(g.day AS VARCHAR) AS day, {_o(total='coalesce(total, 0)')} FROM g LEFT JOIN s ON g.symbol = s.symbol AND g.day = s.day""")  # fmt: skip
def daily_returns(spark, d):
    found = metrics.daily_sums(trades(spark, d).where("i % 9 < 3"), "symbol", "entry", "ret")
    return found.select("symbol", F.col("day").cast("string").alias("day"), r("total").alias("total"))


PERIODS = [("early", "2024-01-01", "2024-01-10"), ("middle", "2024-01-08", "2024-01-20"), ("late", "2024-01-20", "2024-12-31"), ("all", "1970-01-01", "2100-01-01")]
_PERIODS = ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, a, b in PERIODS)


@query(f"WITH {TR}, p(name, b, f) AS (VALUES {_PERIODS}) SELECT name, count(*) AS n, {_o(total='sum(pnl)', profit_factor='sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0)')} FROM tr JOIN p ON entry >= b AND entry <= f GROUP BY name")
def period_metrics(spark, d):
    table = spark.createDataFrame(PERIODS, "name string, begin string, finish string").select("name", F.to_timestamp("begin").alias("begin"), F.to_timestamp("finish").alias("finish"))
    return metrics.by_period(trades(spark, d), table, "entry", "pnl").select("name", "n", r("total").alias("total"), r("profit_factor").alias("profit_factor"))


@query(f"""WITH {PB}, m AS (SELECT *, close - max(close) OVER {BSO} AS fall FROM rt), a AS (SELECT symbol, count(*) AS n, arg_max(close, bar_start) / arg_min(close, bar_start) - 1 AS total, min(fall) / max(close) AS dd, avg(ret) / (stddev_pop(ret) + 1e-10) * sqrt(252) AS sharpe FROM m GROUP BY 1)
  SELECT symbol, {_o(total_return='total', cagr='pow(1 + total, 1 / greatest(n / 252.0, 0.1)) - 1', max_drawdown='dd', sharpe='sharpe')} FROM a""")  # fmt: skip
def buy_and_hold(spark, d):
    found = metrics.buy_and_hold(path_bars(spark, d), "symbol", ["bar_start"], "close")
    return rounded(found, ("symbol",), ["total_return", "cagr", "max_drawdown", "sharpe"])


def _cdf(z: str) -> str:
    """The normal distribution function of a value that is not negative, by the formula of ``scalar.normal_cdf``."""
    t = f"(1 / (1 + 0.2316419e0 * {z}))"
    return f"(1 - exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {t} * (0.319381530e0 + {t} * (-0.356563782e0 + {t} * (1.781477937e0 + {t} * (-1.821255978e0 + {t} * 1.330274429e0)))))"


@query(f"""WITH {PATH}, f AS (SELECT symbol, k, round(mid, 6) AS x, round(ln(lead(price, k) OVER (PARTITION BY symbol, k ORDER BY timestamp_ns, seq) / price), 9) AS y FROM path, (VALUES (1), (3), (5)) t(k)),
  g AS (SELECT *, rank() OVER (PARTITION BY symbol, k ORDER BY x) + (count(*) OVER (PARTITION BY symbol, k, x) - 1) / 2.0e0 AS rx, rank() OVER (PARTITION BY symbol, k ORDER BY y) + (count(*) OVER (PARTITION BY symbol, k, y) - 1) / 2.0e0 AS ry FROM f WHERE y IS NOT NULL),
  c AS (SELECT symbol, k, count(*) AS n, corr(rx, ry) AS ic FROM g GROUP BY 1, 2), z AS (SELECT *, abs(ic) * sqrt((n - 2) / greatest(1 - ic * ic, 1e-12)) AS z FROM c)
  SELECT symbol, CAST(k AS INTEGER) AS k, n, round(CASE WHEN n > 100 THEN ic ELSE 0 END, 6) + 0.0 AS ic, round(CASE WHEN n > 100 THEN 2 * (1 - {_cdf('z')}) ELSE 1 END, 5) + 0.0 AS p FROM z""")  # fmt: skip
def rank_ic(spark, d):
    """Rank correlation of the mid price with the log return of the next 1, 3 and 5 rows."""
    walk = S.events_as_walk(spark, d).select(*KEYS, "mid", "price", "__row")
    ahead = splits.windowed(walk, {f"ahead_{k}": lambda w, k=k: F.lead("price", k).over(w) for k in (1, 3, 5)}, 1, 20_000, 5)
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.round(F.ln(F.col(f"ahead_{k}") / F.col("price")), 9).alias("y")) for k in (1, 3, 5))))
    rows = ahead.select("symbol", F.round("mid", 6).alias("mid"), pairs.alias("pair")).select("symbol", "mid", "pair.*")  # equal prices tie, whatever their last digit
    found = metrics.rank_correlation(rows, ["symbol", "k"], "mid", "y")
    return found.select("symbol", "k", "n", r("ic").alias("ic"), r("p", 5).alias("p"))


FOLD = TR + """, fo AS (SELECT *, i // 20 AS fold, 5000 + sum(pnl) OVER (PARTITION BY symbol, i // 20 ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM tr),
ff AS (SELECT *, greatest(max(equity) OVER (PARTITION BY symbol, fold ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 5000) - equity AS fall FROM fo),
fm AS (SELECT symbol, fold, count(*) AS n_trades, (count(*) FILTER (pnl > 0))::DOUBLE / count(*) AS win_rate, max(fall) AS max_drawdown FROM ff GROUP BY 1, 2),
fp AS (SELECT *, max_drawdown <= 500 AND win_rate >= 0.48 AS pass_all FROM fm)"""


def _folds(spark, d):
    named = trades(spark, d).withColumn("unit", F.concat_ws(":", "symbol", F.floor(F.col("i") / 20)))
    return metrics.fold_metrics(named, "unit", limit=500.0)


@query(f"WITH {FOLD} SELECT symbol || ':' || fold AS unit, n_trades, {_o(win_rate='win_rate', max_drawdown='max_drawdown')}, pass_all FROM fp")
def fold_metrics(spark, d):
    return _folds(spark, d).select("unit", "n_trades", r("win_rate").alias("win_rate"), r("max_drawdown").alias("max_drawdown"), "pass_all")


@query(f"WITH {FOLD} SELECT count(*) AS n_folds, CAST(sum(n_trades) AS BIGINT) AS n_trades, {_o(pct_folds_pass='avg(CAST(pass_all AS INTEGER))')} FROM fp")
def fold_aggregate(spark, d):
    return metrics.over_folds(_folds(spark, d)).select("n_folds", "n_trades", r("pct_folds_pass").alias("pct_folds_pass"))


@query(f"""WITH {EQ}, m AS (SELECT *, equity - lag(equity) OVER w AS step, lag(equity) OVER w AS was, max(equity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM (SELECT *, equity + 20000 AS e FROM (SELECT * REPLACE (equity + 20000 AS equity) FROM eq)) WINDOW w AS (PARTITION BY symbol ORDER BY entry)),
  q AS (SELECT *, step / (was + 1e-10) AS g, (equity - peak) / (peak + 1e-10) AS fall FROM m),
  a AS (SELECT symbol, (arg_max(equity, entry) / 25000 - 1) * 100 AS total, (pow(arg_max(equity, entry) / arg_min(equity, entry), 1 / greatest(count(*) / 252.0, 0.1)) - 1) * 100 AS cagr, min(fall) * 100 AS dd,
    avg(g) / (stddev_pop(g) + 1e-10) * sqrt(252) AS sharpe, avg(g) / (stddev_pop(g) FILTER (g < 0) + 1e-10) * sqrt(252) AS sortino FROM q GROUP BY 1)
  SELECT symbol, {_o(total_ret_pct='total', cagr_pct='cagr', max_drawdown_pct='dd', sharpe_ratio='sharpe', sortino_ratio='coalesce(sortino, 0)', calmar_ratio='CASE WHEN dd < 0 THEN cagr / abs(dd) ELSE 999 END')} FROM a""")  # fmt: skip
def bar_metrics(spark, d):
    raised = _equity(spark, d).withColumn("equity", F.col("equity") + 20_000)
    found = metrics.bar_metrics(raised, "symbol", ["entry"], initial=25_000.0)
    return rounded(found, ("symbol",), ["total_ret_pct", "cagr_pct", "max_drawdown_pct", "sharpe_ratio", "sortino_ratio", "calmar_ratio"])


@query(f"""WITH {EQ}, a AS (SELECT symbol, count(*) AS n, 100.0 * count(*) FILTER (pnl > 0) / count(*) AS rate, sum(ret) AS ret FROM tr GROUP BY 1), b AS (SELECT *, round(rate, 1) AS rr FROM a)
  SELECT CAST(sum(n) AS BIGINT) AS n_trades, CAST(sum(floor(n * rr / 100)) AS BIGINT) AS n_wins, {_o(win_rate_pct='100.0 * sum(floor(n * rr / 100)) / sum(n)', ret='avg(ret)')} FROM b""")  # fmt: skip
def portfolio(spark, d):
    assets = trades(spark, d).groupBy("symbol").agg(F.count("*").alias("n_trades"), F.round(100.0 * F.count_if(F.col("pnl") > 0) / F.count("*"), 1).alias("win_rate_pct"), F.sum("ret").alias("ret"))
    return metrics.portfolio(assets).select("n_trades", F.col("n_wins").cast("long").alias("n_wins"), r("win_rate_pct").alias("win_rate_pct"), r("ret").alias("ret"))


@query(f"WITH {TICKS} SELECT symbol, {_o(stability='(stddev_samp(mid) + stddev_samp(spread) + stddev_samp(volume)) / 3')} FROM ticks GROUP BY symbol")
def stability_index(spark, d):
    return ticks(spark, d).groupBy("symbol").agg(r(metrics.stability_index("mid", "spread", "volume")).alias("stability"))


@query(f"WITH {TICKS} SELECT symbol, count(*) AS n, {_o(mean='avg(mid)', variance='var_samp(mid)')} FROM ticks GROUP BY symbol")
def stored_moments(spark, d):
    """Moments of days, stored as states, merged by symbol."""
    states = ticks(spark, d).groupBy("symbol", F.to_date("ts")).agg(F.count("*").alias("n"), F.avg("mid").alias("mean"), (F.var_pop("mid") * F.count("*")).alias("m2"))
    return metrics.merge_moments(states, "symbol").select("symbol", "n", r("mean").alias("mean"), r(F.col("m2") / (F.col("n") - 1)).alias("variance"))


@query(f"""WITH {TR}, s AS (SELECT symbol, i % 4 AS shape, round(0.9 + 0.1 * abs(sin(i * 7 + length(symbol))), 6) AS psr, i FROM tr), g AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY psr DESC, symbol, shape, i) AS k, row_number() OVER (ORDER BY psr DESC, symbol, shape, i) AS place FROM s WHERE psr > 0.95)
  SELECT symbol, shape, i, psr FROM g WHERE k = 1 OR place <= 3 ORDER BY psr DESC, symbol, shape, i LIMIT 5""")  # fmt: skip
def leaderboard(spark, d):
    i = F.col("i")
    rows = trades(spark, d).select("symbol", (i % 4).cast("long").alias("shape"), F.round(0.9 + 0.1 * F.abs(F.sin(i * 7 + F.length("symbol"))), 6).alias("psr"), i.cast("long").alias("i"))
    return metrics.leaderboard(rows.select("symbol", "shape", "i", "psr"), "psr", ["shape"], n=5)


@query(f"WITH {TR} SELECT symbol, {_o(score='5.0 * least(rate / 0.45, 1) * least(1000 / dd, 1) * CASE WHEN n < 200 THEN 0.1 ELSE 1 END')} FROM (SELECT symbol, count(*) AS n, {RATE} - 0.2 AS rate, sum(abs(pnl)) AS dd FROM tr GROUP BY 1)")
def tuning_score(spark, d):
    s = trades(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), (F.count_if(F.col("pnl") > 0) / F.count("*") - 0.2).alias("rate"), F.sum(F.abs("pnl")).alias("dd"))
    return s.select("symbol", r(metrics.tuning_score(F.lit(5.0), F.col("rate"), F.col("dd"), F.col("n"))).alias("score"))


# labels

VAR = PATH + f", lr AS (SELECT *, CASE WHEN lag(price) OVER ({W}) IS NOT NULL THEN ln(price / greatest(lag(price) OVER ({W}), 1e-12)) END AS log_return, row_number() OVER ({W}) AS k FROM path), vr AS (SELECT *, coalesce(var_pop(log_return) OVER {last(50)}, 0) + 1e-10 AS v FROM lr)"


def _with_variance(spark, d):
    """The path with its log returns and their variance over the last 50 rows, chunk by chunk."""
    variance = lambda w: F.coalesce(F.var_pop("log_return").over(w.rowsBetween(-49, 0)), F.lit(0.0)) + 1e-10
    return splits.windowed(returns(spark, d), {"v": variance}, 50, 20_000).withColumnRenamed("row", "__row")


@query(f"""WITH {VAR}, h AS (SELECT a.symbol, a.k, min(b.k) AS j FROM vr a JOIN vr b ON a.symbol = b.symbol AND b.k > a.k AND b.k < a.k + 60 AND (b.price >= a.price * (1 + 2 * sqrt(a.v)) OR b.price <= a.price * (1 - 2 * sqrt(a.v))) GROUP BY 1, 2)
  SELECT a.symbol, a.seq, CAST(CASE WHEN b.price >= a.price * (1 + 2 * sqrt(a.v)) THEN 1 WHEN b.price IS NOT NULL THEN -1 ELSE 0 END AS INTEGER) AS label FROM vr a LEFT JOIN h ON a.symbol = h.symbol AND a.k = h.k LEFT JOIN vr b ON b.symbol = h.symbol AND b.k = h.j""")  # fmt: skip
def triple_barrier(spark, d):
    return labels.triple_barrier(_with_variance(spark, d).select(*KEYS, "price", "v", "__row"), "price", "v", horizon=60).select(*KEYS, "label")


@query(f"""WITH {VAR}, rv AS (SELECT *, coalesce(var_samp(log_return) OVER {last(20)}, 0) AS rv, mid - lag(mid) OVER ({W}) AS velocity FROM vr)
  SELECT symbol, seq, CAST(CASE WHEN abs(spread * 10) > 0.45 THEN 3 WHEN rv < 1e-6 THEN 2 WHEN velocity > 0 THEN 0 ELSE 1 END AS INTEGER) AS regime FROM rv""")  # fmt: skip
def rule_regimes(spark, d):
    df = _with_variance(spark, d).withColumn("velocity", F.col("mid") - F.lag("mid").over(Window.partitionBy("symbol").orderBy("timestamp_ns", "seq")))
    return labels.rule_regimes(df.withColumn("hf", F.col("spread") * 10 - 0.15), "hf", "log_return", "velocity").select(*KEYS, "regime")


_PATHS = f"""WITH {VAR}, p AS (SELECT symbol, seq, list(log_return) OVER ({W} ROWS BETWEEN 10 FOLLOWING AND 109 FOLLOWING) AS w FROM vr),
  u AS (SELECT symbol, seq, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM p WHERE len(w) = 100),
  c AS (SELECT symbol, seq, j, exp(sum(x) OVER (PARTITION BY symbol, seq ORDER BY j)) AS level FROM u),
  m AS (SELECT symbol, seq, level, greatest(1, max(level) OVER (PARTITION BY symbol, seq ORDER BY j)) AS peak FROM c)
  SELECT symbol, seq, CAST(max((peak - level) / peak) * 5000 > 700 AS INTEGER) AS risky FROM m GROUP BY 1, 2"""


@query(_PATHS)
def risk_window(spark, d):
    return labels.risk_window(returns(spark, d).select(*KEYS, "log_return", "__row"), "log_return", limit=700.0).select(*KEYS, "risky")


_TOXIC = f"""WITH {PATH}, n AS (SELECT *, row_number() OVER ({W}) - 1 AS row FROM path),
  w AS (SELECT *, list(price) OVER ({W} ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) AS w FROM n QUALIFY row % 50 = 0),
  t AS (SELECT symbol, seq, timestamp_ns, price, w, [ln(w[i + 1]) - ln(w[i]) FOR i IN range(1, 100)] AS r FROM w WHERE len(w) = 100),
  a AS (SELECT *, [x FOR x IN r IF x < 0] AS neg, list_sort(r) AS s FROM t),
  u AS (SELECT symbol, seq, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM t), pk AS (SELECT symbol, seq, x, max(x) OVER (PARTITION BY symbol, seq ORDER BY j) AS peak FROM u),
  f AS (SELECT symbol, seq, max((peak - x) / (peak + 1e-8)) * 5000 AS dd FROM pk GROUP BY 1, 2),
  b AS (SELECT a.symbol, a.seq, timestamp_ns, price, w, list_sum(r) / 99 / (CASE WHEN len(neg) > 1 THEN list_stddev_samp(neg) ELSE 0 END + 1e-8) AS sortino, dd, abs(s[5]) * 5000 AS v, list_avg(w) AS m, list_stddev_pop(w) AS sd FROM a JOIN f ON a.symbol = f.symbol AND a.seq = f.seq),
  c AS (SELECT *, avg(v) OVER (PARTITION BY symbol ORDER BY timestamp_ns, seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS usual FROM b),
  l AS (SELECT *, CASE WHEN sortino < -0.5 OR dd > 900 OR v > 1.5 * greatest(usual, 1e-8) THEN 1 WHEN sortino > 0 AND abs(price - m) <= 3 * greatest(sd, 1e-8) THEN 0 ELSE -1 END AS label FROM c)
  SELECT symbol, timestamp_ns, CAST(label AS INTEGER) AS label, round(price, 6) AS price FROM l WHERE label <> -1"""


@query(_TOXIC.replace("list_stddev_samp(neg)", "list_aggregate(neg, 'stddev_samp')").replace("list_stddev_pop(w)", "list_aggregate(w, 'stddev_pop')"))
def toxicity(spark, d):
    return labels.toxicity(path(spark, d), limit=900.0).select("symbol", "timestamp_ns", "label", r("price").alias("price"))


@query(f"""WITH {PB}, t AS (SELECT *, (i < 60) AS train FROM rt WHERE ret IS NOT NULL), q AS (SELECT quantile_cont(ret, 0.25) AS a, quantile_cont(ret, 0.5) AS b, quantile_cont(ret, 0.75) AS c FROM t WHERE train)
  SELECT symbol, bar_start, {_o(delta='ret - (close / open - 1)')}, CAST(CAST(ret > a AS INTEGER) + CAST(ret > b AS INTEGER) + CAST(ret > c AS INTEGER) AS INTEGER) AS bin, CAST(symbol = 'click' AS INTEGER) AS regime_click, CAST(symbol = 'view' AS INTEGER) AS regime_view FROM t, q""")  # fmt: skip
def meta_dataset(spark, d):
    df = path_bars(spark, d).where("ret is not null").withColumn("guess", F.col("close") / F.col("open") - 1)
    bounds = labels.learned_bins(df, "ret", F.col("i") < 60)
    found = labels.meta_targets(df, "ret", "guess", "symbol", ["click", "view"])
    return found.select(*BAR_KEYS, r("delta").alias("delta"), X.bucket(F.col("ret"), bounds).alias("bin"), "regime_click", "regime_view")


ATR = PB + f", ranged AS (SELECT *, avg(high - low) OVER {last(14, BW)} AS atr FROM rt)"


def _with_atr(spark, d):
    return path_bars(spark, d).withColumn("atr", F.avg(F.col("high") - F.col("low")).over(by_bar().rowsBetween(-13, 0)))


@query(f"""WITH {ATR}, l AS (SELECT *, close + 2 * atr AS up, close * (1 - 0.1 + 0.005) AS dead, greatest(close - atr, close * (1 - 0.1 + 0.005)) AS down FROM ranged),
  h AS (SELECT a.symbol, a.i, min(b.i) AS j FROM l a JOIN l b ON a.symbol = b.symbol AND b.i > a.i AND b.i <= a.i + 24 AND (b.high >= a.up OR b.low <= a.down) GROUP BY 1, 2),
  e AS (SELECT symbol, max(i) AS n FROM l GROUP BY 1),
  x AS (SELECT l.*, h.j, b.high AS bh, b.low AS bl, f.close AS fin, coalesce(h.j - l.i, least(24, e.n - l.i)) AS held FROM l JOIN e ON e.symbol = l.symbol LEFT JOIN h ON h.symbol = l.symbol AND h.i = l.i LEFT JOIN l b ON b.symbol = l.symbol AND b.i = h.j JOIN l f ON f.symbol = l.symbol AND f.i = least(l.i + 24, e.n))
  SELECT symbol, bar_start, {_o(trade_return='10 * (CASE WHEN j IS NULL THEN (fin - close) / close WHEN bh >= up THEN (up - close) / close WHEN bl <= dead THEN -1 ELSE (down - close) / close END - ((1.5 + 0.01 * atr) * 0.0001 + 0.00005) / close - (held // 8) * 0.0001)')} FROM x""")  # fmt: skip
def exact_return(spark, d):
    return rounded(labels.exact_returns(_with_atr(spark, d), "atr"), BAR_KEYS, ["trade_return"])


@query(f"""WITH {ATR}, s AS (SELECT *, CAST(sign(close - open) AS INTEGER) AS direction FROM ranged),
  h AS (SELECT a.symbol, a.i, min(b.i) AS j FROM s a JOIN s b ON a.symbol = b.symbol AND b.i > a.i AND b.i <= a.i + 24 AND CASE WHEN a.direction = 1 THEN b.low <= a.close - a.atr OR b.high >= a.close + 2 * a.atr ELSE b.high >= a.close + a.atr OR b.low <= a.close - 2 * a.atr END GROUP BY 1, 2),
  e AS (SELECT symbol, max(i) AS n FROM s GROUP BY 1),
  x AS (SELECT s.*, h.j, CASE WHEN s.direction = 1 THEN b.low <= s.close - s.atr ELSE b.high >= s.close + s.atr END AS stopped, f.close AS fin FROM s JOIN e ON e.symbol = s.symbol LEFT JOIN h ON h.symbol = s.symbol AND h.i = s.i LEFT JOIN s b ON b.symbol = s.symbol AND b.i = h.j JOIN s f ON f.symbol = s.symbol AND f.i = least(s.i + 24, e.n) WHERE s.direction <> 0 AND s.i < e.n)
  SELECT symbol, bar_start, direction, CASE WHEN j IS NULL THEN 'TIME' WHEN stopped THEN 'STOP' ELSE 'TAKE' END AS exit_type,
    {_o(ret='direction * (CASE WHEN j IS NULL THEN fin WHEN stopped THEN close - direction * atr ELSE close + direction * 2 * atr END - close) / close')} FROM x""")  # fmt: skip
def path_backtest(spark, d):
    """Exits of positions opened at every bar of the path, in the direction of the bar."""
    df = _with_atr(spark, d).withColumn("direction", F.signum(F.col("close") - F.col("open")).cast("int"))
    return simulate.bar_backtest(df).select(*BAR_KEYS, "direction", "exit_type", r("ret").alias("ret"))


@query(f"""WITH {ATR}, s AS (SELECT *, CAST(sign(close - open) AS INTEGER) AS direction, i % 7 = 0 AS stress FROM ranged), e AS (SELECT symbol, max(i) AS n FROM s GROUP BY 1),
  h AS (SELECT x.symbol, x.i, min(y.i) AS j FROM s x JOIN s y ON x.symbol = y.symbol AND y.i > x.i AND y.i <= x.i + 24
    AND CASE WHEN x.direction = 1 THEN y.low <= x.close - x.atr OR y.high >= x.close + 2 * x.atr ELSE y.high >= x.close + x.atr OR y.low <= x.close - 2 * x.atr END GROUP BY 1, 2),
  x AS (SELECT s.*, h.j, e.n, CASE WHEN s.direction = 1 THEN b.low <= s.close - s.atr ELSE b.high >= s.close + s.atr END AS stopped, f.close AS fin FROM s JOIN e ON e.symbol = s.symbol LEFT JOIN h ON h.symbol = s.symbol AND h.i = s.i LEFT JOIN s b ON b.symbol = s.symbol AND b.i = h.j JOIN s f ON f.symbol = s.symbol AND f.i = least(s.i + 24, e.n) WHERE s.direction <> 0 AND s.i < e.n),
  o AS (SELECT *, CASE WHEN j IS NULL THEN fin WHEN stopped THEN close - direction * atr ELSE close + direction * 2 * atr END AS out FROM x)
  SELECT symbol, bar_start, direction, CASE WHEN j IS NULL AND i + 24 > n THEN 'EOD' WHEN j IS NULL THEN 'TIME' WHEN stopped THEN 'STOP' ELSE 'TAKE' END AS exit_type, CAST(coalesce(j, least(i + 24, n)) - i AS INTEGER) AS bars_held,
    {_o(ret='direction * (out - close) / close', net='direction * (out - close) / close - 0.00005 * (CASE WHEN stress THEN 10 ELSE 1 END + out / close)')} FROM o""")  # fmt: skip
def bar_trades(spark, d):
    """Exits of positions opened at every bar of the path, at the data's end too, after costs that some bars enter under stress."""
    df = _with_atr(spark, d).withColumns({"direction": F.signum(F.col("close") - F.col("open")).cast("int"), "stress": F.col("i") % 7 == 0})
    found = simulate.bar_trades(df)
    return found.select(*BAR_KEYS, "direction", "exit_type", "bars_held", r("ret").alias("ret"), r("net").alias("net"))


_MODES = """CASE WHEN trend > 0.6 AND abs(momentum) > 0.1 THEN sign(momentum) ELSE 0 END AS m0,
  CASE WHEN reversal > 0.5 AND quality > 0.5 AND quality < 2.5 AND abs(momentum) > 1.5 THEN -sign(momentum) ELSE 0 END AS m1,
  CASE WHEN NOT (reversal > 0.5 OR 1 - trend - reversal > 0.5) THEN 0 WHEN slope > 0 AND momentum < -0.4 AND quality < -0.4 THEN 1 WHEN slope < 0 AND momentum > 0.4 AND quality > 0.4 THEN -1 ELSE 0 END AS m2,
  CASE WHEN trend >= 0.51 THEN sign(momentum) ELSE 0 END AS m3"""


def _gate_inputs(df):
    a = (F.col("seq") % 11) / 10.0
    return df.withColumns({"trend": a, "reversal": (1 - a) * (F.col("seq") % 3) / 2.0, "momentum": (F.col("mid") - 50) / 20, "quality": F.col("volume") / 2 - 1, "slope": (F.col("seq") % 5) - 2.0})


@query(f"""WITH {TICKS}, s AS (SELECT symbol, seq, (seq % 11) / 10.0e0 AS trend, (1 - (seq % 11) / 10.0e0) * (seq % 3) / 2.0e0 AS reversal, (mid - 50) / 20 AS momentum, volume / 2 - 1 AS quality, (seq % 5) - 2.0e0 AS slope FROM ticks)
  SELECT symbol, seq, CAST(m0 AS INTEGER) AS momentum, CAST(m1 AS INTEGER) AS mean_rev, CAST(m2 AS INTEGER) AS exhaustion, CAST(m3 AS INTEGER) AS slingshot FROM (SELECT symbol, seq, {_MODES} FROM s)""")  # fmt: skip
def gate_modes(spark, d):
    """The direction that each mode of the gate gives."""
    c = [F.col(n) for n in ("reversal", "trend", "momentum", "quality", "slope")]
    modes = {m.lower(): simulate.gate(m, *c)["direction"] for m in simulate.GATES}
    return _gate_inputs(ticks(spark, d)).select(*KEYS, *(v.alias(k) for k, v in modes.items()))


@query()
def signal_trades(spark, d):
    """Trades that momentum gates and risk let through on the path's bars."""
    bars = _with_atr(spark, d).where("ret is not null")
    x = F.greatest(F.least(0.5 + 8 * F.abs("ret"), F.lit(0.98)), F.lit(0.0))
    df = bars.withColumns({"p_trend": x, "p_reversal": (1 - x) / 2, "p_stress": (1 - x) / 2, "momentum": 10 * F.col("ret"), "quality": F.lit(1.0), "slope": F.col("ret"), "pnl": 5000 * F.lag("ret").over(by_bar())})
    found = simulate.signals(df)
    return found.select(*BAR_KEYS, "direction", "regime", r("fraction").alias("fraction"), r("units").alias("units"), r("stop_loss").alias("stop_loss"), r("take_profit").alias("take_profit"))


@query(f"""WITH RECURSIVE {ATR}, s AS (SELECT symbol, bar_start, i, high, low, close, CASE WHEN i % 5 = 0 THEN sign(close - open) ELSE 0 END AS d, atr FROM ranged),
  m AS (SELECT symbol, bar_start, i, close, 0.0e0 AS d, 0.0e0 AS stop, 0.0e0 AS target, CAST(NULL AS DOUBLE) AS y FROM s WHERE i = 0
    UNION ALL SELECT symbol, bar_start, i, close, CASE WHEN still THEN hd ELSE d END, CASE WHEN still THEN stop ELSE close - d * atr END, CASE WHEN still THEN target ELSE close + 2 * d * atr END,
      CASE WHEN hd = 0 THEN 0 ELSE 0.5 * hd * (CASE WHEN still THEN close WHEN stopped THEN stop ELSE target END - was) / was END
    FROM (SELECT *, hd <> 0 AND NOT stopped AND NOT reached AS still FROM (SELECT s.*, m.d AS hd, m.stop, m.target, m.close AS was,
      CASE WHEN m.d > 0 THEN s.low <= m.stop ELSE s.high >= m.stop END AS stopped, CASE WHEN m.d > 0 THEN s.high >= m.target ELSE s.low <= m.target END AS reached
      FROM m JOIN s ON s.symbol = m.symbol AND s.i = m.i + 1)))
  SELECT symbol, bar_start, {_o(marked='y')} FROM m""")  # fmt: skip
def strategy_returns(spark, d):
    """A position at a time, opened by every fifth bar in its direction, marked to every bar."""
    side = F.when(F.col("i") % 5 == 0, F.signum(F.col("close") - F.col("open"))).otherwise(0.0)
    df = _with_atr(spark, d).withColumn("direction", side)
    stops = {"stop_loss": F.col("close") - side * F.col("atr"), "take_profit": F.col("close") + 2 * side * F.col("atr"), "fraction": F.lit(0.5)}
    return rounded(recurrences.run(df.withColumns(stops), recurrences.MarkedReturns(), order=("bar_start",)), BAR_KEYS, ["marked"])


RISK = ATR + f""", q AS (SELECT symbol, bar_start, i, close AS price, atr, sign(ret) AS direction, 0.5 + least(0.4, 30 * abs(ret)) AS p, 1 / (1 + 10 * abs(ret)) AS scale,
    CASE WHEN abs(ret) > 0.02 THEN 'TREND' WHEN abs(ret) < 0.005 THEN 'MEAN_REV' ELSE 'COMPRESSION' END AS regime, i % 5 AS n_open, i % 11 = 0 AS held,
    1000 * lead(ret) OVER ({BW}) * sign(ret) AS pnl FROM rt JOIN (SELECT symbol, bar_start, atr FROM ranged) USING (symbol, bar_start) WHERE ret IS NOT NULL),
  u AS (SELECT *, CASE WHEN pnl IS NOT NULL THEN 5000 + sum(pnl) OVER {BSO} END AS after FROM q),
  v AS (SELECT *, after / greatest(5000, max(after) OVER {BSO}) - 1 AS fall, after / first_value(after IGNORE NULLS) OVER (PARTITION BY symbol, CAST(bar_start AS DATE) ORDER BY bar_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS day_fall,
    coalesce(last_value(after IGNORE NULLS) OVER ({BW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 5000) AS equity, count(pnl) OVER k AS n, count(*) FILTER (pnl > 0) OVER k AS wins,
    sum(greatest(pnl, 0)) OVER k AS gains, -sum(least(pnl, 0)) OVER k AS losses FROM u WINDOW k AS ({BW} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
  z AS (SELECT *, last_value(CASE WHEN fall < -0.1 THEN 'total' WHEN day_fall < -0.05 THEN 'daily' END IGNORE NULLS) OVER ({BW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS halt,
    (gains / greatest(wins, 1)) / greatest(losses / greatest(n - wins, 1), 1e-10) AS odds FROM v),
  g AS (SELECT *, CASE WHEN halt IS NOT NULL THEN halt WHEN p < 0.65 THEN 'probability' WHEN n_open >= 3 THEN 'full' WHEN held THEN 'held' END AS veto,
    scale * least(0.02, greatest(0, 0.25 * CASE WHEN n >= 30 THEN (wins / n * odds - (1 - wins / n)) / greatest(odds, 1e-10) ELSE 2 * p - 1 END)) AS f,
    CASE regime WHEN 'TREND' THEN 3.0 WHEN 'MEAN_REV' THEN 1.5 ELSE 2.0 END * atr AS stop, CASE regime WHEN 'TREND' THEN 8.0 WHEN 'MEAN_REV' THEN 3.0 ELSE 5.0 END * atr AS take, CASE WHEN direction = 1 THEN 1 ELSE -1 END AS side FROM z)"""


@query(f"WITH {RISK} SELECT symbol, bar_start, veto, {_o(equity='equity', fraction='CASE WHEN veto IS NULL THEN f END', units='CASE WHEN veto IS NULL THEN f * equity / greatest(stop, 1e-10) END', stop_loss='CASE WHEN veto IS NULL THEN price - side * stop END', take_profit='CASE WHEN veto IS NULL THEN price + side * take END')} FROM g")
def risk_engine(spark, d):
    """Decisions on a trade at each bar of the path, in the direction of its return; a trade's outcome is the next bar's return."""
    size = F.abs("ret")
    df = _with_atr(spark, d).where("ret is not null").withColumn("direction", F.signum("ret")).withColumns({
        "price": F.col("close"), "p": 0.5 + F.least(F.lit(0.4), 30 * size), "scale": 1 / (1 + 10 * size),
        "regime": F.when(size > 0.02, "TREND").when(size < 0.005, "MEAN_REV").otherwise("COMPRESSION"),
        "n_open": F.col("i") % 5, "held": F.col("i") % 11 == 0, "pnl": 1000 * F.lead("ret").over(by_bar()) * F.col("direction"),
    })
    return rounded(risk.decide(df, "bar_start"), (*BAR_KEYS, "veto"), ["equity", "fraction", "units", "stop_loss", "take_profit"])



# splits


def _split_query(name: str, ranges, sql_folds: str, shown: str = "CAST(fold AS INTEGER) AS fold, role"):
    """Counts of every fold's rows by role; ``ranges`` are made from the rows of the longest symbol."""

    def counts(spark, d):
        rows = splits.numbered(ticks(spark, d)).select("symbol", "row")
        n = rows.agg(F.max("row") + 1).first()[0]
        found = splits.assign(rows, ranges(n))
        return found.groupBy("symbol", "fold", "role").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.max("row").alias("last"))

    counts.__name__ = name
    query(f"""WITH {TICKS}, nr AS (SELECT symbol, row_number() OVER ({W}) - 1 AS row FROM ticks), l AS (SELECT CAST(max(row) + 1 AS BIGINT) AS n FROM nr), {sql_folds}
      SELECT symbol, {shown}, count(*) AS n, min(row) AS first, max(row) AS last FROM nr JOIN folds ON row >= b AND row < f GROUP BY ALL""")(counts)  # fmt: skip


_split_query("purged_folds", lambda n: splits.contiguous_ranges(n, purge=36, embargo=50), """k AS (SELECT n, n // 6 AS size, unnest(range(5)) AS fold FROM l),
  folds AS (SELECT fold, 'test' AS role, fold * size AS b, (fold + 2) * size AS f FROM k UNION ALL SELECT fold, 'train', 0, fold * size - 36 FROM k WHERE fold * size > 36 UNION ALL SELECT fold, 'train', (fold + 2) * size + 50, n FROM k WHERE (fold + 2) * size + 50 < n)""")
_split_query("combinatorial_folds", lambda n: splits.combinatorial_ranges(n, embargo=50), """part AS (SELECT n, unnest(range(6)) AS p FROM l), pairs AS (SELECT x.p AS s, y.p AS t, row_number() OVER (ORDER BY x.p, y.p) - 1 AS fold FROM part x JOIN part y ON x.p < y.p),
  folds AS (SELECT fold, CASE WHEN p IN (s, t) THEN 'test' ELSE 'train' END AS role, n * p // 6 + CASE WHEN p NOT IN (s, t) AND p - 1 IN (s, t) THEN 50 ELSE 0 END AS b, n * (p + 1) // 6 - CASE WHEN p NOT IN (s, t) AND p + 1 IN (s, t) THEN 50 ELSE 0 END AS f FROM pairs, part)""")
_split_query("walk_forward_folds", lambda n: splits.walk_forward_ranges(n, n // 3, n // 10), """k AS (SELECT n, n // 3 AS a, n // 10 AS t, unnest(range((n - n // 3) // (n // 10))) AS fold FROM l),
  folds AS (SELECT fold, 'train' AS role, 0 AS b, a + fold * t AS f FROM k UNION ALL SELECT fold, 'test', a + fold * t, a + (fold + 1) * t FROM k)""")
_split_query("rolling_folds", lambda n: splits.walk_forward_ranges(n, n // 3, n // 10, rolling=True), """k AS (SELECT n, n // 3 AS a, n // 10 AS t, unnest(range((n - n // 3) // (n // 10))) AS fold FROM l),
  folds AS (SELECT fold, 'train' AS role, fold * t AS b, a + fold * t AS f FROM k UNION ALL SELECT fold, 'test', a + fold * t, a + (fold + 1) * t FROM k)""")
_split_query("nested_validation", splits.nested_validation, """folds AS (SELECT 0 AS fold, 'train' AS role, 0 AS b, n - CAST(floor(n * 0.2e0) AS BIGINT) - 9 AS f FROM l UNION ALL SELECT 0, 'validation', n - CAST(floor(n * 0.2e0) AS BIGINT), n FROM l)""")
_split_query("out_of_fold", splits.time_series_ranges, """k AS (SELECT n, n // 6 AS size, unnest(range(5)) AS fold FROM l), o AS (SELECT *, n - (5 - fold) * size AS b0 FROM k),
  folds AS (SELECT fold, 'train' AS role, 0 AS b, b0 - 5 AS f FROM o WHERE b0 > 5 UNION ALL SELECT fold, 'test', b0, b0 + size FROM o WHERE b0 > 5)""")


_GRID = "g AS (SELECT CAST(row_number() OVER (ORDER BY stop, take) - 1 AS BIGINT) AS combination, stop, take FROM (VALUES (1.0e0), (1.5e0)) a(stop), (VALUES (2.0e0), (3.0e0), (4.0e0)) b(take))"


@query(f"""WITH {ATR}, n AS MATERIALIZED (SELECT * FROM ranged), {_GRID},
  x AS (SELECT combination, stop, take, n.symbol, n.i, close + take * atr AS up, close - stop * atr AS down FROM n, g),
  h AS (SELECT combination, x.symbol, x.i, arg_min(y.high >= up, y.i) AS hit FROM x JOIN n y ON y.symbol = x.symbol AND y.i > x.i AND y.i <= x.i + 24 AND (y.high >= up OR y.low <= down) GROUP BY 1, 2, 3)
  SELECT combination, stop, take, count(*) AS n, round(avg(CAST(coalesce(hit, false) AS INTEGER)), 6) + 0.0 AS hits, round(avg(CASE WHEN hit THEN take WHEN NOT hit THEN -stop ELSE 0 END), 6) + 0.0 AS score
  FROM x LEFT JOIN h USING (combination, symbol, i) GROUP BY 1, 2, 3""")  # fmt: skip
def grid_search(spark, d):
    """Each pair of stop and target distances scored on all bars: how often the target comes first, and the mean gain in ranges."""

    def score(df, chosen):
        marked = labels.bar_outcome(df, "atr", chosen["take"], chosen["stop"])
        gain = F.when(F.col("outcome") == 1, chosen["take"]).when(F.col("outcome") == -1, -chosen["stop"]).otherwise(0.0)
        return marked.agg(F.count("*").alias("n"), r(F.avg((F.col("outcome") == 1).cast("int"))).alias("hits"), r(F.avg(gain)).alias("score"))

    return splits.grid_scores(_with_atr(spark, d), {"stop": [1.0, 1.5], "take": [2.0, 3.0, 4.0]}, score)


@query(f"""WITH {PB}, v AS (SELECT symbol, ret, sign(lag(ret) OVER ({BW})) AS before, i AS row, count(*) OVER (PARTITION BY symbol) AS n FROM rt),
  parts AS (SELECT unnest(range(6)) AS p), pairs AS (SELECT x.p AS s, y.p AS t, row_number() OVER (ORDER BY x.p, y.p) - 1 AS fold FROM parts x JOIN parts y ON x.p < y.p),
  k AS (SELECT v.*, p AS part, row - n * p // 6 AS from_begin, n * (p + 1) // 6 - 1 - row AS to_end FROM v JOIN parts ON row >= n * p // 6 AND row < n * (p + 1) // 6),
  f AS (SELECT k.*, fold, part IN (s, t) AS test, (part - 1 IN (s, t) AND from_begin < 3) OR (part + 1 IN (s, t) AND to_end < 3) AS near FROM k, pairs),
  m AS (SELECT symbol, fold, avg(ret * before) AS edge FROM f WHERE NOT test AND NOT near GROUP BY 1, 2),
  o AS (SELECT fold, p, row_number() OVER (PARTITION BY p ORDER BY fold) - 1 AS path FROM pairs JOIN parts ON p IN (s, t)),
  z AS (SELECT f.symbol, path, sign(edge) * before * ret AS gain FROM f JOIN m ON m.symbol = f.symbol AND m.fold = f.fold JOIN o ON o.fold = f.fold AND o.p = f.part WHERE test),
  q AS (SELECT symbol, path, count(gain) AS n, avg(gain) / greatest(stddev_samp(gain), 1e-8) AS ratio FROM z GROUP BY 1, 2)
  SELECT symbol, CAST(path AS INTEGER) AS path, n, round(ratio, 6) + 0.0 AS ratio, round(min(ratio) OVER (PARTITION BY symbol), 6) + 0.0 AS worst, round(avg(ratio) OVER (PARTITION BY symbol), 6) + 0.0 AS mean FROM q""")  # fmt: skip
def combinatorial_paths(spark, d):
    """Back-test paths of combinatorial folds: each fold learns if returns go on or turn, and its test parts join into paths, with the ratio of each."""
    bars = path_bars(spark, d).withColumn("before", F.signum(F.lag("ret").over(by_bar())))
    bars = bars.select("symbol", "ret", "before", F.col("bar_start").alias("ts"), (F.unix_micros("bar_start") * 1000).alias("timestamp_ns"), F.lit(0).alias("seq")).withColumnRenamed("before", "turn")
    rows = splits.combinatorial_roles(splits.in_parts(bars, 6), 6, 2, embargo=3)
    edge = rows.where("role = 'train'").groupBy("symbol", "fold").agg(F.signum(F.avg(F.col("ret") * F.col("turn"))).alias("edge"))
    gain = rows.where("role = 'test'").join(edge, ["symbol", "fold"]).withColumn("gain", F.col("edge") * F.col("turn") * F.col("ret"))
    paths = gain.groupBy("symbol", "path").agg(F.count("gain").alias("n"), (F.avg("gain") / F.greatest(F.stddev_samp("gain"), F.lit(1e-8))).alias("ratio"))
    every = Window.partitionBy("symbol")
    return paths.select("symbol", "path", "n", r("ratio").alias("ratio"), r(F.min("ratio").over(every)).alias("worst"), r(F.avg("ratio").over(every)).alias("mean"))


# sizing, gates, challenges


@query(f"""WITH {EQ}, z AS (SELECT symbol, i, equity, greatest(100 * abs(ret), 2) AS pips, least(equity * 0.02 * 0.25, equity * 0.01) AS risk, 40.0e0 AS budget FROM eq WHERE equity > 0),
  l AS (SELECT *, greatest(0.01, round_even(risk / (pips * 10), 2)) AS lots FROM z)
  SELECT symbol, i, {_o(lots='CASE WHEN lots * pips * 10 > budget THEN round_even(budget / (pips * 10), 2) ELSE lots END')} FROM l""")  # fmt: skip
def position_sizes(spark, d):
    lots = simulate.position_size(F.col("equity"), F.lit(40.0), 100 * F.abs("ret"), F.lit(10.0))
    return _equity(spark, d).where("equity > 0").select("symbol", F.col("i").cast("long").alias("i"), r(lots).alias("lots"))


@query(f"""WITH {TICKS}, s AS (SELECT *, (seq % 11) / 10.0e0 AS a, (seq % 7) / 6.0e0 AS b, (seq % 5) / 4.0e0 AS c, CAST(seq % 3 AS INTEGER) - 1 AS direction FROM ticks)
  SELECT symbol, seq, CAST(CASE WHEN a > 0.5 OR b > 0.6 OR c > 0.6 OR (1 - a) > 0.7 OR spread * 100 >= 4.5 THEN 0 ELSE direction END AS INTEGER) AS direction,
    greatest(a, b) > 0.6 AND c > 0.5 AND b > 0.5 AS all_pass, CAST(CASE WHEN NOT (greatest(a, b) > 0.6 AND c > 0.5 AND b > 0.5) THEN 0 WHEN a > b THEN -1 ELSE 1 END AS INTEGER) AS gate,
    CASE symbol WHEN 'click' THEN 0.0001e0 WHEN 'view' THEN 0.001e0 ELSE 0.0005e0 END AS friction FROM s""")  # fmt: skip
def signal_gates(spark, d):
    a, b, c = (F.col("seq") % 11) / 10.0, (F.col("seq") % 7) / 6.0, (F.col("seq") % 5) / 4.0
    zero = F.lit(0.0)
    fused = simulate.fuse_signals((F.col("seq") % 3).cast("int") - 1, a, F.array(zero, zero, b, c), F.array(zero, zero, zero, 1 - a), F.col("spread") * 100, F.lit(4.5))
    gate = simulate.triple_gate(a, b, c, b)
    asset = F.when(F.col("symbol") == "click", "fx").when(F.col("symbol") == "view", "crypto").otherwise("other")
    return ticks(spark, d).select(*KEYS, fused.alias("direction"), gate["all_pass"].alias("all_pass"), gate["direction"].alias("gate"), simulate.friction(asset).alias("friction"))


CHALLENGE = EQ + """, e0 AS (SELECT *, CAST(epoch_us(entry) AS BIGINT) * 1000 AS ns FROM eq), e1 AS (SELECT *, min(ns) OVER (PARTITION BY symbol) AS a, max(ns) OVER (PARTITION BY symbol) AS z FROM e0),
  e2 AS (SELECT *, (ns - a) // 432000000000000 AS challenge FROM e1 WHERE (ns - a) // 432000000000000 < (z - a) // 432000000000000),
  e3 AS (SELECT symbol, challenge, max(equity) >= 5400 AS passed, max(equity) < 5400 AND min(equity) <= 4500 AS failed FROM e2 GROUP BY 1, 2)"""


def _challenges(spark, d):
    timed = _equity(spark, d).withColumn("timestamp_ns", F.unix_micros("entry") * 1000)
    return simulate.challenge_results(simulate.challenge_windows(timed, 5))


@query(f"WITH {CHALLENGE} SELECT symbol, challenge, passed, failed FROM e3")
def prop_challenges(spark, d):
    return _challenges(spark, d)


@query(f"WITH {CHALLENGE} SELECT symbol, count(*) AS n, count(*) FILTER (passed) AS n_passed, count(*) FILTER (failed) AS n_failed, {_o(pass_rate='avg(CAST(passed AS INTEGER))')} FROM e3 GROUP BY 1")
def challenge_tally(spark, d):
    return simulate.challenge_tally(_challenges(spark, d)).select("symbol", "n", "n_passed", "n_failed", r("pass_rate").alias("pass_rate"))


# simulation

RETURNS = TR + ", rs AS (SELECT row_number() OVER (ORDER BY entry, symbol) - 1 AS step, ret / 4 AS ret FROM tr), rn AS (SELECT count(*) AS n FROM rs)"


def _series(spark, d):
    """All trades' returns in time as one series; its number of steps follows bars, of which there are few."""
    return trades(spark, d).select((F.row_number().over(Window.orderBy("entry", "symbol")) - 1).alias("step"), (F.col("ret") / 4).alias("ret"))


def _draw(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")), 1, 8))::BIGINT"


BOOT = RETURNS + f""", sm AS (SELECT unnest(range(40)) AS sim), st AS (SELECT sim, unnest(range(30)) AS step FROM sm),
  bo AS (SELECT st.sim, st.step, rs.ret FROM st, rn JOIN rs ON rs.step = ({_draw('st.sim', 'st.step // 5', '42')} % n + st.step % 5) % n)"""


@query(f"WITH {BOOT} SELECT sim, CAST(step AS INTEGER) AS step, {_o(ret='ret')} FROM bo")
def block_bootstrap(spark, d):
    return montecarlo.block_bootstrap(_series(spark, d), 40, 30).select("sim", "step", r("ret").alias("ret"))


_WALK = """WITH RECURSIVE {boot}, ch AS (SELECT sim, 0 AS step, 5000.0e0 AS equity, false AS breached FROM sm UNION ALL
  SELECT c.sim, c.step + 1, CASE WHEN c.breached THEN c.equity ELSE c.equity * (1 + b.ret) END,
    c.breached OR -c.equity * b.ret >= 600 OR c.equity * (1 + b.ret) <= 5000 * 0.9 FROM ch c JOIN bo b ON b.sim = c.sim AND b.step = c.step)
  {end}"""


@query(_WALK.format(boot=BOOT, end="SELECT sim, NOT breached AND equity >= 5400 AS passed, breached FROM ch WHERE step = 30"))
def challenge_simulation(spark, d):
    paths = montecarlo.block_bootstrap(_series(spark, d), 40, 30)
    return montecarlo.challenges(paths, daily_usd=600.0).select("sim", "passed", "breached")


_P = "(k::DOUBLE / n)"
_HALF = f"1.645e0 * sqrt({_P} * (1 - {_P}) / n + 1.645e0 * 1.645e0 / (4.0 * n * n)) / (1 + 1.645e0 * 1.645e0 / n)"
_MID = f"({_P} + 1.645e0 * 1.645e0 / (2.0 * n)) / (1 + 1.645e0 * 1.645e0 / n)"


@query(f"WITH {TR}, c AS (SELECT symbol, count(*) AS n, count(*) FILTER (pnl > 0) AS k FROM tr GROUP BY 1) SELECT symbol, {_o(low=f'greatest({_MID} - {_HALF}, 0)', high=f'least({_MID} + {_HALF}, 1)', posterior='(k + 1.0e0) / (n + 2)')} FROM c")
def win_intervals(spark, d):
    counts = trades(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("k"))
    bounds = montecarlo.wilson(F.col("k"), F.col("n"))
    return counts.select("symbol", r(bounds["low"]).alias("low"), r(bounds["high"]).alias("high"), r(montecarlo.beta_mean(F.col("k"), F.col("n"))).alias("posterior"))


@query(f"WITH {BOOT} SELECT sim, {_o(var='quantile_cont(-5000 * ret, 0.999)')}, quantile_cont(-5000 * ret, 0.999) < 500 AS allowed FROM bo GROUP BY sim")
def path_barrier(spark, d):
    losses = montecarlo.block_bootstrap(_series(spark, d), 40, 30).withColumn("loss", -5000 * F.col("ret"))
    return montecarlo.path_barrier(losses, "sim", "loss", F.lit(500.0)).select("sim", r("var").alias("var"), "allowed")


@query(f"""WITH {RETURNS}, dr AS (SELECT sim, ret FROM rs, rn, (SELECT unnest(range(-1, 100)) AS sim) WHERE CASE WHEN sim < 0 THEN step < n // 2 ELSE {_draw('step', 'sim', '42')} % 2 = 0 END),
  e AS (SELECT sim, avg(ret) / stddev_pop(ret) * sqrt(252) AS v FROM dr GROUP BY 1) SELECT round(max(v) FILTER (sim < 0), 6) + 0.0 AS actual, round(avg(CAST(v >= (SELECT v FROM e WHERE sim < 0) AS INTEGER)) FILTER (sim >= 0), 6) + 0.0 AS p_value FROM e""")  # fmt: skip
def permutation_test(spark, d):
    return montecarlo.permutation_test(_series(spark, d), 100).select(r("actual").alias("actual"), r("p_value").alias("p_value"))


def _any_cdf(z: str) -> str:
    return f"CASE WHEN {z} >= 0 THEN {_cdf(f'({z})')} ELSE 1 - {_cdf(f'(-({z}))')} END"


_BENCH = montecarlo.deflated_benchmark(20, 0.02)
_Z = "(sr - {b}) * sqrt(n - 1) / sqrt(1 - sk * sr + (ku + 2) / 4 * sr * sr)"


@query(f"""WITH {TR}, c AS (SELECT *, ret - avg(ret) OVER (PARTITION BY symbol) AS x FROM tr), m AS (SELECT symbol, count(*) AS n, avg(ret) / stddev_samp(ret) AS sr, sqrt(count(*)) * sum(x * x * x) / pow(sum(x * x), 1.5) AS sk, count(*) * sum(x * x * x * x) / (sum(x * x) * sum(x * x)) - 3 AS ku FROM c GROUP BY 1)
  SELECT symbol, {_o(psr=_any_cdf(_Z.format(b=0)), deflated=_any_cdf(_Z.format(b=f'{_BENCH!r}::DOUBLE')))} FROM m""")  # fmt: skip
def probabilistic_sharpe(spark, d):
    x = F.col("ret")
    m = trades(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), (F.avg(x) / F.stddev_samp(x)).alias("sr"), F.skewness(x).alias("sk"), F.kurtosis(x).alias("ku"))
    psr = lambda b: montecarlo.probabilistic_sharpe(F.col("sr"), F.col("n"), F.col("sk"), F.col("ku"), b)
    return m.select("symbol", r(psr(0.0)).alias("psr"), r(psr(_BENCH)).alias("deflated"))


@query(f"WITH {TR}, g AS (SELECT symbol, sum(pnl) AS gross, count(*) AS n_trades FROM tr GROUP BY 1) SELECT symbol, scenario, {_o(net='gross - n_trades * cost')} FROM g, (VALUES ('none', 0.0e0), ('low', 1.0e0), ('normal', 2.5e0), ('stress', 10.0e0)) t(scenario, cost)")
def cost_scenarios(spark, d):
    g = trades(spark, d).groupBy("symbol").agg(F.sum("pnl").alias("gross"), F.count("*").alias("n_trades"))
    return montecarlo.cost_scenarios(spark, g, {"none": 0.0, "low": 1.0, "normal": 2.5, "stress": 10.0}).select("symbol", "scenario", r("net").alias("net"))


def _stationary(simulations: int) -> str:
    """Rows ``dr`` (sim, ret) of stationary resamples."""
    return RETURNS + f""", sm AS (SELECT unnest(range({simulations})) AS sim), st AS (SELECT sim, n, CAST(unnest(range(n)) AS BIGINT) AS step FROM sm, rn),
  nw AS (SELECT *, step = 0 OR {_draw('sim', 'step', '42')} / 4294967296.0e0 < 1 / 20.0e0 AS fresh FROM st), fr AS (SELECT *, last_value(CASE WHEN fresh THEN step END IGNORE NULLS) OVER (PARTITION BY sim ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM nw),
  dr AS (SELECT sim, rs.ret FROM fr JOIN rs ON rs.step = ({_draw('sim', 'b', '43')} % n + fr.step - b) % n)"""


@query(f"WITH {_stationary(20)}, v AS (SELECT sim, avg(ret) AS m FROM dr GROUP BY 1) SELECT sim, {_o(mean='m')} FROM v")
def stationary_bootstrap(spark, d):
    found = montecarlo.stationary_bootstrap(_series(spark, d), 20).groupBy("sim").agg(F.avg("ret").alias("mean"))
    return found.select("sim", r("mean").alias("mean"))


@query(f"""WITH {_stationary(50)}, v AS (SELECT sim, avg(ret) / stddev_samp(ret) * sqrt(252) AS m FROM dr GROUP BY 1), a AS (SELECT avg(ret) / stddev_samp(ret) * sqrt(252) AS actual FROM rs)
  SELECT round(any_value(actual), 6) + 0.0 AS actual, round(avg(CAST(m >= actual AS INTEGER)), 6) + 0.0 AS p_value FROM v, a""")  # fmt: skip
def bootstrap_test(spark, d):
    """The Sharpe ratio of all trades' returns against stationary resamples of them."""
    return montecarlo.bootstrap_test(_series(spark, d), 50).select(r("actual").alias("actual"), r("p_value").alias("p_value"))


@query(f"""WITH {TICKS}, q AS (SELECT [quantile_cont(mid, i / 100.0e0) FILTER (symbol = 'click') FOR i IN range(1)] AS z FROM ticks),
  g AS (SELECT unnest(range(101)) / 100.0e0 AS p), a AS (SELECT p, (SELECT quantile_cont(mid, [{', '.join(f'{i / 100}' for i in range(101))}]) FROM ticks WHERE symbol = 'click') AS x, (SELECT quantile_cont(mid, [{', '.join(f'{i / 100}' for i in range(101))}]) FROM ticks WHERE symbol = 'view') AS y FROM g WHERE p = 0)
  SELECT round(list_sum([abs(x[i] - y[i]) FOR i IN range(1, 102)]) / 101, 6) AS distance, CASE WHEN list_sum([abs(x[i] - y[i]) FOR i IN range(1, 102)]) / 101 > 0.1 THEN 0.25e0 ELSE 1.0e0 END AS scale FROM a""".replace("q AS (SELECT [quantile_cont(mid, i / 100.0e0) FILTER (symbol = 'click') FOR i IN range(1)] AS z FROM ticks),\n", ""))  # fmt: skip
def drift_monitor(spark, d):
    df = ticks(spark, d)
    found = montecarlo.wasserstein(df.where("symbol = 'click'"), df.where("symbol = 'view'"), "mid")
    return found.select(r("distance").alias("distance"), montecarlo.position_scale(F.col("distance"), F.lit(0.1)).alias("scale"))


@query(f"WITH {TR} SELECT symbol, i, {_o(reward='CASE WHEN pnl > 0 THEN pnl * CASE WHEN i % 2 = 0 THEN 1.5 ELSE 1 END ELSE -pow(abs(pnl), 1.5) END')} FROM tr")
def shaped_rewards(spark, d):
    return trades(spark, d).select("symbol", F.col("i").cast("long").alias("i"), r(montecarlo.shaped_reward(F.col("pnl"), F.col("i") % 2 == 0)).alias("reward"))


# scalars, filters, sets

_V = "[mid / 10, spread, volume / 5]"
_E = f"[exp(x - list_max({_V})) FOR x IN {_V}]"
_SP = "(greatest(mid / 20 - 2.5, 0) + ln(1 + exp(-abs(mid / 20 - 2.5))))"


@query(f"""WITH {TICKS} SELECT symbol, seq, {_o(sigmoid='1 / (1 + exp(-(mid / 20 - 2.5)))', softplus=_SP, mish=f'(mid / 20 - 2.5) * tanh({_SP})', logsumexp=f'list_max({_V}) + ln(list_sum({_E}))', softmax=f'({_E})[1] / list_sum({_E})', cdf=_any_cdf('(mid / 20 - 2.5)'), ratio='mid / (spread + 1e-8)', pips='spread / 0.0001e0 * 10 * 2')},
  CAST(list_position({_V}, list_max({_V})) - 1 AS INTEGER) AS argmax, CAST(CAST(mid > 25 AS INTEGER) + CAST(mid > 50 AS INTEGER) + CAST(mid > 75 AS INTEGER) AS INTEGER) AS bucket, CAST(symbol = 'click' AS INTEGER) AS is_click, {_o(padded='list_sum([mid, spread, 7.0])')} FROM ticks""")  # fmt: skip
def scalar_functions(spark, d):
    x, v = F.col("mid") / 20 - 2.5, F.array(F.col("mid") / 10, F.col("spread"), F.col("volume") / 5)
    df = ticks(spark, d).withColumns({"v": v, "pip_size": F.lit(0.0001), "pip_value": F.lit(10.0)})
    padded = X.pad_left(F.array(F.col("mid"), F.col("spread")), 3, 7.0)
    found = {
        "sigmoid": X.sigmoid(x), "softplus": X.softplus(x), "mish": X.mish(x), "logsumexp": X.logsumexp(F.col("v")), "softmax": F.get(X.softmax(F.col("v")), F.lit(0)),
        "cdf": X.normal_cdf(x), "ratio": X.safe_divide(F.col("mid"), F.col("spread")), "pips": X.pip_value(F.col("spread"), F.lit(2.0)), "padded": F.aggregate(padded, F.lit(0.0), lambda s, y: s + y),
    }
    hot = X.one_hot(F.col("symbol"), ["click"], "is")["is_click"]
    return df.select(*KEYS, *(r(c).alias(k) for k, c in found.items()), X.argmax(F.col("v")).alias("argmax"), X.bucket(F.col("mid"), [25.0, 50.0, 75.0]).alias("bucket"), hot.alias("is_click"))


ODD = "CASE WHEN seq % 13 = 0 THEN CAST('NaN' AS DOUBLE) WHEN seq % 17 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN seq % 19 = 0 THEN NULL ELSE mid END"


def _odd(spark, d):
    s = F.col("seq")
    odd = F.when(s % 13 == 0, float("nan")).when(s % 17 == 0, float("inf")).when(s % 19 == 0, None).otherwise(F.col("mid"))
    return ticks(spark, d).withColumn("odd", odd)


@query(f"WITH {TICKS}, o AS (SELECT *, {ODD} AS odd FROM ticks) SELECT symbol, seq, round(odd, 6) AS odd FROM o WHERE odd IS NOT NULL AND isfinite(odd)")
def finite_rows(spark, d):
    return rounded(clean.forbid_odd(clean.complete_rows(_odd(spark, d), "odd"), "odd"), KEYS, ["odd"])


@query(f"WITH {TICKS}, o AS (SELECT *, {ODD} AS odd FROM ticks) SELECT symbol, seq, round(CASE WHEN odd IS NOT NULL AND isfinite(odd) THEN odd ELSE 0 END, 6) AS odd FROM o")
def odd_as_zero(spark, d):
    return rounded(_odd(spark, d), KEYS, {"odd": clean.zero_if_odd(F.col("odd"))})


@query(f"WITH {TICKS}, s AS (SELECT symbol, seq, mid FROM ticks ORDER BY {_draw('symbol', 'seq', '42')}, symbol, seq LIMIT 500) SELECT symbol, seq, round(mid, 6) AS mid FROM s")
def subsample(spark, d):
    """500 rows drawn without replacement: the sampling operator."""
    return rounded(clean.stable_sample(ticks(spark, d), 500, 42, "symbol", "seq"), KEYS, ["mid"])


@query(f"""WITH {TICKS}, b AS (SELECT (min(timestamp_ns) + (max(timestamp_ns) - min(timestamp_ns)) // 4) AS a, max(timestamp_ns) - (max(timestamp_ns) - min(timestamp_ns)) // 4 AS z FROM ticks),
  k AS (SELECT symbol, seq FROM ticks, b WHERE timestamp_ns BETWEEN a AND z INTERSECT SELECT symbol, seq FROM ticks WHERE seq % 2 = 0), x AS (SELECT symbol, seq FROM k EXCEPT SELECT symbol, seq FROM ticks WHERE seq % 10 = 0)
  SELECT t.symbol, t.seq, round(t.mid, 6) AS mid FROM ticks t SEMI JOIN x ON t.symbol = x.symbol AND t.seq = x.seq""")  # fmt: skip
def aligned_slice(spark, d):
    """Rows between two times whose keys are in a second set and not in a third."""
    df = ticks(spark, d)
    ends = df.agg(F.min("timestamp_ns").alias("a"), F.max("timestamp_ns").alias("z")).first()
    quarter = (ends["z"] - ends["a"]) // 4
    keys = joins.aligned(joins.between(df, ends["a"] + quarter, ends["z"] - quarter), df.where("seq % 2 = 0"), *KEYS)
    return rounded(joins.kept(joins.excluded(df, df.where("seq % 10 = 0"), *KEYS), keys, *KEYS), KEYS, ["mid"])


@query(f"""WITH {TICKS}, u AS (SELECT symbol, seq, mid FROM ticks WHERE seq % 2 = 0 UNION ALL SELECT symbol, seq, mid FROM ticks WHERE seq % 2 = 1)
  SELECT u.symbol, u.seq, round(u.mid, 6) AS mid, round(t.spread, 6) AS spread FROM u JOIN ticks t USING (symbol, seq)""")  # fmt: skip
def chunks_beside_features(spark, d):
    df = ticks(spark, d)
    every = joins.stacked(df.where("seq % 2 = 0").select(*KEYS, "mid"), df.where("seq % 2 = 1").select("mid", *KEYS))
    return rounded(joins.beside(every, df.select(*KEYS, "spread"), *KEYS), KEYS, ["mid", "spread"])


@query(f"WITH {TICKS} SELECT symbol, arg_min(seq, (timestamp_ns, seq)) AS seq, CAST(count(DISTINCT volume) AS BIGINT) AS classes FROM ticks GROUP BY symbol")
def oldest_and_classes(spark, d):
    return joins.oldest(ticks(spark, d)).join(ticks(spark, d).select("symbol", "volume").distinct().groupBy("symbol").agg(F.count("*").alias("classes")), "symbol").select(*KEYS, "classes")
