"""Queries of fitted and fixed models over bars."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tickloom.functions import bar_features as C
from tickloom.operators import isolation, jumps, markov, regimes, splits, trees, whitening
from tickloom.plans.base import BAR_KEYS, BARS, BW, r, rounded, six_hourly

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return keep


def returns(spark, d):
    """Six-hour bars with log returns and their variance over 50 bars, as rows in time."""
    df = six_hourly(spark, d).where("close > 0").withColumn("log_return", C.log_return())
    known = F.coalesce(C.return_variance(50), F.lit(0.0))
    df = df.withColumns({"variance": known, "ts": F.col("bar_start"), "timestamp_ns": F.unix_micros("bar_start") * 1000, "seq": F.lit(0)})
    return df.select("symbol", "ts", "timestamp_ns", "seq", "log_return", "variance", "spread_avg")


#: Three states by the level of the return, the outer ones of two components; wide spreads make states less lasting.
FIXED = markov.Markov(
    ("log_return",),
    np.array([0.3, 0.4, 0.3]),
    np.array([[0.6, 0.4], [0.5, 0.5], [0.6, 0.4]]),
    np.array([[[-0.4], [-1.2]], [[0.0], [0.1]], [[0.4], [1.2]]]),
    np.array([[[[0.16]], [[0.64]]], [[[0.04]], [[0.09]]], [[[0.16]], [[0.64]]]]),
    np.array([[[1.5, -20.0], [0.2, 0.0], [0.0, 0.0]], [[0.0, 5.0], [1.0, -10.0], [0.0, 5.0]], [[0.0, 0.0], [0.2, 0.0], [1.5, -20.0]]]),
    ("spread_avg",),
)
STATES = range(3)


def _parts_sql() -> str:
    """For each bar its number, the density of each state, and the moves out of the bar before."""
    density = lambda s: " + ".join(
        f"{w!r} * exp(-0.5 * pow((log_return - ({m[0]!r})) / {math.sqrt(v[0][0])!r}, 2)) / {math.sqrt(2 * math.pi * v[0][0])!r}"
        for w, m, v in zip(FIXED.weights[s].tolist(), FIXED.means[s].tolist(), FIXED.covariances[s].tolist(), strict=True)
    )
    logit = lambda i, j: f"exp({FIXED.moves[i, j, 0].item()!r} + ({FIXED.moves[i, j, 1].item()!r}) * before)"
    moves = ", ".join(f"{logit(i, j)} / ({' + '.join(logit(i, k) for k in STATES)}) AS a{i}{j}" for i in STATES for j in STATES)
    return BARS + f""", l AS (SELECT *, ln(close / lag(close) OVER ({BW})) AS log_return, lag(spread_avg) OVER ({BW}) AS before, row_number() OVER ({BW}) AS i FROM bars WHERE close > 0),
      e AS MATERIALIZED (SELECT symbol, bar_start, i, {', '.join(f'coalesce({density(s)}, 1) AS b{s}' for s in STATES)}, {moves} FROM l)"""


def _filter_sql() -> str:
    start = FIXED.start.tolist()
    prior = [" + ".join(f"p.p{i} * e.a{i}{j}" for i in STATES) for j in STATES]
    return f"""WITH RECURSIVE {_parts_sql()},
      w0 AS (SELECT *, {', '.join(f'{start[s]!r} * b{s} AS w{s}' for s in STATES)} FROM e WHERE i = 1),
      p AS (SELECT symbol, bar_start, i, {', '.join(f'w{s} / (w0 + w1 + w2) AS p{s}' for s in STATES)} FROM (SELECT w.* FROM w0 w) w
        UNION ALL SELECT symbol, bar_start, i, {', '.join(f'w{s} / (w0 + w1 + w2)' for s in STATES)} FROM
          (SELECT e.symbol, e.bar_start, e.i, {', '.join(f'({prior[s]}) * e.b{s} AS w{s}' for s in STATES)} FROM p JOIN e ON e.symbol = p.symbol AND e.i = p.i + 1))
      SELECT symbol, CAST(epoch_us(bar_start) * 1000 AS BIGINT) AS timestamp_ns, {', '.join(f'round(p{s}, 6) + 0.0 AS p_{s}' for s in STATES)} FROM p"""


def _path_sql() -> str:
    start = FIXED.start.tolist()
    ways = lambda j: [f"p.d{i} + ln(e.a{i}{j})" for i in STATES]
    pick = lambda w: f"CASE WHEN {w[0]} >= {w[1]} AND {w[0]} >= {w[2]} THEN 0 WHEN {w[1]} >= {w[2]} THEN 1 ELSE 2 END"
    names = [f"d{s}" for s in STATES]
    return f"""WITH RECURSIVE {_parts_sql()},
      p AS (SELECT symbol, bar_start, i, {', '.join(f'ln({start[s]!r}) + ln(b{s}) AS d{s}' for s in STATES)}, 0 AS k0, 0 AS k1, 0 AS k2 FROM e WHERE i = 1
        UNION ALL SELECT e.symbol, e.bar_start, e.i, {', '.join(f"greatest({', '.join(ways(s))}) + ln(e.b{s})" for s in STATES)}, {', '.join(pick(ways(s)) for s in STATES)} FROM p JOIN e ON e.symbol = p.symbol AND e.i = p.i + 1),
      q AS MATERIALIZED (SELECT * FROM p),
      s AS (SELECT symbol, bar_start, i, {pick(names)} AS state, k0, k1, k2 FROM q WHERE (symbol, i) IN (SELECT (symbol, max(i)) FROM q GROUP BY symbol)
        UNION ALL SELECT q.symbol, q.bar_start, q.i, CASE s.state WHEN 0 THEN s.k0 WHEN 1 THEN s.k1 ELSE s.k2 END, q.k0, q.k1, q.k2 FROM s JOIN q ON q.symbol = s.symbol AND q.i = s.i - 1)
      SELECT symbol, CAST(epoch_us(bar_start) * 1000 AS BIGINT) AS timestamp_ns, CAST(state AS INTEGER) AS state FROM s"""


@query(_filter_sql())
def tvtp_filter(spark, d):
    """Probabilities of three states of returns, whose moves depend on the spread."""
    found = markov.filtered(returns(spark, d), FIXED, carry=("timestamp_ns",))
    return rounded(found, ("symbol", "timestamp_ns"), [f"p_{s}" for s in STATES])


@query(_path_sql())
def viterbi_path(spark, d):
    """The likeliest states of the same model."""
    return markov.decoded(returns(spark, d), FIXED, carry=("timestamp_ns",))


def _parameters(spark, model, history):
    """A row for each state: its means, deviations, chances to begin with it and to stay in it without drivers, and the fit's log likelihood."""
    names = model.columns
    stay = model.chances(np.eye(1 + len(model.drivers))[0])
    rows = [
        (s, float(model.start[s]), float(stay[s, s]), *(float(v) for v in model.weights[s] @ model.means[s]), *(float(v) for v in model.weights[s] @ np.sqrt(np.diagonal(model.covariances[s], axis1=1, axis2=2))),
         float(history[-1]) if history else None, len(history))
        for s in range(len(model.start))
    ]
    ddl = ", ".join(["state int", "first double", "stay double", *(f"mean_{c} double" for c in names), *(f"std_{c} double" for c in names), "log_likelihood double", "rounds int"])
    return rounded(spark.createDataFrame(rows, ddl), ("state", "rounds"), [c.split()[0] for c in ddl.split(", ")[1:-1]], 4)


@query()
def hmm_fit(spark, d):
    """Four states of the return and its variance, both standardised, with one matrix of moves: the fitted parameters."""
    df = markov.standard(returns(spark, d).withColumn("log_return", F.coalesce("log_return", F.lit(0.0))), ("log_return", "variance"))
    df = df.select("symbol", "ts", "timestamp_ns", "seq", r("log_return", 9).alias("log_return"), r("variance", 9).alias("variance"))
    start = markov.spread_start(df, ("log_return", "variance"), 4, by="variance", diagonal=True)
    model, history = markov.fit(df, start, rounds=6, tolerance=1e-3)
    return _parameters(spark, model.ordered(1), history)


@query()
def tvtp_fit(spark, d):
    """Three states of mixtures whose moves depend on the spread, from two starts: the fitted parameters, by the mean return."""
    df = markov.standard(returns(spark, d), ("log_return", "spread_avg"))
    df = df.select("symbol", "ts", "timestamp_ns", "seq", r("log_return", 9).alias("log_return"), r("spread_avg", 9).alias("spread_avg"))
    starts = [markov.spread_start(df, ("log_return",), 3, by="log_return", components=2, drivers=("spread_avg",), stay=stay) for stay in (0.5, 0.9)]
    return _parameters(spark, *markov.best_fit(df, starts, rounds=4))


#: Numbers as a fit gives them, of three columns and two components.
FROZEN = whitening.Whitening(
    ("log_return", "spread_avg", "volume"), (-1.5, 0.02, 2.0), (1.5, 0.04, 80.0), (0.01, 0.03, 40.0), (0.5, 0.004, 12.0), (0.05, 0.0, -0.02),
    ((0.6, 0.64, 0.48), (0.8, -0.48, -0.36)), (1.2, 0.8),
)
COLUMNS = FROZEN.columns
_RETURNS = BARS + f", l AS (SELECT *, ln(close / lag(close) OVER ({BW})) AS log_return FROM bars WHERE close > 0)"
_FROZEN_Z = [f"CASE WHEN {c} IS NOT NULL THEN (least(greatest({c}, {a!r}), {b!r}) - {m!r}) / {s!r} - ({o!r}) END" for c, a, b, m, s, o in zip(COLUMNS, FROZEN.low, FROZEN.high, FROZEN.mean, FROZEN.std, FROZEN.centre, strict=True)]


def _three(spark, d):
    return six_hourly(spark, d).where("close > 0").withColumn("log_return", C.log_return())


@query(f"""WITH {_RETURNS} SELECT symbol, bar_start, {', '.join(f"round(({' + '.join(f'({x!r}) * ({z})' for x, z in zip(axis, _FROZEN_Z, strict=True))}) / {s!r}, 6) + 0.0 AS w_{k}"
  for k, (axis, s) in enumerate(zip(FROZEN.axes, FROZEN.scale, strict=True)))} FROM l""")  # fmt: skip
def whitened(spark, d):
    """Components of bars under frozen numbers."""
    found = rounded(FROZEN.apply(_three(spark, d)), BAR_KEYS, ["w_0", "w_1"])
    return found.withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))


def _distance_sql() -> str:
    """Without the axes: squares of components add up to the inverse covariance's square form, here by cofactors."""
    bounded = [f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, q{k}a), q{k}b) END" for k, c in enumerate(COLUMNS)]  # least and greatest pass over nulls
    z = [f"({x} - m{k}) / s{k}" for k, x in enumerate(bounded)]
    bounds = ", ".join(f"quantile_cont({c}, 0.01) AS q{k}a, quantile_cont({c}, 0.99) AS q{k}b" for k, c in enumerate(COLUMNS))
    stats = ", ".join(f"avg({x}) AS m{k}, stddev_samp({x}) AS s{k}" for k, x in enumerate(bounded))
    cov = ", ".join(f"covar_samp(z{i}, z{j}) AS c{i}{j}" for i in range(3) for j in range(i, 3))
    c = lambda i, j: f"c{min(i, j)}{max(i, j)}"
    cofactor = lambda i, j: "({} * {} - {} * {})".format(*(c((i + a) % 3, (j + b) % 3) for a, b in ((1, 1), (2, 2), (1, 2), (2, 1))))
    form = " + ".join(f"(z{i} - o{i}) * (z{j} - o{j}) * {cofactor(i, j)}" for i in range(3) for j in range(3))
    det = " + ".join(f"{c(0, j)} * {cofactor(0, j)}" for j in range(3))
    return f"""WITH {_RETURNS}, t AS (SELECT * FROM l WHERE bar_start < TIMESTAMP '2024-01-21'), q AS (SELECT {bounds} FROM t), s AS (SELECT {stats} FROM t, q),
      z AS (SELECT symbol, bar_start, {', '.join(f'{x} AS z{k}' for k, x in enumerate(z))} FROM l, q, s), o AS (SELECT {', '.join(f'avg(z{k}) AS o{k}' for k in range(3))}, {cov} FROM z
        WHERE bar_start < TIMESTAMP '2024-01-21' AND z0 IS NOT NULL AND z1 IS NOT NULL AND z2 IS NOT NULL) SELECT symbol, bar_start, round(({form}) / ({det}), 4) + 0.0 AS distance FROM z, o"""


@query(_distance_sql())
def whitened_distance(spark, d):
    """How far each bar lies from those before the 21st, in all components of a whitening fitted to those."""
    bars = _three(spark, d)
    model = whitening.fit(bars.where("bar_start < '2024-01-21'"), COLUMNS)
    far = sum((F.col(f"w_{k}") * F.col(f"w_{k}") for k in range(3)), F.lit(0.0))
    return rounded(model.apply(bars), BAR_KEYS, {"distance": far}, 4).withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))


def _rows(spark, d, *columns):
    """Bars as rows in time, with columns that are standardised over all of them."""
    df = _three(spark, d).withColumns({"ts": F.col("bar_start"), "timestamp_ns": F.unix_micros("bar_start") * 1000, "seq": F.lit(0)})
    df = markov.standard(df.withColumn("log_return", F.coalesce("log_return", F.lit(0.0))), columns)
    return df.select("symbol", "ts", "timestamp_ns", "seq", *(r(c, 9).alias(c) for c in columns))


@query()
def jump_kalman(spark, d):
    """Levels of three columns under noise that is fitted anew every 20 bars on the last 60, and where surprises pile up."""
    found = jumps.jump_filter(_rows(spark, d, *COLUMNS), list(COLUMNS), window=60, every=20)
    return rounded(found, ("symbol", "timestamp_ns", "jump"), [*(f"level_{c}" for c in COLUMNS), "piled"], 4)


@query()
def regime_out_of_fold(spark, d):
    """Regimes of bars (wide range, rising, falling) as a forest of earlier bars tells them from other columns, every bar of five folds once."""
    bars = six_hourly(spark, d)
    ratio = (F.col("close") - F.col("open")) / F.col("open")
    wide = (F.col("high") - F.col("low")) / F.col("open") > 1.2
    df = bars.select("symbol", F.col("bar_start").alias("ts"), (F.unix_micros("bar_start") * 1000).alias("timestamp_ns"), F.lit(0).alias("seq"), "volume", "tib", "spread_avg", "open", "close",
      F.when(wide, "wide").when(ratio > 0, "rising").otherwise("falling").alias("regime"))
    rows = splits.numbered_by_day(df)
    n = rows.agg(F.max("row")).first()[0] or 0
    found = trees.out_of_fold(splits.assign(rows, splits.time_series_ranges(n + 1)), ["volume", "tib", "spread_avg", "open", "close"], "regime", trees=10, depth=4)
    return found.select("symbol", "timestamp_ns", "fold", "regime", "predicted")


@query()
def isolated_bars(spark, d):
    """How soon a forest isolates each bar by its return, spread and volume."""
    df = _rows(spark, d, *COLUMNS)
    return rounded(isolation.score(df, isolation.fit(df, COLUMNS)), ("symbol", "timestamp_ns"), ["anomaly"])


@query()
def routed_experts(spark, d):
    """Three guesses of the next return (none, more of the same, a turn), weighted by the posteriors of a mixture over return and spread."""
    df = _rows(spark, d, "log_return", "spread_avg")
    model = isolation.mixture(df, ("log_return", "spread_avg"), 3)
    x = F.col("log_return")
    return rounded(isolation.routed(df, model, ("log_return", "spread_avg"), [F.lit(0.0), 0.5 * x, -0.5 * x]), ("symbol", "timestamp_ns"), ["routed"], 4)


_NAMES = f"""WITH {_RETURNS}, f AS ({_filter_sql()}), g AS (SELECT CASE WHEN p_0 >= p_1 AND p_0 >= p_2 THEN 0 WHEN p_1 >= p_2 THEN 1 ELSE 2 END AS state, log_return
    FROM f JOIN l ON l.symbol = f.symbol AND CAST(epoch_us(l.bar_start) * 1000 AS BIGINT) = f.timestamp_ns),
  s AS (SELECT state, coalesce(variance, 1e9) AS variance, coalesce(drift, 0) AS drift FROM (SELECT CAST(unnest(range(3)) AS INTEGER) AS state)
    LEFT JOIN (SELECT state, var_pop(log_return) AS variance, abs(avg(log_return)) AS drift FROM g GROUP BY 1) USING (state)),
  quiet AS (SELECT state FROM s ORDER BY variance, state LIMIT 1), trend AS (SELECT state FROM s WHERE state NOT IN (FROM quiet) ORDER BY drift DESC, variance DESC, state DESC LIMIT 1)
  SELECT state, round(variance, 6) + 0.0 AS variance, round(drift, 6) + 0.0 AS drift, CASE WHEN state IN (FROM quiet) THEN 'COMPRESSION' WHEN state IN (FROM trend) THEN 'TREND' ELSE 'MEAN_REV' END AS name FROM s"""


@query(_NAMES)
def named_regimes(spark, d):
    """What the states of the model with fixed moves are called, by the returns of the bars that it sees in them."""
    df = returns(spark, d)
    found = rounded(markov.filtered(df, FIXED, carry=("timestamp_ns", "log_return")), ("timestamp_ns", "log_return"), [f"p_{s}" for s in STATES])
    named = regimes.state_names(found.withColumn("state", regimes.likeliest(3)), "state", "log_return")
    return named.select("state", r("variance").alias("variance"), r("drift").alias("drift"), "name")


@query()
def rolling_regimes(spark, d):
    """Three states of mixtures of returns, moved by the spread, fitted anew every 20 bars on the 60 before and judged on the next 20."""
    start = regimes.level_start(("log_return",), 3, components=2, drivers=("spread_avg",))
    found = regimes.walk_forward(returns(spark, d), start, ("log_return",), ("spread_avg",), 3, train=60, test=20, rounds=10, least=40, carry=("timestamp_ns",))
    return rounded(found, ("symbol", "fold", "timestamp_ns", "state", "fitted"), [f"p_{s}" for s in STATES], 4)
