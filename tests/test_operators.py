"""Stateful operators and sources against plain versions, where SQL cannot express them."""

import itertools
import lzma
import struct
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import recurrences as R
from tickloom.operators.clean import TickGate
from tickloom.sources import files, sinks
from tickloom.sources.ticks import read_ticks


def test_tick_gate(spark):
    rng = np.random.default_rng(2)
    mids = 1.1 + np.cumsum(rng.normal(0, 1e-5, 300))
    mids[[40, 90, 91]] += 0.01
    rows = [("a", k, int(1000 * k if k % 37 else 1000 * (k - 2)), float(m - 5e-5 * (k % 45 != 7)), float(m + 5e-5 * (k % 45 != 7))) for k, m in enumerate(mids)]
    kept, last_ns, last_mid = [], -(1 << 62), None
    for _, k, ns, bid, ask in rows:
        mid, past = (bid + ask) / 2, [m for _, m in kept[-60:]]
        ok = ns > last_ns and 0 < ask - bid <= 0.002
        if ok and len(past) >= 10:
            spread = median(abs(m - median(past)) for m in past)
            ok = abs(mid - last_mid) <= 5 * (spread if spread >= 1e-6 else 1e-5)
        if ok:
            kept.append((k, mid))
            last_ns, last_mid = ns, mid
    made = spark.createDataFrame(rows, "symbol string, seq long, timestamp_ns long, bid double, ask double")
    assert sorted(r["seq"] for r in TickGate().apply(made).collect()) == [k for k, _ in kept]
    assert 100 < len(kept) < 300


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000])
def test_blocks_of_any_size_agree(size):
    rng = np.random.default_rng(4)
    x = 100 + np.cumsum(rng.normal(0, 0.05, 1000)) + (np.arange(1000) > 500) * 2
    for op, columns in ((R.Ema("x", 9), [x]), (R.Cusum("x"), [x]), (R.Kalman(), [x, rng.uniform(0, 0.1, 1000)]), (R.DailyGuard(100.0, 0.01, 0.5, 2.0), [x, np.arange(1000) // 90])):
        whole = op.block(op.start(), *columns)
        state, parts = op.start(), []
        for a in range(0, 1000, size):
            parts.append(op.block(state, *(c[a : a + size] for c in columns)))
        for k, w in enumerate(whole):
            joined = np.concatenate([p[k] for p in parts])
            assert all(map(np.isclose, joined, w)) if w.dtype.kind == "f" else joined.tolist() == w.tolist()


def test_feature_vector_holds_the_features(spark, data):
    from tickloom.plans import catalogue

    queries = catalogue.queries()
    vectors = {(r["symbol"], r["seq"]): r["features"] for r in queries["feature_vector"](spark, data).collect()}
    assert {len(v) for v in vectors.values()} == {128}
    for r in queries["tib_window"](spark, data).collect():
        assert vectors[r["symbol"], r["seq"]][32:36] == pytest.approx([r["tib"], r["cib"], r["up_share"], r["down_share"]], abs=2e-5)
    for r in queries["momentum"](spark, data).collect():
        assert vectors[r["symbol"], r["seq"]][45:47] == pytest.approx([r["momentum_5"], r["momentum_20"]], abs=2e-5)


@pytest.mark.parametrize(("horizon", "chunk"), [(50, 20_000), (50, 50), (900, 100), (2, 7), (10_000, 20_000)])
def test_triple_barrier_over_chunks(spark, horizon, chunk):
    from tickloom.operators import labels

    rng = np.random.default_rng(8)
    x = 100 + np.cumsum(rng.normal(0, 1, 400))
    wide = rng.uniform(1e-5, 4e-4, 400)
    made = spark.createDataFrame([("a", k, 0, float(v), None if k % 50 == 7 else float(w)) for k, (v, w) in enumerate(zip(x, wide, strict=True))], "symbol string, timestamp_ns long, seq long, p double, v double")
    want = {}
    for k in range(400):
        width = 2 * np.sqrt(wide[k])
        touched = [] if k % 50 == 7 else [1 if v >= x[k] * (1 + width) else -1 for v in x[k + 1 : k + horizon] if v >= x[k] * (1 + width) or v <= x[k] * (1 - width)]
        want[k] = touched[0] if touched else 0
    found = labels.triple_barrier(made, "p", "v", horizon=horizon, chunk_rows=chunk)
    assert found.columns == [*made.columns, "label"]
    assert {r["timestamp_ns"]: r["label"] for r in found.collect()} == want


def test_risk_window_over_chunks(spark):
    from tickloom.operators import labels

    steps = np.random.default_rng(9).normal(0, 0.004, 330)
    made = spark.createDataFrame([("a", k, 0, float(v)) for k, v in enumerate(steps)], "symbol string, timestamp_ns long, seq long, r double")
    want = {}
    for k in range(330 - 10 - 37 + 1):
        level = np.exp(np.concatenate([[0], np.cumsum(steps[k + 10 : k + 47])]))
        want[k] = int(((np.maximum.accumulate(level) - level) / np.maximum.accumulate(level)).max() * 5000 > 100)
    found = labels.risk_window(made, "r", length=37, limit=100.0, chunk_rows=50).collect()
    assert {r["timestamp_ns"]: r["risky"] for r in found} == want and 0 < sum(want.values()) < len(want)


@pytest.mark.parametrize("including", [True, False])
def test_expanding_bounds(including):
    x = np.concatenate([np.random.default_rng(2).normal(size=1500), np.repeat(0.5, 300), [np.nan, 9.0, np.nan, -9.0], np.arange(200.0)])
    op = R.ExpandingBounds("x", 0.1, 0.75, including)
    for blocks in (1, 7):
        state = op.start()
        found = np.concatenate([np.stack(op.block(state, part)) for part in np.array_split(x, blocks)], axis=1)
        for k in range(len(x)):
            past = x[: k + including]
            past = past[~np.isnan(past)]
            want = np.quantile(past, [0.1, 0.75]) if len(past) else [np.nan] * 2
            np.testing.assert_allclose(found[:, k], want, rtol=1e-12)


def test_chunks_shorter_than_a_frame_are_an_error(spark):
    from tickloom.operators import splits

    made = spark.createDataFrame([("a", 0, 0)], "symbol string, timestamp_ns long, seq long")
    with pytest.raises(ValueError, match="shorter"):
        splits.chunked(made, 15, 5)


def test_ticks_round_trip(spark, tmp_path):
    rows = [("EURUSD", k, 86_400_000_000_000 * (k // 4) + k, 1.0 + k, 1.1 + k, 0.5, 1) for k in range(12)]
    made = spark.createDataFrame(rows, "symbol string, seq long, timestamp_ns long, bid double, ask double, delta_t double, sign tinyint")
    made = made.withColumn("ts", F.timestamp_micros(F.expr("timestamp_ns div 1000")))
    made = made.select("symbol", "seq", "timestamp_ns", "ts", "bid", "ask", "delta_t", "sign")
    made.write.parquet(str(tmp_path / "t"))
    found = read_ticks(spark, str(tmp_path / "t"), "eurusd", "1970-01-02", "1970-01-03")
    assert sorted(r["seq"] for r in found.collect()) == [4, 5, 6, 7]
    assert read_ticks(spark, str(tmp_path / "t"), "gbpusd").count() == 0


def hour_file(rows):
    return lzma.compress(b"".join(struct.pack(">3I2f", *r) for r in rows) + b"half")


def test_hourly_files(spark, tmp_path):
    """Months count from 0; crossed and zero quotes, broken files and broken last records give nothing."""
    folder = tmp_path / "EURUSD" / "2024" / "00" / "02"
    folder.mkdir(parents=True)
    (folder / "05h_ticks.bi5").write_bytes(hour_file([(5, 110_010, 110_000, 1, 2), (9, 109_990, 110_000, 1, 2), (12, 5, 0, 1, 2), (3_599_999, 110_020, 110_020, 1, 2)]))
    (folder / "06h_ticks.bi5").write_bytes(b"no archive")
    hour = 1_704_171_600 * 10**9
    want = [(hour + 5_000_000, 1.1, 1.1001), (hour + 3_599_999_000_000, 1.1002, 1.1002)]
    found = files.read_hourly(spark, str(tmp_path)).orderBy("timestamp_ns").collect()
    assert [(r["timestamp_ns"], round(r["bid"], 6), round(r["ask"], 6)) for r in found] == want
    spark.dataSource.register(files.HourlySource)
    read = spark.read.format("hourly_ticks").options(folder=str(tmp_path), symbol="eurusd", start="2024-01-02", end="2024-01-03").load()
    assert [(r["timestamp_ns"], round(r["bid"], 6), round(r["ask"], 6)) for r in read.orderBy("timestamp_ns").collect()] == want
    every = files.hours(spark, ["eurusd"], "2024-01-31", "2024-02-02").collect()
    assert len(every) == 48 and every[0]["path"] == "EURUSD/2024/00/31/00h_ticks.bi5"
    assert {r["path"] for r in every if r["day"].month == 2 and r["hour"] == 23} == {"EURUSD/2024/01/01/23h_ticks.bi5"}


def test_bar_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DateTime,Open,Close\n1704067200000,1,2\n1704070800000,3,4\n1704074400000,5,x\n")
    found = files.read_bars_csv(spark, str(tmp_path / "a.csv"), "2024-01-01 01:00:00", "2024-01-01 02:00:00").orderBy("bar_start").collect()
    assert [(r["bar_start"].hour, r["open"], r["close"]) for r in found] == [(1, 3.0, 4.0), (2, 5.0, None)]
    raw = spark.createDataFrame([("a", 110_000, 5, 20, -3, 60, 7)], "symbol string, low long, delta_open long, delta_high long, delta_close long, minutes long, volume long")
    r = files.trendbars(raw).first()
    assert (r["open"], r["high"], r["low"], r["close"]) == pytest.approx((1.10005, 1.1002, 1.1, 1.09997))


def test_written_tables(spark, tmp_path):
    import hashlib

    from tickloom.schema import feature_columns

    rows = [("A", k, k, k, [float(k), 1.0, 2.0]) for k in range(6)]
    made = spark.createDataFrame(rows, "symbol string, seq long, timestamp_ns long, s long, v array<double>").withColumn("ts", F.timestamp_seconds(F.col("s") * 43_200)).drop("s")
    sinks.write_ticks(made.drop("v"), str(tmp_path / "ticks"))
    assert len(list((tmp_path / "ticks" / "symbol=A").iterdir())) == 3
    assert spark.read.parquet(str(tmp_path / "ticks")).count() == 6
    sinks.write_features(made.drop("ts"), str(tmp_path / "f"), "v", 3)
    back = spark.read.parquet(str(tmp_path / "f"))
    assert feature_columns(back, width=3) == ["f_0", "f_1", "f_2"] and back.agg(F.sum("f_0")).first()[0] == 15
    key = sinks.cache_key(made, stride=1)
    assert key == sinks.cache_key(made.orderBy(F.desc("seq")), stride=1) != sinks.cache_key(made, stride=2)
    assert key != sinks.cache_key(made.withColumn("seq", F.when(F.col("seq") == 3, 9).otherwise(F.col("seq"))), stride=1)
    sinks.write_json(made.select("symbol", "seq"), str(tmp_path / "j"))
    sinks.write_csv(made.select("symbol", "seq"), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.csv(str(tmp_path / "c"), header=True).count() == 6
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "model.bin").write_bytes(b"weights")
    (tmp_path / "m" / "other.bin").write_bytes(b"x")
    want = hashlib.sha256(b"weights").hexdigest()
    named = {r["name"]: r["sha256"] for r in sinks.manifest(spark.read.format("binaryFile").load(str(tmp_path / "m"))).collect()}
    assert named["model.bin"] == want
    assert {r["path"].rsplit("/", 1)[1]: r["ok"] for r in files.verified(spark, str(tmp_path / "m"), {"model.bin": want}).collect()} == {"model.bin": True, "other.bin": False}
    lines = {r["line"] for r in sinks.report_lines(spark.createDataFrame([("k", 1.5, 2)], "key string, sharpe double, n long"), "key").collect()}
    assert lines == {"sharpe = 1.5", "n = 2"}


def test_params_and_schema(spark):
    from tickloom import schema
    from tickloom.params import Params

    assert Params().override({"splits": "8"}, {"splits": 9}).splits == 9
    with pytest.raises(KeyError):
        Params().override({"unknown": 1})
    with pytest.raises(ValueError):
        schema.require(spark.range(1), "id string")
    assert schema.require(spark.range(1), "id bigint").count() == 1


@pytest.mark.parametrize("size", [1, 3, 50, 1000])
def test_marked_returns(size):
    rng = np.random.default_rng(9)
    n = 700
    close = 100 + rng.normal(0, 1, n).cumsum()
    high, low = close + rng.exponential(0.5, n), close - rng.exponential(0.5, n)
    side = rng.choice([0, 0, 0, 1, -1], n)
    side[0] = 1  # the first bar opens nothing
    columns = [high, low, close, side, close - 3 * side, close + 2 * side, rng.uniform(0.1, 1, n)]
    want, held = [None], None
    for k in range(1, n):
        gain = 0.0
        if held is not None:
            d, stop, target, part = held
            worst, best = (low[k], high[k]) if d == 1 else (-high[k], -low[k])
            price, over = close[k], True
            if worst <= d * stop:
                price = stop
            elif best >= d * target:
                price = target
            else:
                over = False
            gain = part * d * (price - close[k - 1]) / close[k - 1]
            held = None if over else held
        if held is None and side[k]:
            held = tuple(c[k] for c in columns[3:])
        want.append(gain)
    op = R.MarkedReturns()
    state = op.start()
    found = np.concatenate([op.block(state, *(c[a : a + size] for c in columns))[0] for a in range(0, n, size)])
    assert np.isnan(found[0])
    np.testing.assert_allclose(found[1:], want[1:], atol=1e-12)
    assert np.count_nonzero(found[1:]) > 300


def test_risk_decisions(spark):
    from tickloom.operators.risk import RiskLimits, decide

    rng = np.random.default_rng(5)
    limits = RiskLimits(window=20, least_outcomes=6, daily=0.02, total=0.05)
    pnl = [None if k % 9 == 4 else float(x) for k, x in enumerate(rng.normal(0, 15, 120))]
    rows = [("a", 21_600 * k, float(p), x, 1 if k % 2 else -1, k % 6 == 1, k % 5) for k, (p, x) in enumerate(zip(rng.uniform(0.5, 0.9, 120), pnl, strict=True))]
    made = spark.createDataFrame(rows, "symbol string, s long, p double, pnl double, direction int, held boolean, n_open int")
    made = made.withColumns({"at": F.timestamp_seconds("s"), "atr": F.lit(0.5), "price": F.lit(100.0), "scale": F.lit(0.8), "regime": F.lit("TREND")})
    found = {r["s"]: r for r in decide(made, "at", limits=limits).collect()}
    equity = peak = limits.initial
    day = begin = halt = None
    past, vetoes = [], set()
    for _, s, p, x, direction, held, n_open in rows:
        r = found[s]
        veto = halt or ("probability" if p < 0.65 else "full" if n_open >= 3 else "held" if held else None)
        assert (r["veto"], round(r["equity"], 6)) == (veto, round(equity, 6))
        vetoes.add(veto)
        if veto is None:
            last = past[-20:]
            wins = [v for v in last if v > 0]
            if len(last) >= 6:
                odds = sum(wins) / max(len(wins), 1) / max(-sum(v for v in last if v <= 0) / max(len(last) - len(wins), 1), 1e-10)
                full = (len(wins) / len(last) * odds - 1 + len(wins) / len(last)) / max(odds, 1e-10)
            else:
                full = 2 * p - 1
            fraction = 0.8 * min(0.02, max(0, full * 0.25))
            assert [r[c] for c in ("fraction", "units", "stop_loss", "take_profit")] == pytest.approx(
                [fraction, fraction * equity / 1.5, 100 - 1.5 * direction, 100 + 4 * direction]
            )
        if x is not None:
            equity += x
            past.append(x)
            peak = max(peak, equity)
            if day != s // 86_400:
                day, begin = s // 86_400, equity
            halt = "total" if equity / peak - 1 < -0.05 else "daily" if equity / begin - 1 < -0.02 else halt
    assert {None, "probability", "full", "held"} < vetoes
