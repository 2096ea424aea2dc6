"""Every library query against its DuckDB counterpart."""

import duckdb
import pytest

from tickloom.plans import catalogue

ORACLE = catalogue.oracle_sql()
#: Columns that their queries round to four digits.
COARSE = {"kf_price", "kf_velocity", "roc_5", "roc_10", "roc_20", "roc_50", "cvd", "change", "z", "p"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{data}/events.parquet')")
    return con


def rows(frame):
    names = sorted(frame.columns)
    return sorted(map(repr, frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False, name=None)))


def near(found, expected):
    """Frames that differ by a last digit of a rounded float still agree."""
    import numpy as np

    for c in expected.columns:
        a, b = found[c], expected[c]
        if b.dtype.kind == "f":
            np.testing.assert_allclose(a.astype(float), b.astype(float), rtol=1e-9, atol=2e-6 if c not in COARSE else 2e-4)
        else:
            assert list(map(str, a)) == list(map(str, b)), c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, data, name):
    found = catalogue.queries()[name](spark, data).toPandas()
    if name not in ORACLE:
        assert len(found)
        return
    expected = duck.execute(ORACLE[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert len(found) == len(expected)
    if rows(found) != rows(expected):
        keys = [c for c in ("symbol", "seq", "timestamp_ns", "bar_start", "day", "fold") if c in found.columns]
        order = {"by": keys, "ignore_index": True}
        near(found.sort_values(**order), expected.sort_values(**order))


def test_as_of_grid_after_a_long_gap(spark):
    from tickloom.operators.bars import as_of_grid

    day = 86_400_000_000_000
    # symbol b has no tick on its grid before the end, and three days without one before it
    rows = [("a", 0, 0, 1.0), ("a", day, 1, 2.0), ("b", 0, 0, 5.0), ("b", day, 1, 6.0), ("b", day, 2, 7.0), ("b", day + 1, 3, None), ("b", 4 * day, 4, 8.0)]
    made = spark.createDataFrame(rows, "symbol string, timestamp_ns long, seq long, mid double")
    found = {(r["symbol"], r["timestamp_ns"]): r["price"] for r in as_of_grid(made, 60_000, 300).collect()}
    want = {}
    for symbol, end in (("a", day), ("b", 4 * day)):
        for at in range(end - 300_000_000_000, end + 1, 60_000_000_000):
            want[symbol, at] = [v for s, t, _, v in rows if s == symbol and t <= at and v is not None][-1]
    assert found == want


def test_fracdiff_full(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from tickloom.plans import bar_queries

    close = 50 + np.random.default_rng(4).normal(size=520).cumsum()
    bars = spark.createDataFrame([("a", k, float(x)) for k, x in enumerate(close)], "symbol string, k long, close double")
    monkeypatch.setattr(bar_queries, "six_hourly", lambda spark, d: bars.select("symbol", F.timestamp_seconds(F.col("k") * 21_600).alias("bar_start"), "close"))
    weights = [1.0]
    while len(weights) < 500 and abs(w := -weights[-1] * (0.45 - len(weights) + 1) / len(weights)) > 1e-5:
        weights.append(w)
    assert len(weights) == 500
    found = [r["fracdiff"] for r in catalogue.queries()["fracdiff_full"](spark, "").orderBy("bar_start").collect()]
    assert found[:499] == [None] * 499
    np.testing.assert_allclose(found[499:], [np.dot(weights, close[k - 499 : k + 1][::-1]) for k in range(499, 520)], atol=2e-6)


def test_entry(spark):
    import __spark_entry__ as entry

    assert "atr" in entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
