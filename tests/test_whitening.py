"""Exact quantiles and whitening against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import quantiles as Q
from tickloom.operators import whitening as W


@pytest.mark.parametrize("small", [10_000, 5])
def test_quantiles(spark, monkeypatch, small):
    monkeypatch.setattr(Q, "SMALL", small)
    rng = np.random.default_rng(3)
    a = rng.normal(size=3000)
    b = np.where(rng.random(3000) < 0.45, 1.0, np.where(rng.random(3000) < 0.8, 2.0, rng.random(3000) * 3))  # two values hold most rows
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b, strict=True)], "a double, b double, c double").repartition(7)
    shares = [0, 0.01, 0.25, 0.4999, 0.5, 0.9, 1]
    found = Q.quantiles(df, ["a", "b", "c"], shares)
    np.testing.assert_allclose(found["a"], np.quantile(a, shares), rtol=1e-12)
    np.testing.assert_allclose(found["b"], np.quantile(b, shares), rtol=1e-12)
    assert found["c"] == [None] * 7
    assert Q.quantiles(df.where("a > 99"), ["a"], [0.5]) == {"a": [None]}


def test_whitening(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) @ np.array([[2, 0.3, 0], [0, 1, 0.5], [0, 0, 0.1]]) + [5, -1, 0]
    rows = [tuple(map(float, v)) for v in x]
    df = spark.createDataFrame([*rows, (None, 1.0, 2.0), (float("nan"), 1.0, 2.0)], "a double, b double, c double").repartition(3)
    model = W.fit(df, ("a", "b", "c"))
    out = np.array([[r[f"w_{k}"] for k in range(3)] for r in model.apply(df).where(F.col("w_0").isNotNull()).collect()])
    assert out.shape == (400, 3)
    np.testing.assert_allclose(out.mean(0), 0, atol=1e-9)
    np.testing.assert_allclose(np.cov(out.T), np.eye(3), atol=1e-5)
    model.save(spark, str(tmp_path / "model"))
    assert W.Whitening.load(spark, str(tmp_path / "model")) == model
    far = spark.createDataFrame([(1e9, -1e9, 0.0)], "a double, b double, c double")
    assert (model.low[0], model.high[0]) == pytest.approx(tuple(np.quantile(x[:, 0], [0.01, 0.99])), rel=1e-12)
    z = (np.array([model.high[0], model.low[1], 0.0]) - model.mean) / np.array(model.std) - model.centre
    np.testing.assert_allclose([model.apply(far).first()[f"w_{k}"] for k in range(3)], np.array(model.axes) @ z / model.scale, rtol=1e-9)
    few = W.fit(df.limit(4), ("a", "b"))
    assert few.axes == ((1.0, 0.0), (0.0, 1.0)) and few.scale == (1.0, 1.0)
    assert W.fit(df.where("a > 99"), ("a",)).apply(far.limit(0)).collect() == []
