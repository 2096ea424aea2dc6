"""Trees, forests, routing and the refitted Kalman filter against plain versions and held-out bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import isolation, jumps, splits, trees


def labelled(spark, n=600, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] > 0.5, "up", np.where(x[:, 1] > 0, "flat", "down"))
    rows = [("a", k, 0, *(float(v) for v in x[k]), str(y[k])) for k in range(n)]
    rows[3] = (*rows[3][:3], None, float("nan"), 0.0, None)
    return spark.createDataFrame(rows, "symbol string, timestamp_ns long, seq long, u double, v double, w double, y string").repartition(3)


def test_trees_keep_their_labels(spark, tmp_path):
    df = labelled(spark)
    train, test = df.where("timestamp_ns < 450"), df.where("timestamp_ns >= 450")
    model = trees.fit(train, ["u", "v", "w"], "y", trees=20)
    trees.save(model, str(tmp_path / "model"))
    again = trees.load(str(tmp_path / "model"))
    assert trees.labels_of(again) == ["down", "flat", "up"]
    found = trees.score(again, test)
    assert found.columns == [*df.columns, "predicted", "p_down", "p_flat", "p_up"]
    rows = found.collect()
    assert sum(r["predicted"] == r["y"] for r in rows) >= 0.9 * len(rows)
    assert rows == trees.score(model, test).collect()
    assert all(abs(r["p_down"] + r["p_flat"] + r["p_up"] - 1) < 1e-9 for r in rows)


def test_weights_count(spark):
    df = labelled(spark).withColumn("risky", ((F.col("u") + F.randn(4)) > 1.2).cast("int"))
    recalled = []
    for weights in (None, {1: 6.0}):
        found = trees.score(trees.fit(df, ["u", "v", "w"], "risky", weights=weights, boosted=True, trees=5, depth=2), df)
        recalled.append(found.where("risky = 1 and predicted = '1'").count())
    assert recalled[1] > recalled[0]


def test_out_of_fold(spark):
    rows = splits.numbered_by_day(labelled(spark))
    assigned = splits.assign(rows, splits.time_series_ranges(600))
    found = trees.out_of_fold(assigned, ["u", "v", "w"], "y", trees=10)
    held = found.select("row", "fold", "y", "predicted").toPandas()
    assert sorted(held["row"]) == list(range(100, 600)) and (held["fold"] == (held["row"] - 100) // 100).all()
    assert (held["y"] == held["predicted"]).mean() >= 0.85
    assert trees.out_of_fold(assigned.where("false"), ["u"], "y").collect() == []


def plain_length(forest, x):
    total = 0.0
    for t in forest.trees:
        at, level = 0, 0
        while t[at][0] >= 0:
            at = int(t[at][2] if x[int(t[at][0])] < t[at][1] else t[at][3])
            level += 1
        total += level + isolation.usual_length(int(t[at][4]))
    return total / len(forest.trees)


def test_isolation_forest(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(900, 2)), [[9.0, 9.0], [-8.0, 7.0]], np.zeros((100, 2))])
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)] + [(-1, None, 1.0), (-2, float("nan"), 1.0)], "id long, a double, b double").repartition(4)
    forest = isolation.fit(df, ("a", "b"), trees=30, sample=64)
    assert len(forest.trees) == 30 and all(t[0][4] <= 64 for t in forest.trees)
    for t in forest.trees:  # children's rows add up
        assert all(n[4] == t[int(n[2])][4] + t[int(n[3])][4] for n in t if n[0] >= 0)
    found = {r["id"]: r["anomaly"] for r in isolation.score(df, forest).collect()}
    assert found[-1] is None and found[-2] is None
    for k in (0, 5, 900, 901, 950):
        assert found[k] == pytest.approx(2.0 ** (-plain_length(forest, x[k]) / isolation.usual_length(64)), abs=1e-12)
    assert set(sorted(range(1002), key=lambda k: -found[k])[:2]) == {900, 901}
    assert [t.tolist() for t in isolation.fit(df.repartition(2), ("a", "b"), trees=30, sample=64).trees] == [t.tolist() for t in forest.trees]
    assert isolation.score(df, isolation.fit(df.where("false"), ("a", "b"))).where("anomaly is not null").count() == 0


def test_routing_is_soft(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(-4, 1, 200), rng.normal(4, 1, 200)])
    df = spark.createDataFrame([(float(v),) for v in x], "a double")
    model = isolation.mixture(df, ("a",), 2)
    found = isolation.routed(df, model, ("a",), [F.lit(1.0), F.lit(2.0)])
    assert found.columns == ["a", "routed"]
    means = [g.mean[0] for g in model.gaussiansDF.collect()]
    for r in found.collect():
        if abs(r["a"]) > 2:
            assert r["routed"] == pytest.approx(1.0 if (r["a"] < 0) == (means[0] < means[1]) else 2.0, abs=0.02)


def test_refit_equals_the_joint_distribution():
    """The sums of a round, from the joint normal distribution of all states and rows."""
    rng = np.random.default_rng(8)
    n, d = 5, 2
    rows = rng.normal(size=(n, d)).cumsum(0)
    q, r = np.array([[0.3, 0.1], [0.1, 0.2]]), np.array([[0.9, -0.2], [-0.2, 0.7]])
    cov = np.zeros((n * d, n * d))
    for i in range(n):
        for j in range(n):
            cov[i * d : (i + 1) * d, j * d : (j + 1) * d] = jumps.UNKNOWN * np.eye(d) + min(i, j) * q
    gain = cov @ np.linalg.inv(cov + np.kron(np.eye(n), r))
    mean, post = (gain @ rows.ravel()).reshape(n, d), cov - gain @ cov
    block = lambda i, j: post[i * d : (i + 1) * d, j * d : (j + 1) * d]
    moved = sum(block(t, t) - block(t, t - 1) - block(t - 1, t) + block(t - 1, t - 1) + np.outer(mean[t] - mean[t - 1], mean[t] - mean[t - 1]) for t in range(1, n)) / (n - 1)
    missed = sum(block(t, t) + np.outer(rows[t] - mean[t], rows[t] - mean[t]) for t in range(n)) / n
    found = jumps.refitted(rows, q, r)
    np.testing.assert_allclose(found[0], moved, atol=1e-4)
    np.testing.assert_allclose(found[1], missed, atol=1e-4)


def test_jump_filter(spark):
    rng = np.random.default_rng(9)
    level = np.concatenate([rng.normal(0, 0.08, (200, 2)), rng.normal(4, 0.08, (80, 2))])
    level[60, 1] = np.nan
    rows = [("a", k, 0, *(float(v) for v in x)) for k, x in enumerate(level)] + [("b", k, 0, float(k), 1.0) for k in range(20)] + [("c", k, 0, float(np.sin(k)), 1.0) for k in range(70)]
    df = spark.createDataFrame(rows, "symbol string, timestamp_ns long, seq long, u double, v double").repartition(3)
    found = {}
    for r in jumps.jump_filter(df, ["u", "v"], window=100, every=30).collect():
        found.setdefault(r["symbol"], {})[r["timestamp_ns"]] = r
    assert {s: len(v) for s, v in found.items()} == {"a": 280, "b": 20, "c": 70}
    # by definition: whole history at hand, fits at rows 101, 131, ... of the whole rows
    whole = [k for k in range(280) if k != 60]
    begin = whole[100]
    f = jumps.Filter(2)
    for k in range(280):
        if k == 0:
            f.fit(level[whole[:100]], 5)
        if k >= begin and (k - begin) % 30 == 0:
            f.fit(level[[w for w in whole if w < k][-100:]], 2)
        at, surprise, jump, piled = f.step(level[k])
        r = found["a"][k]
        np.testing.assert_allclose([r["level_u"], r["level_v"], r["surprise_u"], r["surprise_v"], r["piled"]], [*at, *surprise, piled], atol=1e-12)
        assert r["jump"] == jump
    assert found["a"][200]["jump"] and all(abs(found["a"][k]["level_u"] - 4) < 0.5 for k in range(202, 280))
    assert found["a"][60]["surprise_u"] == 0 and found["a"][60]["level_u"] == found["a"][59]["level_u"]
    assert all(found["b"][k]["level_u"] == k and not found["b"][k]["jump"] for k in range(20))
    assert jumps.jump_filter(df.where("false"), ["u", "v"]).collect() == []
