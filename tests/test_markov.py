"""Hidden Markov models against plain versions over whole sequences."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import markov as M
from tickloom.operators import regimes

COLUMNS, DRIVERS = ("a", "b"), ("z",)


def model(drivers=DRIVERS, s=3, k=2, seed=1, diagonal=False):
    rng = np.random.default_rng(seed)
    root = rng.normal(size=(s, k, 2, 2)) * 0.2 + np.eye(2)
    cov = root @ np.swapaxes(root, 2, 3)
    cov = cov * np.eye(2) if diagonal else cov
    weights = rng.uniform(0.5, 1, (s, k))
    moves = rng.normal(size=(s, s, 1 + len(drivers))) * 0.4
    moves[:, :, 0] += 2 * np.eye(s)
    return M.Markov(COLUMNS, np.full(s, 1 / s), weights / weights.sum(1, keepdims=True), rng.normal(size=(s, k, 2)) * 2, cov, moves, drivers, diagonal)


def table(lengths=(90, 1, 37), seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for symbol, n in zip("xyw", lengths, strict=True):
        state = 0
        for i in range(n):
            state = state if rng.random() < 0.8 else int(rng.integers(3))
            a, b = (float(v) for v in rng.normal(size=2) + [2 * state - 2, state])
            rows.append((symbol, 1_000_000_000 * 5000 * i, i, a if i % 11 else None, math.nan if i % 17 == 5 else b, float(rng.normal()) if i % 7 else None))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "symbol string, timestamp_ns long, seq long, a double, b double, z double")
    return df.withColumn("ts", F.timestamp_seconds(F.col("timestamp_ns") / 1_000_000_000)).repartition(3)


def sequences(rows, drivers):
    out = defaultdict(list)
    for symbol, _, seq, a, b, z in rows:
        out[symbol].append((seq, None if a is None or b is None or math.isnan(b) else np.array([a, b]), np.array([1.0, *([z or 0.0] if drivers else [])])))
    return out


def density(m, x):
    """By state and component."""
    out = np.zeros(m.weights.shape)
    for s in range(out.shape[0]):
        for k in range(out.shape[1]):
            d = x - m.means[s, k]
            out[s, k] = m.weights[s, k] * math.exp(-0.5 * d @ np.linalg.solve(m.covariances[s, k], d)) / math.sqrt(np.linalg.det(2 * math.pi * m.covariances[s, k]))
    return out


def softmax(m, c):
    e = np.exp(m.moves @ c)
    return e / e.sum(1, keepdims=True)


def plain(m, rows):
    """Whole sequences by definition: filtered, smoothed, moves, log likelihood."""
    out = {}
    for symbol, seq in sequences(rows, m.drivers).items():
        b = [np.ones(len(m.start)) if x is None else density(m, x).sum(1) for _, x, _ in seq]
        a = [softmax(m, c) for _, _, c in seq]
        n, f, ll = len(seq), [], 0.0
        p = m.start
        for t in range(n):
            w = p * b[t]
            ll += math.log(w.sum())
            f.append(w / w.sum())
            p = f[-1] @ a[t]
        back, post, pairs = np.ones(len(m.start)), [None] * n, [None] * n
        for t in range(n - 1, -1, -1):
            if t < n - 1:
                both = f[t][:, None] * a[t] * (b[t + 1] * back)[None]
                pairs[t] = both / both.sum()
                back = a[t] @ (b[t + 1] * back)
                back = back / back.sum()
            g = f[t] * back
            post[t] = g / g.sum()
        out[symbol] = f, post, pairs, a, ll
    return out


def plain_round(m, rows, floor, ridge):
    """One round of expectation and maximisation; returns the next model and the log likelihood."""
    found, seqs = plain(m, rows), sequences(rows, m.drivers)
    s, k = m.weights.shape
    start, ll = np.zeros(s), 0.0
    w, items = [], []
    slope, squares, pairs_of = np.zeros(m.moves.shape), np.zeros((s, m.moves.shape[2], m.moves.shape[2])), np.zeros((s, s))
    for symbol, (_, post, pairs, a, part) in found.items():
        ll += part
        start += post[0]
        for t, (_, x, c) in enumerate(seqs[symbol]):
            if x is not None:
                d = density(m, x)
                total = d.sum(1, keepdims=True)  # a state that cannot be underflows to 0
                w.append(post[t][:, None] * np.where(total > 0, d / np.where(total > 0, total, 1), 1 / k))
                items.append(x)
            if pairs[t] is not None:
                pairs_of += pairs[t]
                for i in range(s):
                    slope[i] += np.outer(pairs[t][i] - post[t][i] * a[t][i], c)
                    squares[i] += post[t][i] * np.outer(c, c)
    w, items = np.array(w), np.array(items)
    means, cov = m.means.copy(), m.covariances.copy()
    for i in range(s):
        for j in range(k):
            q = w[:, i, j]
            means[i, j] = q @ items / q.sum()
            d = items - means[i, j]
            c = (q[:, None] * d).T @ d / q.sum()
            if m.diagonal:
                cov[i, j] = np.diag(np.maximum(np.diag(c), floor))
            else:
                values, vectors = np.linalg.eigh(c)
                cov[i, j] = vectors @ np.diag(np.maximum(values, floor)) @ vectors.T
    moves = m.moves.copy()
    for i in range(s):
        if m.drivers:
            bound = np.kron(0.5 * (np.eye(s) - 1 / s), squares[i]) + ridge * np.eye(s * m.moves.shape[2])
            moves[i] += np.linalg.solve(bound, (slope[i] - ridge * moves[i]).ravel()).reshape(s, -1)
        else:
            moves[i, :, 0] = np.log(pairs_of[i] / pairs_of[i].sum())
    mass = w.sum(0)
    return M.Markov(m.columns, start / start.sum(), mass / mass.sum(1, keepdims=True), means, cov, moves, m.drivers, m.diagonal), ll


@pytest.mark.parametrize("rows_a_chunk", [1, 7, 512])
def test_probabilities_and_paths(spark, rows_a_chunk):
    m, rows = model(), table()
    df, want, seqs = frame(spark, rows), plain(m, rows), sequences(rows, m.drivers)
    for part, name in ((0, "filtered"), (1, "smoothed")):
        found = {(r["symbol"], r["seq"]): [r[f"p_{s}"] for s in range(3)] for r in getattr(M, name)(df, m, rows=rows_a_chunk).collect()}
        assert len(found) == len(rows)
        for symbol, parts in want.items():
            np.testing.assert_allclose([found[symbol, i] for i in range(len(parts[part]))], parts[part], atol=1e-9)
    states = {(r["symbol"], r["seq"]): r["state"] for r in M.decoded(df, m, rows=rows_a_chunk).collect()}
    for symbol, seq in seqs.items():
        b = [np.zeros(3) if x is None else np.log(density(m, x).sum(1)) for _, x, _ in seq]
        score, back = np.log(m.start) + b[0], []
        for t in range(1, len(seq)):
            ways = score[:, None] + np.log(softmax(m, seq[t - 1][2]))
            back.append(ways.argmax(0))
            score = ways.max(0) + b[t]
        path = [int(score.argmax())]
        for p in reversed(back):
            path.append(int(p[path[-1]]))
        assert [states[symbol, i] for i in range(len(seq))] == path[::-1]


@pytest.mark.parametrize(("drivers", "diagonal", "k"), [((), True, 1), (DRIVERS, False, 2)])
def test_fit(spark, drivers, diagonal, k):
    start, rows = model(drivers, k=k, diagonal=diagonal), table()
    found, history = M.fit(frame(spark, rows), start, rounds=4, tolerance=-1.0, floor=1e-3, ridge=1e-3, rows=16)
    want = start
    for ll in history:
        want, own = plain_round(want, rows, 1e-3, 1e-3)
        assert abs(own - ll) < 1e-6
    for name in ("start", "weights", "means", "covariances", "moves"):
        np.testing.assert_allclose(getattr(found, name), getattr(want, name), atol=1e-6)
    assert all(b > a for a, b in zip(history, history[1:], strict=False))
    ordered = found.ordered(0)
    assert (np.diff(ordered.means[:, 0, 0]) >= 0).all()


def test_nothing_to_fit(spark):
    m = model()
    assert M.fit(frame(spark, []), m, rounds=2)[1] == []
    assert M.filtered(frame(spark, []), m).collect() == [] and M.decoded(frame(spark, []), m).collect() == []


def test_walk_forward(spark):
    """Every fold against plain rounds over its own training rows, and plain probabilities of its tested rows."""
    train, test, rounds, least = 30, 12, 3, 20
    rows = table((90, 5, 37))
    first = model()
    found = regimes.walk_forward(frame(spark, rows), lambda x: first, COLUMNS, DRIVERS, 3, train, test, rounds=rounds, least=least).toPandas()
    seen = 0
    for symbol in "xyw":
        own = [r for r in rows if r[0] == symbol]
        for fold, begin in enumerate(range(train, len(own), test)):
            part = own[begin - train : begin + test]
            x = np.array([[np.nan if v is None else v for v in r[3:5]] for r in part], float)
            clean = x[:train][~np.isnan(x[:train]).any(1)]
            assert len(clean) >= least
            x = (x - clean.mean(0)) / clean.std(0)
            part = [(*r[:3], *(None if math.isnan(v) else float(v) for v in z), r[5]) for r, z in zip(part, x, strict=True)]
            m = first
            for _ in range(rounds):
                m, _ = plain_round(m, part[:train], 1e-3, 1e-3)
            m = m.ordered()
            want = np.array(plain(m, part[train:])[symbol][0])
            got = found[(found["symbol"] == symbol) & (found["fold"] == fold)].sort_values("seq")
            assert list(got["seq"]) == [r[2] for r in part[train:]] and got["fitted"].all()
            np.testing.assert_allclose(got[["p_0", "p_1", "p_2"]].to_numpy(), want, atol=1e-6)
            b = [np.ones(3) if v is None else density(m, v).sum(1) for _, v, _ in sequences(part[train:], DRIVERS)[symbol]]
            a = [softmax(m, c) for _, _, c in sequences(part[train:], DRIVERS)[symbol]]
            score, back = np.log(m.start) + np.log(b[0]), []
            for t in range(1, len(b)):
                ways = score[:, None] + np.log(a[t - 1])
                back.append(ways.argmax(0))
                score = ways.max(0) + np.log(b[t])
            path = [int(score.argmax())]
            for step in reversed(back):
                path.append(int(step[path[-1]]))
            assert list(got["state"]) == path[::-1]
            seen += len(got)
    assert seen == len(found) == 60 + 7

    none = regimes.walk_forward(frame(spark, rows), lambda x: first, COLUMNS, DRIVERS, 3, train, test, least=31).toPandas()
    assert len(none) == seen and not none["fitted"].any() and none["state"].isna().all() and (none["p_1"] == 1 / 3).all()
    with pytest.raises(ValueError):
        regimes.rolling(frame(spark, rows), 0, 5)


def test_level_start_and_names(spark):
    x = np.array([[3.0], [np.nan], [1.0], [2.0], [6.0]])
    start = regimes.level_start(("a",), 2, stay=0.8)(x)
    assert start.means.ravel().tolist() == [1.5, 4.5] and np.allclose(np.exp(start.moves[:, :, 0]), [[0.8, 0.2], [0.2, 0.8]])

    def names(rows):
        df = spark.createDataFrame(rows, "state int, v double")
        return [r["name"] for r in regimes.state_names(df, "state", "v").orderBy("state").collect()]

    assert names([(0, 5.0), (0, 7.0), (1, 1.0), (1, 1.1), (2, -9.0), (2, 0.0)]) == ["TREND", "COMPRESSION", "MEAN_REV"]
    assert names([(0, 4.0), (0, 6.0), (1, 1.0), (1, 1.1), (2, -9.0), (2, -1.0), (2, None)]) == ["MEAN_REV", "COMPRESSION", "TREND"]  # equal drift
    assert names([(0, 1.0)]) == ["COMPRESSION", "MEAN_REV", "TREND"]  # states without rows
    assert names([]) == ["COMPRESSION", "MEAN_REV", "TREND"]
