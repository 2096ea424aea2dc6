"""Hidden Markov models that are fitted anew as time goes on, and names for their states.

A fold is a block of rows to judge and the rows before it to learn from. Both are of fixed length, so that a fold is a
small group, and every fold of every symbol is fitted at once, each in its own task; a row is in as many folds as
training blocks overlap it. Nothing of a fold's parameters, scales included, comes from rows it is tested on or later ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.markov import Block, Markov, fit_sequence
from tickloom.operators.splits import numbered_by_day

#: A model to start from, given training rows (n, columns) that are standardised and may hold NaN.
Start = Callable[[np.ndarray], Markov]


def rolling(df: DataFrame, train: int, test: int) -> DataFrame:
    """Rows by ``fold`` with ``tested``: a fold tests ``test`` rows of a symbol (its last fold maybe fewer) after ``train`` to learn from.

    Folds follow each other without a gap from row ``train`` on; the rows before are never tested.
    """
    if train < 1 or test < 1:
        raise ValueError("a fold learns from one row at least, and tests one at least")
    row = F.col("row")
    first = F.greatest(F.lit(0), F.floor((row - train) / test))  # the fold that tests the row, or the first one
    placed = numbered_by_day(df).withColumn("fold", F.explode(F.sequence(first.cast("int"), F.floor(row / test).cast("int"))))
    return placed.withColumn("tested", row >= train + F.col("fold") * test)


def walk_forward(
    df: DataFrame, start: Start, columns: tuple[str, ...], drivers: tuple[str, ...], states: int, train: int, test: int, rounds: int = 20, least: int = 60, carry: tuple[str, ...] = ("timestamp_ns", "seq")
) -> DataFrame:
    """(symbol, fold, ``carry``, p_0, ..., state, fitted) of each tested row: filtered probabilities, and the likeliest path of its block.

    Columns are standardised by a fold's training rows. With fewer than ``least`` training rows without a null or NaN
    nothing is fitted: the states are equally likely, ``state`` is null and ``fitted`` false. States are in the order of the
    first column's means in a fold's model.
    """
    names = list(dict.fromkeys((*columns, *drivers)))
    rows = rolling(df, train, test).select("symbol", "fold", "row", "tested", *carry, *(F.col(c).cast("double").alias(f"v_{c}") for c in names))
    types = dict(rows.dtypes)
    schema = ", ".join(["symbol string", "fold int", *(f"`{c}` {types[c]}" for c in carry), *(f"p_{s} double" for s in range(states)), "state int", "fitted boolean"])
    x, c = [f"v_{n}" for n in columns], [f"v_{n}" for n in drivers]
    outputs = [f"p_{s}" for s in range(states)]

    def judge(fold: pd.DataFrame) -> pd.DataFrame:
        fold = fold.sort_values("row", ignore_index=True)
        asked = fold["tested"].to_numpy(bool)
        out = fold.loc[asked, ["symbol", "fold", *carry]].reset_index(drop=True)
        values = fold[x].to_numpy(float)
        past = values[~asked]
        clean = ~np.isnan(past).any(1)
        if not len(out) or clean.sum() < max(least, 1):
            return out.assign(**dict.fromkeys(outputs, 1 / states), state=pd.array([None] * len(out), "Int32"), fitted=False)
        mean, std = past[clean].mean(0), past[clean].std(0)
        values = (values - mean) / np.where(std > 0, std, 1.0)
        given = fold[c].to_numpy(float)
        model, _ = fit_sequence(values[~asked], given[~asked], start(values[~asked]), rounds=rounds)
        model = model.ordered()
        block = Block(model, pd.DataFrame({"x": [values[asked].ravel()], "c": [given[asked].ravel()]}))
        p = block.filtered(model.start[None])[0]
        with np.errstate(divide="ignore"):
            before = np.log(model.start)
        best, _ = block.longest_paths()
        last = int((before[:, None] + best[0]).max(0).argmax())
        path = block.path(before[None], np.array([last]))[0]
        return out.assign(**dict(zip(outputs, p.T, strict=True)), state=pd.array(path, "Int32"), fitted=True)

    return rows.groupBy("symbol", "fold").applyInPandas(judge, schema)


def level_start(columns: tuple[str, ...], states: int, components: int = 1, drivers: tuple[str, ...] = (), stay: float = 0.9) -> Start:
    """Starts whose states are equal shares of the training rows by the first column, and components a state's shares in turn."""

    def start(x: np.ndarray) -> Markov:
        clean = x[~np.isnan(x).any(1)]
        shares = np.array_split(clean[np.argsort(clean[:, 0], kind="stable")], states * components)
        d = len(columns)
        means = np.array([v.mean(0) if len(v) else clean.mean(0) for v in shares]).reshape(states, components, d)
        spread = np.broadcast_to(np.diag(np.maximum(clean.var(0), 1e-3)), (states, components, d, d)).copy()
        chances = np.where(np.eye(states, dtype=bool), stay if states > 1 else 1.0, (1 - stay) / max(1, states - 1))
        moves = np.zeros((states, states, 1 + len(drivers)))
        moves[:, :, 0] = np.log(chances)
        return Markov(columns, np.full(states, 1 / states), np.full((states, components), 1 / components), means, spread, moves, drivers)

    return start


# The names of three states.
QUIET, TRENDING, REVERTING = "COMPRESSION", "TREND", "MEAN_REV"


def likeliest(states: int, prefix: str = "p_"):
    """The state of the greatest probability, the first of equal ones."""
    chances = F.array(*(F.col(f"{prefix}{s}") for s in range(states)))
    return (F.array_position(chances, F.array_max(chances)) - 1).cast("int")


def state_names(df: DataFrame, state: str, value: str) -> DataFrame:
    """(state, variance, drift, name) of three states 0 to 2, by the values of their rows; one aggregation.

    The state of least variance is quiet. Of the others that of the greater absolute mean trends, of equal ones that of
    greater variance. A state without values has a variance of 1e9 and no drift; equal variances go by number.
    """
    spark: SparkSession = df.sparkSession
    found = df.groupBy(F.col(state).cast("int").alias("state")).agg(F.var_pop(value).alias("variance"), F.abs(F.avg(value)).alias("drift"))
    every = spark.range(3).select(F.col("id").cast("int").alias("state")).join(found, "state", "left")
    every = every.select("state", F.coalesce("variance", F.lit(1e9)).alias("variance"), F.coalesce("drift", F.lit(0.0)).alias("drift"))
    w = Window.partitionBy(F.lit(0)).orderBy("variance", "state")  # three rows
    place, other = F.row_number().over(w), F.coalesce(F.lead("drift").over(w), F.lag("drift").over(w))
    trends = F.when(place == 2, F.col("drift") > other).otherwise(F.lag("drift").over(w) <= F.col("drift"))
    return every.withColumn("name", F.when(place == 1, QUIET).when(trends, TRENDING).otherwise(REVERTING))
