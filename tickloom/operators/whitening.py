"""Bounds, scales and principal axes that are fitted on some rows and applied to any.

A fit takes the bounds of each column (exact quantiles), the mean and deviation of the bounded columns, and the covariance of
the scaled ones, summed up over partitions; its axes, by falling variance and each with its largest part positive, are what a
driver works out of a matrix of columns by columns. Applying it is column expressions only. A row that lacks a value has no components.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.quantiles import quantiles


@dataclass(frozen=True)
class Whitening:
    """Fitted numbers by column, and by component a row of ``axes`` and the deviation along it."""

    columns: tuple[str, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    centre: tuple[float, ...]
    axes: tuple[tuple[float, ...], ...]
    scale: tuple[float, ...]

    def bounded(self) -> list[Column]:
        return [F.when(F.col(c).isNotNull() & ~F.isnan(c), F.least(F.greatest(F.col(c), F.lit(a)), F.lit(b))) for c, a, b in zip(self.columns, self.low, self.high, strict=True)]

    def scaled(self) -> list[Column]:
        return [(x - m) / s for x, m, s in zip(self.bounded(), self.mean, self.std, strict=True)]

    def apply(self, df: DataFrame, prefix: str = "w_") -> DataFrame:
        """``df`` with a column for each component."""
        z = "__scaled"
        while z in df.columns:
            z = "_" + z
        row = F.array(*((x - c) for x, c in zip(self.scaled(), self.centre, strict=True)))
        along = lambda a, s: F.aggregate(F.zip_with(z, F.array(*map(F.lit, a)), lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v) / s
        return df.withColumn(z, row).withColumns({f"{prefix}{k}": along(a, s) for k, (a, s) in enumerate(zip(self.axes, self.scale, strict=True))}).drop(z)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Whitening:
        held = json.loads(spark.read.text(path).first()[0])
        return cls(**{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) for k, v in held.items()})


def _products(df: DataFrame, n: int) -> np.ndarray:
    """The sum over all rows of the products of an array column's values with each other, and the rows' number as the last value."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros((n, n)), 0
        for batch in batches:
            if len(batch):
                m = np.stack(batch["z"])
                total += m.T @ m
                rows += len(m)
        yield pd.DataFrame({"sums": [np.append(total.ravel(), rows)]})

    out = np.zeros(n * n + 1)
    sums = df.mapInPandas(work, "sums array<double>").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    for at, v in sums.collect():  # columns by columns
        out[at] = v
    return out


def fit(df: DataFrame, columns: tuple[str, ...], low: float = 0.01, high: float = 0.99, components: int | None = None, least: float = 1e-8) -> Whitening:
    """The whitening of ``df``; with fewer than 10 whole rows the axes are the columns themselves."""
    n = len(columns)
    bounds = quantiles(df, list(columns), [low, high])
    start = Whitening(columns, *(tuple(-float("inf") if b is None else b for b in (bounds[c][k] for c in columns)) for k in (0, 1)), (0.0,) * n, (1.0,) * n, (0.0,) * n, (), ())
    start = Whitening(**{**asdict(start), "high": tuple(float("inf") if bounds[c][1] is None else bounds[c][1] for c in columns)})
    row = df.select(*(x.alias(f"x{k}") for k, x in enumerate(start.bounded()))).agg(*(f(f"x{k}") for k in range(n) for f in (F.avg, F.var_samp))).first()
    mean = tuple(row[2 * k] or 0.0 for k in range(n))
    std = tuple(float(np.sqrt(max(row[2 * k + 1] or 0.0, least))) for k in range(n))
    scaled = Whitening(**{**asdict(start), "mean": mean, "std": std})
    z = df.select(F.array(*scaled.scaled()).alias("z")).where(F.forall("z", lambda x: x.isNotNull()))
    centre = z.agg(F.count("*"), *(F.avg(F.get("z", F.lit(k))) for k in range(n))).first()
    many = centre[0]
    if many < 10:
        axes, scale, middle = np.eye(n), np.ones(n), (0.0,) * n
    else:
        middle = tuple(centre[1:])
        around = z.select(F.zip_with("z", F.array(*map(F.lit, middle)), lambda x, m: x - m).alias("z"))
        values, vectors = np.linalg.eigh(_products(around, n)[:-1].reshape(n, n) / (many - 1))
        order = np.argsort(-values, kind="stable")[: components or n]
        axes = vectors.T[order]
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
        scale = np.maximum(np.sqrt(np.maximum(values[order], 0) + least), 1e-5)
    return Whitening(columns, start.low, start.high, mean, std, middle, tuple(map(tuple, axes.tolist())), tuple(scale.tolist()))
