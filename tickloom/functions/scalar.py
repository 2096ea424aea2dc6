"""Scalar functions that Spark lacks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 from a digest of the parts; any engine that knows MD5 draws the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def safe_divide(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return a / (b + eps)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    """ln(1 + e**x), without overflow for large x."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def mish(x: Column) -> Column:
    return x * F.tanh(softplus(x))


def logsumexp(values: Column) -> Column:
    """Of an array column."""
    most = F.array_max(values)
    return most + F.ln(F.aggregate(F.transform(values, lambda v: F.exp(v - most)), F.lit(0.0), lambda s, v: s + v))


def softmax(values: Column) -> Column:
    total = logsumexp(values)
    return F.transform(values, lambda v: F.exp(v - total))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function, with an error below 8e-8 (Zelen and Severo's formula)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_ppf(p: float) -> float:
    """The standard normal quantile of a constant."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def argmax(values: Column) -> Column:
    """Place of an array's first largest value, from 0."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def pad_left(values: Column, n: int, filler: float = 0.0) -> Column:
    """An array's last ``n`` values, filled up on the left."""
    return F.slice(F.concat(F.array_repeat(F.lit(filler), n), values), -n, n)


def one_hot(x: Column, categories: list[str], prefix: str) -> dict[str, Column]:
    """A 0 or 1 column for each of fixed categories; null is in none."""
    return {f"{prefix}_{c}": F.coalesce((x == c).cast("int"), F.lit(0)) for c in categories}


def bucket(x: Column, bounds: list[float]) -> Column:
    """Number of bounds below a value: right-closed bins of ascending bounds."""
    out = F.lit(0)
    for b in bounds:
        out = out + (x > b).cast("int")
    return out


def pip_value(distance: Column, lots: Column) -> Column:
    """Money value of a price distance, with ``pip_size`` and ``pip_value`` beside it."""
    return distance / F.col("pip_size") * F.col("pip_value") * lots
