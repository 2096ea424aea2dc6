"""Join-shaped operations on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    at = F.struct(order, *(c for c in df.columns if c not in keys and c != order))
    return df.groupBy(*keys).agg(F.max(at).alias("r")).select(*keys, "r.*")


def label_join(features: DataFrame, labels: DataFrame, order: str = "version", keys: tuple[str, ...] = ("symbol", "timestamp_ns")) -> DataFrame:
    """Features with the last label of their key."""
    return features.join(last_of(labels, list(keys), order), list(keys))


def scatter(rows: DataFrame, values: DataFrame, keys: list[str], name: str, default=0) -> DataFrame:
    """All rows with a value, by default where there is none."""
    return rows.join(values.select(*keys, name), keys, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def between(df: DataFrame, begin_ns: int, end_ns: int) -> DataFrame:
    return df.where(F.col("timestamp_ns").between(begin_ns, end_ns))


def aligned(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys that both tables have."""
    return a.select(*keys).intersect(b.select(*keys))


def latest(df: DataFrame, n: int, by: str = "symbol", order: tuple[str, ...] = ("timestamp_ns", "seq")) -> DataFrame:
    """The last ``n`` rows of each group; Spark cuts groups before it shuffles them."""
    w = Window.partitionBy(by).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def kept(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows whose key is in a set."""
    return df.join(keys, list(on), "left_semi")


def excluded(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows whose key is not in a set."""
    return df.join(keys, list(on), "left_anti")


def stacked(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of tables with the same columns, in any order of columns."""
    for other in others:
        first = first.unionByName(other)
    return first


def beside(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
    """The columns of two tables beside each other, by key and never by place."""
    return a.join(b, list(on))


def oldest(df: DataFrame, by: str = "symbol", order: tuple[str, ...] = ("timestamp_ns", "seq")) -> DataFrame:
    """The first row of each group, which a bounded buffer drops first."""
    return df.groupBy(by).agg(F.min_by(F.struct(*(c for c in df.columns if c != by)), F.struct(*order)).alias("r")).select(by, "r.*")
