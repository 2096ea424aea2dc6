"""Sinks: tick and feature caches, results as JSON and CSV, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_ticks(ticks: DataFrame, path: str) -> None:
    """Ticks by symbol and day, so that a read of one prunes the others; a task writes whole days."""
    dated = ticks.withColumn("dt", F.to_date("ts"))
    dated.repartition("symbol", "dt").sortWithinPartitions("timestamp_ns", "seq").write.mode("overwrite").option("compression", "zstd").partitionBy("symbol", "dt").parquet(path)


def write_features(features: DataFrame, path: str, vector: str | None = None, width: int = 0) -> None:
    """A feature table, a vector column as columns f_0, f_1 and so on."""
    if vector:
        features = features.select(*(c for c in features.columns if c != vector), *(F.get(vector, F.lit(i)).cast("float").alias(f"f_{i}") for i in range(width)))
    features.write.mode("overwrite").option("compression", "zstd").parquet(path)


def cache_key(df: DataFrame, **params) -> str:
    """A key that changes with any row of ``df`` and any parameter: hashes are summed, so row order does not matter."""
    spec = ",".join(f"{k}={params[k]!r}" for k in sorted(params)) + "|" + df.schema.simpleString()
    row = F.xxhash64(*df.columns)
    sums = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("a"), F.bit_xor(row).alias("b"))
    return sums.select(F.sha2(F.concat_ws("|", F.lit(spec), *(F.col(c).cast("string") for c in ("n", "a", "b"))), 256)).first()[0]


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def manifest(files: DataFrame) -> DataFrame:
    """(name, sha256) of binary files."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def report_lines(metrics: DataFrame, key: str) -> DataFrame:
    """Metrics as lines of text, ``key: name = value``."""
    names = [c for c in metrics.columns if c != key]
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names))
    return metrics.select(key, F.explode(pairs).alias("m")).select(key, F.concat_ws(" = ", "m.name", "m.value").alias("line"))
