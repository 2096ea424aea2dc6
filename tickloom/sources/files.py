"""Further sources: bar files, hourly binary tick files, checked reads."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A record of an hourly file, big-endian.
RECORD = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")])
TIME_NAMES = ("timestamp", "datetime", "time", "date")


def read_bars_csv(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a CSV file: names in any case, time as milliseconds or text, closed range."""
    bars = spark.read.csv(path, header=True)
    bars = bars.toDF(*(c.strip().lower() for c in bars.columns))
    name = next((c for c in TIME_NAMES if c in bars.columns), None)
    if name is None:
        raise ValueError("no column of time")
    digits = F.col(name).rlike(r"^\d+$")
    ts = F.when(digits, F.timestamp_millis(F.col(name).try_cast("long"))).otherwise(F.col(name).try_cast("timestamp"))
    values = [F.col(c).try_cast("double").alias(c) for c in bars.columns if c not in TIME_NAMES and c != "symbol"]
    symbol = ["symbol"] if "symbol" in bars.columns else []
    bars = bars.select(*symbol, ts.alias("bar_start"), *values)
    if start:
        bars = bars.where(F.col("bar_start") >= F.lit(start).cast("timestamp"))
    if end:
        bars = bars.where(F.col("bar_start") <= F.lit(end).cast("timestamp"))
    return bars


def trendbars(df: DataFrame) -> DataFrame:
    """Bars from a low and differences to it, in hundred-thousandths, and minutes since the epoch."""
    price = lambda c: (F.col("low") + F.col(c)) / 100000
    return df.select(
        "symbol",
        F.timestamp_seconds(F.col("minutes") * 60).alias("bar_start"),
        price("delta_open").alias("open"),
        price("delta_high").alias("high"),
        (F.col("low") / 100000).alias("low"),
        price("delta_close").alias("close"),
        F.col("volume").cast("double").alias("volume"),
    )


def hours(spark: SparkSession, symbols: list[str], start: str, end: str) -> DataFrame:
    """Every hour of the days from ``start`` to before ``end``, with the place of its file (months count from 0)."""
    days = spark.createDataFrame([(s.upper(),) for s in symbols], "symbol string").select(
        "symbol", F.explode(F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))).alias("day")
    )
    each = days.select("symbol", "day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return each.withColumn("path", F.format_string("%s/%04d/%02d/%02d/%02dh_ticks.bi5", "symbol", F.year("day"), F.month("day") - 1, F.dayofmonth("day"), "hour"))


def decode_hour(content: bytes, hour_ns: int, scale: float) -> pd.DataFrame:
    """Ticks of an hourly file that hold a valid quote; a broken file and a broken last record give none."""
    names = ["timestamp_ns", "bid", "ask"]
    try:
        raw = lzma.decompress(content)
    except (lzma.LZMAError, EOFError):
        return pd.DataFrame({"timestamp_ns": np.zeros(0, np.int64), "bid": np.zeros(0), "ask": np.zeros(0)})
    records = np.frombuffer(raw[: len(raw) // RECORD.itemsize * RECORD.itemsize], RECORD)
    bid, ask = records["bid"] / scale, records["ask"] / scale
    ok = (bid > 0) & (ask > 0) & (ask >= bid)
    return pd.DataFrame(dict(zip(names, (hour_ns + records["ms"].astype(np.int64)[ok] * 1_000_000, bid[ok], ask[ok]), strict=True)))


def read_hourly(spark: SparkSession, folder: str, scale: float = 100_000.0) -> DataFrame:
    """Ticks of all hourly files below a folder, one task a group of files; missing hours are gaps."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bi5").load(folder)
    part = lambda i: F.regexp_extract("path", r"([^/]+)/(\d{4})/(\d{2})/(\d{2})/(\d{2})h_ticks", i)
    hour = F.make_timestamp(part(2).cast("int"), part(3).cast("int") + 1, part(4).cast("int"), part(5).cast("int"), F.lit(0), F.lit(0))
    named = files.select(part(1).alias("symbol"), (F.unix_micros(hour) * 1000).alias("hour_ns"), "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                found = decode_hour(row.content, row.hour_ns, scale)
                found.insert(0, "symbol", row.symbol)
                found.insert(1, "seq", found["timestamp_ns"] + np.arange(len(found)))
                yield found

    return named.mapInPandas(decode, "symbol string, seq long, timestamp_ns long, bid double, ask double")


class HourlySource(DataSource):
    """Hourly files as a data source (format ``hourly_ticks``), a partition an hour; option ``folder``, ``symbol``, ``start``, ``end``, ``scale``."""

    @classmethod
    def name(cls) -> str:
        return "hourly_ticks"

    def schema(self) -> str:
        return "symbol string, timestamp_ns long, bid double, ask double"

    def reader(self, schema) -> DataSourceReader:
        return _HourlyReader(self.options)


class _HourlyReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        days = pd.date_range(self.options["start"], self.options["end"], freq="D", inclusive="left")
        return [InputPartition(int((d + pd.Timedelta(hours=h)).value)) for d in days for h in range(24)]

    def read(self, partition):
        at = pd.Timestamp(partition.value)
        symbol = self.options["symbol"].upper()
        path = f"{self.options['folder']}/{symbol}/{at.year:04d}/{at.month - 1:02d}/{at.day:02d}/{at.hour:02d}h_ticks.bi5"
        try:
            with open(path, "rb") as f:
                content = f.read()
        except OSError:
            return
        found = decode_hour(content, partition.value, float(self.options.get("scale", 100_000)))
        for row in found.itertuples(index=False):
            yield symbol, int(row.timestamp_ns), float(row.bid), float(row.ask)


def verified(spark: SparkSession, folder: str, manifest: dict[str, str]) -> DataFrame:
    """(path, sha256, ok): the files of a folder against a manifest of base names; files that it lacks are not ok."""
    wanted = F.create_map(*(x for k, v in manifest.items() for x in (F.lit(k), F.lit(v)))) if manifest else F.create_map().cast("map<string,string>")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = F.element_at(F.split("path", "/"), -1)
    digest = F.sha2("content", 256)
    return files.select("path", digest.alias("sha256"), F.coalesce(F.try_element_at(wanted, base) == digest, F.lit(False)).alias("ok"))


def upper_name(path: Column) -> Column:
    """A file's symbol: its base name up to the first underscore, in capitals."""
    return F.upper(F.substring_index(F.element_at(F.split(path, "/"), -1), "_", 1))
