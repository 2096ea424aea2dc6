"""Cross-validation splits as tables of row ranges, which rows are joined to by number."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.sources.ticks import by_symbol

RANGES = "fold int, role string, begin long, finish long"


def contiguous_ranges(n: int, splits: int = 6, width: int = 2, purge: int = 3600, embargo: int = 5000) -> list[tuple[int, str, int, int]]:
    """Purged folds: test blocks of ``width`` parts move on by one; training rows keep clear of them. Ranges are half-open."""
    size = n // splits
    out: list[tuple[int, str, int, int]] = []
    for fold in range(splits - width + 1):
        begin, finish = fold * size, (fold + width) * size
        out.append((fold, "test", begin, finish))
        out += [(fold, "train", a, b) for a, b in ((0, begin - purge), (finish + embargo, n)) if a < b]
    return out


def combinatorial_ranges(n: int, splits: int = 6, tests: int = 2, embargo: int = 0) -> list[tuple[int, str, int, int]]:
    """Every choice of test parts; training parts beside a test part lose an embargo at that edge."""
    bounds = [n * k // splits for k in range(splits + 1)]
    out: list[tuple[int, str, int, int]] = []
    for fold, chosen in enumerate(itertools.combinations(range(splits), tests)):
        for k in range(splits):
            begin, finish = bounds[k], bounds[k + 1]
            if k in chosen:
                out.append((fold, "test", begin, finish))
                continue
            begin += embargo * (k - 1 in chosen)
            finish -= embargo * (k + 1 in chosen)
            if begin < finish:
                out.append((fold, "train", begin, finish))
    return out


def walk_forward_ranges(n: int, train: int, test: int, rolling: bool = False) -> list[tuple[int, str, int, int]]:
    """Test blocks one after the other, trained on all rows before them, or on the last ``train`` if rolling."""
    out: list[tuple[int, str, int, int]] = []
    for fold, begin in enumerate(range(train, n - test + 1, test)):
        out.append((fold, "train", begin - train if rolling else 0, begin))
        out.append((fold, "test", begin, begin + test))
    return out


def time_series_ranges(n: int, splits: int = 5, embargo: int = 5) -> list[tuple[int, str, int, int]]:
    """Equal test blocks at the end, each trained on all rows before it but the last ``embargo``; every tested row is out of fold once."""
    size = n // (splits + 1)
    out: list[tuple[int, str, int, int]] = []
    for fold in range(splits):
        begin = n - (splits - fold) * size
        if begin > embargo:
            out += [(fold, "train", 0, begin - embargo), (fold, "test", begin, begin + size)]
    return out


def nested_validation(n: int, share: float = 0.2, purge: int = 9) -> list[tuple[int, str, int, int]]:
    """The last part of training rows as validation, with a purge before it."""
    cut = n - int(n * share)
    return [(0, "train", 0, max(0, cut - purge)), (0, "validation", cut, n)]


def in_parts(df: DataFrame, parts: int) -> DataFrame:
    """Adds ``row``, ``part`` (of ``parts`` of almost equal size in a symbol) and how many rows of the part come before and after the row."""
    rows = numbered_by_day(df)
    sizes = rows.groupBy("symbol").agg(F.count("*").alias("__n"))
    n = F.col("__n")
    part = F.floor((F.col("row") * parts + parts - 1) / n).cast("int")  # the last part that begins at the row or before
    part = F.when(F.floor(n * part / parts) > F.col("row"), part - 1).otherwise(part)
    placed = rows.join(sizes, "symbol").withColumn("part", part)
    edge = lambda k: F.floor(n * k / parts).cast("long")
    return placed.withColumns({"before": F.col("row") - edge(F.col("part")), "after": edge(F.col("part") + 1) - 1 - F.col("row")}).drop("__n")


def combinatorial_roles(parted: DataFrame, parts: int = 6, tests: int = 2, embargo: int = 0) -> DataFrame:
    """Rows of ``in_parts`` by ``fold``, as test or training rows of it; a test row also has its ``path``.

    A fold is a choice of test parts. Each part is tested in several folds, and a path takes each part from one of them, in
    order: so every row is once in every path. Training rows within the embargo beside a test part are left out.
    """
    folds = list(itertools.combinations(range(parts), tests))
    seen = [0] * parts
    table = []
    for fold, chosen in enumerate(folds):
        paths = []
        for k in range(parts):
            paths.append(seen[k] if k in chosen else -1)
            seen[k] += k in chosen
        table.append(F.struct(F.lit(fold).alias("fold"), F.array(*map(F.lit, paths)).alias("paths")))
    df = parted.withColumn("__fold", F.explode(F.array(*table)))
    tested = lambda k: F.coalesce(F.get("__fold.paths", k) >= 0, F.lit(False))
    part = F.col("part")
    left = tested(part - 1) & (F.col("before") < embargo)
    right = tested(part + 1) & (F.col("after") < embargo)
    role = F.when(tested(part), "test").when(~(left | right), "train")
    named = df.withColumns({"fold": F.col("__fold.fold"), "role": role, "path": F.when(tested(part), F.get("__fold.paths", part))})
    return named.where("role is not null").drop("__fold")


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``row``, a symbol's rows in time from 0."""
    return df.withColumn("row", (F.row_number().over(by_symbol()) - 1).cast("long"))


def numbered_by_day(df: DataFrame) -> DataFrame:
    """``numbered`` in two steps, so that no task sorts more than a symbol's day: counts of earlier days, and places in the day."""
    day = F.to_date("ts") if "ts" in df.columns else F.floor(F.col("timestamp_ns") / 86_400_000_000_000)
    dated = df.withColumn("__day", day)
    days = dated.groupBy("symbol", "__day").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("symbol").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = days.select("symbol", "__day", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("symbol", "__day").orderBy("timestamp_ns", "seq")) - 1
    return dated.join(offsets, ["symbol", "__day"]).withColumn("row", (F.col("__before") + place).cast("long")).drop("__day", "__before")


def assign(df: DataFrame, ranges: list[tuple[int, str, int, int]]) -> DataFrame:
    """Rows (with ``row``) by fold and role; the ranges are a constant array, so nothing is shuffled."""
    table = F.array(*(F.struct(F.lit(f).alias("fold"), F.lit(r).alias("role"), F.lit(a).alias("begin"), F.lit(b).alias("finish")) for f, r, a, b in ranges))
    mine = F.filter(table, lambda x: (F.col("row") >= x["begin"]) & (F.col("row") < x["finish"]))
    return df.withColumn("__fold", F.explode(mine)).select(*df.columns, "__fold.fold", "__fold.role")


def in_ranges(spark: SparkSession, ranges: list[tuple[int, str, int, int]]) -> DataFrame:
    return spark.createDataFrame(ranges, RANGES)


def grid(choices: dict[str, list]) -> list[dict]:
    """Every combination of parameter values, in order."""
    return [dict(zip(choices, v, strict=True)) for v in itertools.product(*choices.values())]


def grid_scores(df: DataFrame, choices: dict[str, list], score: Callable[[DataFrame, dict], DataFrame]) -> DataFrame:
    """What ``score`` makes of ``df`` under each combination, with the combination's number and values; each reads ``df`` anew, side by side in one job."""
    found = None
    for k, chosen in enumerate(grid(choices)):
        part = score(df, chosen).select(F.lit(k).cast("long").alias("combination"), *(F.lit(v).alias(n) for n, v in chosen.items()), "*")
        found = part if found is None else found.unionByName(part)
    return found


def chunked(df: DataFrame, frame: int, chunk_rows: int, ahead: int = 0) -> DataFrame:
    """Adds ``row``, ``__chunk`` and ``__halo``: chunks of a symbol's rows, each also with the ``frame`` - 1 rows before and the ``ahead`` rows after it, marked as halo.

    A long symbol is thus many tasks' work; frames should be short beside a chunk. A chunk shorter than they are is an error.
    Rows that bring their number as ``__row`` are not numbered again; each goes to its chunks at once, so ``df`` is computed once.
    """
    if max(frame - 1, ahead) > chunk_rows:
        raise ValueError(f"chunks of {chunk_rows} rows are shorter than frames of {max(frame - 1, ahead)} rows beside them")
    rows = df.withColumn("row", F.col("__row")).drop("__row") if "__row" in df.columns else numbered_by_day(df)
    chunk, place = F.floor(F.col("row") / chunk_rows), F.col("row") % chunk_rows
    to = lambda step, halo: F.struct((chunk + step).alias("__chunk"), F.lit(halo).alias("__halo"))
    homes = [to(0, False)]
    if frame > 1:
        homes.append(F.when(place >= chunk_rows - frame + 1, to(1, True)))
    if ahead:
        homes.append(F.when((place < ahead) & (chunk > 0), to(-1, True)))
    dealt = rows.withColumn("__home", F.explode(F.array_compact(F.array(*homes))))
    return dealt.select(*rows.columns, "__home.__chunk", "__home.__halo")


def windowed(df: DataFrame, features: dict, frame: int, chunk_rows: int, ahead: int = 0) -> DataFrame:
    """Features over frames of at most ``frame`` rows and ``ahead`` rows after, chunk by chunk; ``features`` maps names to functions of a window."""
    w = Window.partitionBy("symbol", "__chunk").orderBy("row")
    return chunked(df, frame, chunk_rows, ahead).withColumns({n: f(w) for n, f in features.items()}).where("not __halo").drop("__chunk", "__halo")


def in_chunks(df: DataFrame, compute: Callable[[pd.DataFrame], pd.DataFrame | dict], outputs: str, frame: int, chunk_rows: int = 20_000, ahead: int = 0) -> DataFrame:
    """``df`` with ``row`` and the columns ``outputs``, which ``compute`` makes of a chunk's rows in order, halo included."""
    both = chunked(df, frame, chunk_rows, ahead)
    kept = [c for c in both.columns if c not in ("__chunk", "__halo")]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in both.dtypes if n in kept), outputs])

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        found = rows.assign(**compute(rows))
        return found[~found["__halo"]].drop(columns=["__chunk", "__halo"])

    return both.groupBy("symbol", "__chunk").applyInPandas(work, schema)
