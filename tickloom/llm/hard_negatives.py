"""Hard negatives by blocked dense products of anchors and candidates.

Components become integers, floor(``scale`` * x). Anchors are sent to the tasks in blocks of at most ``SENT`` bytes;
every task multiplies them, ``LINES`` at a time, by its candidates in blocks of ``WIDE`` rows, in float64, where
integer products below 2 ** 53 are exact (larger ones are put together from exact products of halves). The first
pass keeps each anchor's first positives of a task, which merge over tasks by rank. They fix a window of scores for each
positive, and the second pass keeps the first negatives of each window in the same way. Both passes run once for
every block of anchors, so that neither a task nor the driver holds more than one block; what a task gives out is
bounded by its anchors and not by its candidates.

Defined results: rows with a null id, label or vector, with null or non-finite components, or with a vector of another
length than most (of equally frequent lengths the shorter) take no part, nor does one with components so large that a
product might not fit a long (|floor(scale * x)| over 2 ** 31 / sqrt(length)). Repeated rows are rows of their own: an
anchor's twin may be its positive. Ties go by smaller id. An anchor without positives, or a positive without rows in its
window, gives no row; an empty table an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import staged, tidied

#: Bytes of anchors that are sent to the tasks at once.
SENT = 16 << 20
LINES = 512
WIDE = 4096
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def numbers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Vectors as a matrix of whole numbers in float64."""
    return np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` with all of ``b``, exactly."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    (a1, a0), (b1, b0) = np.divmod(a, 2.0**14), np.divmod(b, 2.0**14)
    high, middle, low = (x.astype(np.int64) for x in (a1 @ b1.T, a1 @ b0.T + a0 @ b1.T, a0 @ b0.T))
    return (high << 28) + (middle << 14) + low


class Best:
    """The first ``k`` of each line's (score, id), highest scores and then smallest ids, over any number of blocks."""

    def __init__(self, lines: int, k: int):
        self.k = k
        self.scores = np.full((lines, k), NONE)
        self.ids = np.full((lines, k), LAST)

    def add(self, first: int, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """A block of lines from ``first`` on, by candidates."""
        mine = slice(first, first + len(scores))
        held, k = self.scores[mine], self.k
        open_ = np.where(allowed, scores, NONE)
        least = held[:, -1]
        if open_.shape[1] > k:
            least = np.maximum(least, np.partition(open_, -k, axis=1)[:, -k])
        line, at = np.nonzero((open_ >= least[:, None]) & (open_ > NONE))
        if not len(line):
            return
        before, place = np.nonzero(held > NONE)
        lines = np.concatenate([line, before])
        score = np.concatenate([open_[line, at], held[before, place]])
        name = np.concatenate([ids[at], self.ids[mine][before, place]])
        order = np.lexsort((name, -score, lines))
        lines = lines[order]
        rank = np.arange(len(lines)) - np.searchsorted(lines, lines)
        taken = rank < k
        lines, rank, order = lines[taken], rank[taken], order[taken]
        self.scores[mine][lines, rank] = score[order]
        self.ids[mine][lines, rank] = name[order]


def _share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``percent`` hundredths of whole scores, rounded up or down, without overflow."""
    whole, rest = np.divmod(score, 100)
    return percent * whole + (-(-percent * rest // 100) if up else percent * rest // 100)


def _candidates(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, ids, labels and vectors, in blocks."""
    for batch in batches:
        for at in range(0, batch.num_rows, WIDE):
            part = batch.slice(at, WIDE)
            yield (*(part.column(c).to_numpy() for c in ("row", "id", "label")), numbers(part.column("v"), width, scale))


def _usable(rows: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """The rows that take part, numbered and written, and the length of their vectors; 0 if there are none."""
    kind = "array<float>" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    row = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast(kind).alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    row = row.where("id is not null and label is not null and size(v) > 0").where(good)
    common = row.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if common is None:
        return row, 0
    width = common["width"]
    most = math.isqrt(2**62 // width)
    fits = F.forall("v", lambda x: (x.cast("double") * scale >= -most) & (x.cast("double") * scale < most + 1))
    row = row.where(F.size("v") == width).where(fits)
    return staged(row.withColumn("row", F.monotonically_increasing_id()), "rows"), width


def _dealt(anchors: DataFrame, most: int) -> list[Column]:
    """Conditions that part the anchors into blocks, none of more than ``most`` rows, of which the sizes are counted."""
    parts = max(1, -(-anchors.count() // most))
    while True:
        part = F.pmod(F.xxhash64("row"), F.lit(parts))
        if parts == 1 or anchors.groupBy(part.alias("part")).count().agg(F.max("count")).first()[0] <= most:
            return [part == p for p in range(parts)]
        parts += -(-parts // 8)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """The first ``negatives`` rows of other labels for each of the first ``positives`` of every row for which ``is_anchor`` holds.

    ``is_anchor`` is a condition on ``id``. A negative's score lies between ``low`` and ``high`` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    rows, width = _usable(vectors, scale, id_col, label_col, vector_col)
    found = spark.createDataFrame([], FOUND)
    if not width:
        return found
    anchors = rows.where(is_anchor)
    for condition in _dealt(anchors, max(LINES, SENT // (8 * width))):
        block = anchors.where(condition).orderBy("row").toArrow().combine_chunks().to_batches()
        if block:
            found = found.unionByName(_of_block(rows, block[0], width, positives, negatives, low, high, scale))
    return found


def _of_block(rows: DataFrame, block: pa.RecordBatch, width: int, positives: int, negatives: int, low: int, high: int, scale: int) -> DataFrame:
    spark = rows.sparkSession
    own, ids, labels = (block.column(c).to_numpy() for c in ("row", "id", "label"))
    n = len(own)
    sent = spark.sparkContext.broadcast((own, ids, labels, numbers(block.column("v"), width, scale)))

    @tidied
    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _, labels, m = sent.value
        best = Best(n, positives)
        for row, names, of, v in _candidates(batches, width, scale):
            for a in range(0, n, LINES):
                lines = slice(a, a + LINES)
                same = labels[lines, None] == of
                same &= own[lines, None] != row
                best.add(a, products(m[lines], v), same, names)
        line, place = np.nonzero(best.scores > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (line, best.ids[line, place], best.scores[line, place])], ["anchor", "id", "score"])

    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = rows.mapInArrow(first_pass, "anchor long, id long, score long")
    near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    near = near.toArrow()  # ``positives`` rows an anchor of this block at most
    line, place = near["anchor"].to_numpy(), near["place"].to_numpy() - 1
    names, scores = np.full((n, positives), LAST), np.full((n, positives), NONE)
    names[line, place], scores[line, place] = near["id"].to_numpy(), near["score"].to_numpy()
    known = scores > NONE
    least = np.where(known, _share(scores, low, True), LAST)
    most = np.where(known, _share(scores, high, False), NONE)
    windows = spark.sparkContext.broadcast((names, scores, least, most))

    @tidied
    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ids, labels, m = sent.value
        names, scores, least, most = windows.value
        best = [Best(n, negatives) for _ in range(positives)]
        for _, candidates, of, v in _candidates(batches, width, scale):
            for a in range(0, n, LINES):
                lines = slice(a, a + LINES)
                found, other = products(m[lines], v), labels[lines, None] != of
                for p in range(positives):
                    best[p].add(a, found, other & (found >= least[lines, p, None]) & (found <= most[lines, p, None]), candidates)
        for p in range(positives):
            line, place = np.nonzero(best[p].scores > NONE)
            columns = (line, np.full(len(line), p), ids[line], names[line, p], scores[line, p], best[p].ids[line, place], best[p].scores[line, place])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    schema = "anchor long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    hard = rows.mapInArrow(second_pass, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return staged(hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
