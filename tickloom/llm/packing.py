"""Packing: cost-balanced assignment of tokenised documents to sequences of fixed length.

A piece of L tokens costs ``linear * L + quadratic * L * L``, the shape of a transformer's dense and
attention work. Every task packs what it reads, in groups of bounded size, so nothing is shuffled and
no task holds more than a group: documents of over one sequence give whole sequences first, then the
rests go, in descending length, each to the sequence of lowest cost that still has room for it. What
fits nowhere is cut over the remaining room, cheapest sequence first, so a group leaves less than one
sequence of padding.

Defined results: null text is an empty text, which is the end id alone; an empty table gives an empty
result; repeated rows are packed once each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tickloom.llm.common import as_bytes, blocks, tidied
from tickloom.llm.tokenizing import WordTokenizer

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
GROUP_BYTES = 8 << 20


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """Packs documents of the given token counts: (document, start, length, sequence), in order of placement.

    Sequences are numbered from 0 in each call.
    """
    pieces: list[tuple[int, int, int, int]] = []
    whole = lengths // capacity
    sequence = 0
    for d in np.flatnonzero(whole):
        for k in range(int(whole[d])):
            pieces.append((int(d), k * capacity, capacity, sequence))
            sequence += 1
    rest = lengths - whole * capacity
    total = int(rest.sum())
    if not total:
        return pieces
    n = -(-total // capacity)
    cost, room = np.zeros(n), np.full(n, capacity, np.int64)
    cut: list[tuple[int, int, int]] = []
    for d in np.argsort(-rest, kind="stable"):
        size = int(rest[d])
        if not size:
            break
        k = int(np.argmin(np.where(room >= size, cost, np.inf)))
        if room[k] < size:
            cut.append((int(d), int(whole[d]) * capacity, size))
            continue
        pieces.append((int(d), int(whole[d]) * capacity, size, sequence + k))
        room[k] -= size
        cost[k] += linear * size + quadratic * size * size
    for d, start, size in cut:
        while size:
            k = int(np.argmin(np.where(room > 0, cost, np.inf)))
            part = min(size, int(room[k]))
            pieces.append((d, start, part, sequence + k))
            room[k] -= part
            cost[k] += linear * part + quadratic * part * part
            start, size = start + part, size - part
    return pieces


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    capacity: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers.

    ``sequence_id`` is the task's number times 2**32 plus a count; ``offset`` is gapless from 0.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from packed(batches)
        finally:
            WordTokenizer.forget()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.shared(tokenizer_path)
        base = TaskContext.get().partitionId() << 32
        end = np.array([end_id], "<u4").tobytes()
        for ids, bodies in blocks(batches, GROUP_BYTES):
            encoded = [tokenizer.encode_bytes(b) + end for b in bodies]
            lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
            filled: dict[int, int] = {}
            rows: list[tuple] = []
            for d, start, size, k in assign(lengths, capacity, linear, quadratic):
                at = filled.get(k, 0)
                filled[k] = at + size
                rows.append((ids[d], start, size, encoded[d][4 * start : 4 * (start + size)], int(lengths[d]), base + k, at))
            base += max(filled, default=-1) + 1
            for i in range(0, len(rows), 20_000):
                columns = list(zip(*rows[i : i + 20_000], strict=True))
                types = [pa.binary() if j == 3 else pa.int64() for j in range(7)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")]
                )

    return as_bytes(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def crc32(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of their ids."""
    from pyspark.sql import functions as F

    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
