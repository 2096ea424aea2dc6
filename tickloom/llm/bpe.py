"""Byte-pair encoding and decoding over a distinct-word table.

``encode`` splits texts into words in Spark, encodes each distinct word of the corpus once, and joins
the ids back by position (see ``dictionary``). ``decode`` looks each distinct id of a batch up in the
id-to-piece table, whose size is the vocabulary's and does not grow with the data.

A word is what lies between single spaces, with the space before it, as the vocabulary's pattern never
joins characters across such a border; texts with other runs of white space are cut by the pattern
itself. The special strings of the vocabulary are words of their own and stand for their ids.

Defined results: null text is an empty text (no ids); repeated rows each get their row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.dictionary import over_words, ragged
from tickloom.llm.tokenizing import PieceEncoder, read_pieces

#: Fixed value: the byte-level vocabulary's pre-tokenizer pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space beside other white space: then single spaces are no borders.
WIDE = re.compile(r" \s|\s ")


class Words:
    """Cuts texts into words whose ids do not depend on what stands around them.

    A key is the text after a border space, or a 1-tuple of a word that has no border space before it.
    """

    def __init__(self, special: list[str]):
        self.special = special
        self.split_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.pattern = regex.compile(PATTERN)

    def __getstate__(self):
        return self.special

    def __setstate__(self, state):
        self.__init__(state)

    def keys(self, text: str) -> list:
        if not text:
            return []
        if WIDE.search(text) or (self.split_special and self.split_special.search(text)):
            out: list = []
            for i, part in enumerate(self.split_special.split(text) if self.split_special else [text]):
                out += [(part,)] if i % 2 else [(w,) for w in self.pattern.findall(part)]
            return out
        keys: list = text.split(" ")
        keys[0] = (keys[0],)
        return keys

    @staticmethod
    def word(key) -> str:
        return key[0] if isinstance(key, tuple) else " " + key


class _Encode:
    """Ids of words, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self):
        encoder, pattern = PieceEncoder(self.path), regex.compile(PATTERN)

        def ids(word: str) -> bytes:
            if word in encoder.added:
                return array("I", [encoder.added[word]]).tobytes()
            return array("I", [i for part in pattern.findall(word) for i in encoder.ids(part)]).tobytes()

        return lambda words: list(map(ids, words))


def _gather_ids(flat: np.ndarray, offsets: np.ndarray, documents: Iterator[tuple[int | None, np.ndarray]]) -> pa.Table:
    flat, offsets = flat.view("<i4"), offsets // 4
    starts, lengths = offsets[:-1], np.diff(offsets)
    ids, rows, tables = [], [], []
    held = 0

    def close() -> None:
        ends = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
        joined = pa.array(np.concatenate([flat[:0], *rows]), pa.int32())
        tables.append(pa.table({"id": pa.array(ids, pa.int64()), "ids": pa.ListArray.from_arrays(ends, joined)}))

    for i, at in documents:
        ids.append(i)
        rows.append(flat[ragged(starts[at], lengths[at])] if len(at) else flat[:0])
        held += len(rows[-1])
        if held > 1 << 20:
            close()
            ids, rows, held = [], [], 0
    close()
    return pa.concat_tables(tables)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): every whole text as the ids that the tokenizers library gives it, special strings included."""
    _, added, _ = read_pieces(path)
    words = Words(sorted(added, key=len, reverse=True))
    return over_words(docs, id_col, text_col, words.keys, Words.word, _Encode(path), _gather_ids, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, ids) with ``text``: the pieces of the ids, joined as bytes and read as UTF-8.

    The id-to-piece table is as large as the vocabulary, which is checked, and is joined inside the tasks.
    """
    pieces, added, _ = read_pieces(path)
    by_id = {i: p for p, i in pieces.items()} | {i: t.encode() for t, i in added.items()}
    if len(by_id) > 1_000_000:
        raise ValueError("the vocabulary is too large to be sent to every task")
    size = max(by_id) + 1
    lengths = np.array([len(by_id.get(i, b"")) for i in range(size)], np.int64)
    table = b"".join(by_id.get(i, b"") for i in range(size))
    sent = encoded.sparkSession.sparkContext.broadcast((table, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lengths = sent.value
        flat = np.frombuffer(table, np.uint8)
        starts = np.cumsum(lengths) - lengths
        for batch in batches:
            column = batch.column(1)
            offsets, ids = column.offsets.to_numpy(), column.values.to_numpy()
            texts = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                at = ids[a:b]
                texts.append(flat[ragged(starts[at], lengths[at])].tobytes().decode("utf-8", "replace") if b > a else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(texts, pa.string())], ["id", "ids", "text"])

    return encoded.mapInArrow(run, "id long, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """Counts and digests of encoded and decoded documents."""
    return decoded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
