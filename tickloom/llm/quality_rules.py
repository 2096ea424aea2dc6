"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths.

Each document is measured inside the task that reads it; nothing is shuffled. Words are hashed once,
the hashes of all n-grams follow by one multiply-add per length in numpy, and sorting them finds the
n-grams that occur more than once. What counts is the share of characters (code points, not bytes)
inside duplicated n-grams and lines, so long repeats weigh more than short ones.

Defined results: null text is an empty text (no words, so the base rules fail); repeated rows each
get their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import as_bytes, by_block, text_of, tidied

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, dup_line_share double, dup_gram_share double, top_gram_share double, kept boolean"
)
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Limits:
    """Largest accepted shares of a document's word characters.

    ``dup`` maps an n-gram length to the share inside duplicated n-grams, ``top`` to the share that
    the most frequent n-gram covers (of equally frequent ones the first in the text); ``line`` is for
    lines that repeat an earlier line, among all characters; ``symbols`` is the accepted number of
    symbols per word.
    """

    dup: tuple[tuple[int, float], ...] = ((5, 0.30), (6, 0.29), (7, 0.28), (8, 0.27), (9, 0.26), (10, 0.25))
    top: tuple[tuple[int, float], ...] = ((2, 0.30), (3, 0.28), (4, 0.26))
    line: float = 0.30
    symbols: float = 0.2
    min_words: int = 10
    repeat_words_percent: int = 20


def _duplicated(grams: np.ndarray) -> np.ndarray:
    """True where a gram's hash occurs at least twice."""
    s = np.sort(grams)
    twice = s[1:][s[1:] == s[:-1]]
    return np.isin(grams, twice) if len(twice) else np.zeros(len(grams), bool)


def _covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Words covered by the grams that start where ``starts`` is True."""
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts)
    edges[at] += 1
    np.add.at(edges, at + length, -1)
    return np.cumsum(edges[:n]) > 0


def _top_share(grams: np.ndarray, n: int, lengths: np.ndarray, size: int, total: int) -> float:
    """Share of characters covered by the most frequent gram, if it occurs at least three times."""
    s = np.sort(grams)
    if len(s) < 3 or not (s[2:] == s[:-2]).any():
        return 0.0
    _, first, counts = np.unique(grams, return_index=True, return_counts=True)
    top = grams[first[counts == counts.max()].min()]
    return float(lengths[_covered(grams == top, n, size)].sum()) / total


def measure(body: bytes, limits: Limits) -> tuple:
    """The row of ``SCHEMA`` after doc_id, for one document."""
    text = text_of(body)
    words = body.split()
    n = len(words)
    plain = len(text) == len(body)
    chars = len if plain else lambda x: len(text_of(x))
    word_chars = len(text) - sum(map(text.count, BLANKS))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[bytes] = set()
    n_dup_lines = dup_line_chars = 0
    for line in body.split(b"\n"):
        if line in seen:
            n_dup_lines += 1
            dup_line_chars += chars(line)
        elif line and not line.isspace():
            seen.add(line)
    n_repeat = 0
    dup_share = top_share = 0.0
    bad = n_symbols > limits.symbols * n
    if n >= 2:
        lengths = np.fromiter(map(chars, words), np.int64, n)
        total = int(lengths.sum())
        hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        dup, top = dict(limits.dup), dict(limits.top)
        grams, found = hashes, True
        for size in range(2, min(n, max([5, *dup, *top])) + 1):
            grams = grams[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[size - 1 :]
            if size in top:
                share = _top_share(grams, n, lengths, size, total)
                top_share = max(top_share, share)
                bad |= share > top[size]
            if (size == 5 or size in dup) and found:
                repeated = _duplicated(grams)
                if found := bool(repeated.any()):  # without a repeated gram no longer one repeats
                    inside = _covered(repeated, n, size)
                    if size == 5:
                        n_repeat = int(inside.sum())
                    if size in dup:
                        share = float(lengths[inside].sum()) / total
                        dup_share = max(dup_share, share)
                        bad |= share > dup[size]
    line_share = dup_line_chars / max(1, len(text))
    bad |= line_share > limits.line
    failed = n < limits.min_words or 100 * n_repeat > limits.repeat_words_percent * n
    return n, word_chars, n_symbols, n_dup_lines, n_repeat, failed, line_share, dup_share, top_share, not (failed or bad)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per document with its measures, ``base_failed`` and the verdict ``kept``."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.bool_() if x.endswith("boolean") else pa.float64() if x.endswith("double") else pa.int64() for x in SCHEMA.split(", ")]

    def work(ids: list, bodies: list[bytes]) -> pa.RecordBatch:
        columns = zip(*((i, *measure(b, limits)) for i, b in zip(ids, bodies, strict=True)), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return by_block(as_bytes(docs, id_col, text_col), work, SCHEMA, 8 << 20)


def verdict(text: Column, limits: Limits = Limits()) -> Column:
    """``kept`` of ``quality_rules`` as a condition on a text column."""

    @F.arrow_udf("boolean")
    @tidied
    def judge(bodies: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in bodies:
            yield pa.array([measure(b.as_py(), limits)[-1] for b in part], pa.bool_())

    return judge(F.coalesce(text.cast("binary"), F.lit(b"")))
