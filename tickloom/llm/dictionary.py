"""Distinct-word tables: give every distinct word of a corpus a value once, and join values back by position.

Texts are cut into words inside blocks of bounded size, and each document is kept as positions in its
block's own word list. Word lists are dealt by word to buckets, packed, so that the shuffle carries a
word once per block, in a few bytes, and not once per occurrence:

    words      (bucket, block, words)      each block's distinct words that fall into a bucket, with a digest of all
    values     (block, bucket, values)     each distinct word of a bucket is evaluated once
    documents  (block, ids, places)        joined with the values by block, then read by position

No word is hot in this shape, as it stands at most once in a block; blocks are bounded by bytes, and
there are as many buckets as partitions, so a bucket holds about as many words as a block.

Words go to buckets by a hash, or by their place among all words in order, so that those of one prefix lie together
and a frequent prefix is cut between buckets. The borders are words of a sample; they decide how even buckets are, and no result.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tickloom.llm.common import as_bytes, blocks, text_of

BLOCK_BYTES = 10 << 20

#: What borders are drawn from: rows (about), words of a row, and bytes of a border.
SAMPLE_ROWS, SAMPLE_WORDS, BORDER_BYTES = 1000, 64, 64

#: Cuts a text into hashable keys; a ``Namer`` gives the word that a key stands for.
Splitter = Callable[[str], list]
Namer = Callable[[object], str]
#: Values of sorted distinct words.
Evaluator = Callable[[list[str]], list[bytes]]
#: The bucket of a word in UTF-8.
Dealer = Callable[[bytes], int]
#: From a block's word values (bytes, offsets) and its documents' (id, positions) to output rows.
Gatherer = Callable[[np.ndarray, np.ndarray, Iterator[tuple[int | None, np.ndarray]]], pa.Table]


def _squeeze(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed by byte planes."""
    raw = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    raw = pa.decompress(packed[8:], 4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel()


def pack(items: list[bytes]) -> bytes:
    """A list of byte strings as one."""
    lengths = _squeeze(np.fromiter(map(len, items), np.uint32, len(items)))
    body = b"".join(items)
    return len(lengths).to_bytes(8, "little") + lengths + len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> tuple[bytes, np.ndarray]:
    """The joined byte strings of a packed list, and their lengths."""
    n = int.from_bytes(packed[:8], "little")
    lengths, rest = _expand(packed[8 : 8 + n]), packed[8 + n :]
    return pa.decompress(rest[8:], int.from_bytes(rest[:8], "little"), codec="zstd", asbytes=True), lengths.astype(np.int64)


@dataclass(frozen=True)
class ByHash:
    """Deals words by a hash of them."""

    buckets: int

    def __call__(self, word: bytes) -> int:
        return zlib.crc32(word) % self.buckets


@dataclass(frozen=True)
class ByOrder:
    """Deals words by their place among all words in order: a bucket begins at each border."""

    borders: tuple[bytes, ...]

    def __call__(self, word: bytes) -> int:
        return bisect_right(self.borders, word)


def even_borders(words: list[bytes], buckets: int) -> ByOrder:
    """Borders that share the distinct ``words`` out evenly."""
    words = sorted(set(words))
    return ByOrder(tuple(sorted({words[len(words) * k // buckets] for k in range(1, buckets)} if words else ())))


def sampled_borders(rows: DataFrame, split: Splitter, name: Namer, buckets: int) -> ByOrder:
    """Borders from about ``SAMPLE_ROWS`` rows, at most ``SAMPLE_WORDS`` distinct words of each, of ``BORDER_BYTES`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                words = (name(k).encode() for k in set(split(text_of(body.as_py()))))
                found = [w[:BORDER_BYTES] for w in heapq.nsmallest(SAMPLE_WORDS, words, key=zlib.crc32)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["word"])

    share = min(1.0, SAMPLE_ROWS / max(rows.count(), 1))
    sample = rows.select("body").sample(share, seed=1)
    return even_borders(sample.mapInArrow(run, "word binary").distinct().toArrow()["word"].to_pylist(), buckets)


def _ordered(keys: list, name: Namer, deal: Dealer) -> tuple[list[tuple[int, bytes]], np.ndarray]:
    """A block's words as sorted (bucket, word), and the place of each key among them."""
    words = [name(k).encode() for k in keys]
    tagged = [(deal(w), w) for w in words]
    order = sorted(range(len(tagged)), key=tagged.__getitem__)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return [tagged[i] for i in order], place


def _digest(tagged: list[tuple[int, bytes]]) -> int:
    """A number that two views of a block share only if they found the same words."""
    lengths = np.fromiter((len(w) for _, w in tagged), np.int64, len(tagged))
    found = hashlib.blake2b(lengths.tobytes(), digest_size=7)
    found.update(b"".join(w for _, w in tagged))
    return int.from_bytes(found.digest(), "little")


def _number() -> int:
    return TaskContext.get().partitionId() << 32


def _block_words(rows: DataFrame, split: Splitter, name: Namer, deal: Dealer) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (_, bodies) in zip(itertools.count(_number()), blocks(batches, BLOCK_BYTES)):
            seen: dict = {}
            for body in bodies:
                seen |= dict.fromkeys(split(text_of(body)))
            tagged, _ = _ordered(list(seen), name, deal)
            digest = _digest(tagged)
            out = [(b, number, digest, pack([w for _, w in ws])) for b, ws in itertools.groupby(tagged, lambda t: t[0])]
            del seen, tagged
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "block", "digest", "words"])

    return rows.mapInArrow(run, "bucket int, block long, digest long, words binary")


def _block_documents(rows: DataFrame, split: Splitter, name: Namer, deal: Dealer) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (ids, bodies) in zip(itertools.count(_number()), blocks(batches, BLOCK_BYTES)):
            seen: defaultdict = defaultdict(itertools.count().__next__)
            at, sizes = [], []
            for body in bodies:
                keys = split(text_of(body))
                at.append(np.fromiter(map(seen.__getitem__, keys), np.int32, len(keys)))
                sizes.append(len(keys))
            every = np.concatenate(at)
            often = np.argsort(-np.bincount(every, minlength=len(seen)), kind="stable")  # low numbers for frequent words pack well
            rank = np.empty(len(seen), np.uint32)
            rank[often] = np.arange(len(seen))
            tagged, place = _ordered(list(seen), name, deal)
            digest, ranks, places = _digest(tagged), _squeeze(rank[every]), _squeeze(place[often])
            del seen, at, every, often, rank, tagged, place  # nothing of them waits for the reader of the block
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([digest], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([ranks], pa.binary()),
                    pa.array([places], pa.binary()),
                ],
                ["block", "digest", "ids", "sizes", "ranks", "places"],
            )

    return rows.mapInArrow(run, "block long, digest long, ids array<long>, sizes array<long>, ranks binary, places binary")


def over_words(
    docs: DataFrame, id_col: str, text_col: str, split: Splitter, name: Namer, evaluate: Callable[[], Evaluator], gather: Gatherer, schema: str, by_prefix: bool = False
) -> DataFrame:
    """Evaluates each distinct word once and gathers the values of every document's words.

    ``evaluate()`` is called in the tasks and gives the evaluator. The two views of a block come from
    the same deterministic scan, so they agree on its number and its words; a digest of both is compared.
    With ``by_prefix`` words of one prefix are evaluated together, in order.
    """
    rows = as_bytes(docs, id_col, text_col)
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    deal = sampled_borders(rows, split, name, buckets) if by_prefix else ByHash(buckets)

    def values(table: pa.Table) -> pa.Table:
        lists = []
        for packed in table["words"].to_pylist():
            body, lengths = unpack(packed)
            ends = np.cumsum(lengths)
            lists.append([body[a:b].decode() for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)])
        distinct = sorted(set(itertools.chain.from_iterable(lists)))
        known = dict(zip(distinct, evaluate()(distinct), strict=True))
        out = [pack(list(map(known.__getitem__, ws))) for ws in lists]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "digest": table["digest"], "values": pa.array(out, pa.binary())})

    found = _block_words(rows, split, name, deal).groupBy("bucket").applyInArrow(values, "block long, bucket int, digest long, values binary")

    def assemble(documents: pa.Table, table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        parts = [unpack(v) for v in table["values"].to_pylist()]
        flat = np.frombuffer(b"".join(p[0] for p in parts), np.uint8)
        lengths = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        seen = set(table["digest"].to_pylist())

        def each() -> Iterator[tuple[int | None, np.ndarray]]:
            for row in documents.to_pylist():
                places = _expand(row["places"])
                if len(places) != len(lengths) or seen - {row["digest"]}:
                    raise RuntimeError("a block's words and documents were cut from different rows")
                at = places[_expand(row["ranks"])]
                ends = np.cumsum(row["sizes"])
                for i, a, b in zip(row["ids"], (ends - row["sizes"]).tolist(), ends.tolist(), strict=True):
                    yield i, at[a:b]

        return gather(flat, offsets, each())

    left = _block_documents(rows, split, name, deal).groupBy("block")
    return left.cogroup(found.groupBy("block")).applyInArrow(assemble, schema)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all the runs starts[i] .. starts[i] + lengths[i], one after the other."""
    ends = np.cumsum(lengths)
    out = np.arange(ends[-1] if len(ends) else 0)
    return out + np.repeat(starts - (ends - lengths), lengths)
