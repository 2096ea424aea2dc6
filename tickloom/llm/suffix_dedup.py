"""Removal of repeated byte strings over suffix arrays of content-defined shards.

A string of ``length`` bytes is repeated if it starts at two places of the corpus. Every such string has
an anchor: the leftmost of its ``GRAM``-byte substrings with the smallest hash. Equal strings have equal
anchors at equal offsets, so only strings of one anchor key need comparing. The starts that share one
anchor of a text form a region of a few hundred bytes; equal regions are counted with aggregation, which
settles copies without comparing them, and a region whose key no other region has is settled too.

What is left are different regions of one key. They are dealt to shards by key, and in each shard the
suffix array of its regions (induced sorting, ``suffixes``) and the permuted common prefixes tell which
starts are repeated. A key of more regions than fit a shard is settled by counting the hashes of its
strings instead, which spreads over any number of tasks. Both ways are exact, up to 128-bit hashes.

Results go back to texts by region and are removed from the input's bytes; texts are known by digest,
so copies and repeated rows need no ids.

Defined results: null text is an empty text; repeated rows are each other's repeats; a row without an id
keeps that null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import Rolling, as_bytes, by_block, loose, mix, squeeze, staged, tidied, tidy, unused
from tickloom.llm.dictionary import ragged
from tickloom.llm.suffixes import reaching, suffix_array

GRAM = 100
BLOCK_BYTES = 1_000_000
#: Starts of a longer text that are looked at together.
SEGMENT = 8 << 20
#: Bytes of regions in a shard, on average.
SHARD_BYTES = 2 << 20
#: Regions of one key from which on strings are counted instead.
CROWD = 2000
PLACE_BITS = np.uint64(24)
#: Bytes that the places of one array can tell apart.
PLACES = 1 << int(PLACE_BITS)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, by running minima of blocks from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    square = padded.reshape(-1, width)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _pieces(bodies: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """(document, offset, bytes): whole texts, those longer than a segment with an overlap of ``length`` - 1."""
    for d, body in enumerate(bodies):
        for at in range(0, max(0, len(body) - length + 1), SEGMENT):
            yield d, at, body[at : at + SEGMENT + length - 1] if len(body) > SEGMENT else body


def _groups(pieces: Iterator[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Consecutive pieces whose places fit ``PLACE_BITS``, so that one array can hold them."""
    group: list[tuple[int, int, bytes]] = []
    held = 0
    for piece in pieces:
        if len(piece[2]) > PLACES:
            raise ValueError(f"a piece of {len(piece[2])} bytes is longer than the {PLACES} places of an array")
        if group and held + len(piece[2]) > PLACES:
            yield group
            group, held = [], 0
        group.append(piece)
        held += len(piece[2])
    if group:
        yield group


def regions(bodies: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Regions of all texts: document, first and last start, the anchor's key and two hashes of the region's bytes.

    A long text is looked at in segments, each in arrays of its own; an anchor depends only on the bytes of
    its string, so a string's key is the same in any segment and at any place.
    """
    names = ("document", "low", "high", "key", "r1", "r2")
    found = [_group_regions(g, length) for g in _groups(_pieces(bodies, length))]
    return {c: np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in names}


def _group_regions(found: list[tuple[int, int, bytes]], length: int) -> dict[str, np.ndarray]:
    data = np.frombuffer(b"".join(p[2] for p in found), np.uint8)
    sizes = np.array([len(p[2]) for p in found])
    begins = np.cumsum(sizes) - sizes
    one, two = Rolling(data), Rolling(data, 1)
    grams = mix(one.every(GRAM))
    keyed = (grams & ~((np.uint64(1) << PLACE_BITS) - np.uint64(1))) | np.arange(len(grams), dtype=np.uint64)
    anchors = (_window_minima(keyed, length - GRAM + 1) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    starts = ragged(begins, sizes - length + 1)
    piece = np.repeat(np.arange(len(found)), sizes - length + 1)
    anchor = anchors[starts]
    first = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])))
    heads = np.flatnonzero(first)
    lasts = np.append(heads[1:], len(starts)) - 1
    low, high, piece = starts[heads], starts[lasts], piece[heads]
    shift = np.array([p[1] for p in found])[piece] - begins[piece]
    extent = (high - low).astype(np.uint64)
    return {
        "document": np.array([p[0] for p in found])[piece],
        "low": low + shift,
        "high": high + shift,
        "key": grams[anchor[heads]].view(np.int64),
        "r1": mix(one.span(low, high + length) + extent).view(np.int64),
        "r2": mix(two.span(low, high + length) ^ extent).view(np.int64),
    }


def digests(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashlib.md5(b, usedforsecurity=False).digest() for b in bodies), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _counted_regions(rows: DataFrame, length: int) -> DataFrame:
    """Regions that are not settled as unique: how often each occurs, how many of its key there are, and one place of it."""

    def work(ids: list, bodies: list[bytes]) -> pa.RecordBatch:
        r = regions(bodies, length)
        d1, d2 = digests(bodies)
        order = np.lexsort((r["r2"], r["r1"]))
        a, b = r["r1"][order], r["r2"][order]
        heads = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
        counts = np.diff(np.append(heads, len(a)))
        at = order[heads]
        document = r["document"][at]
        return _batch(
            key=r["key"][at], r1=r["r1"][at], r2=r["r2"][at], n=counts.astype(np.int64),
            d1=d1[document], d2=d2[document], low=r["low"][at], size=r["high"][at] - r["low"][at],
        )

    schema = "key long, r1 long, r2 long, n long, d1 long, d2 long, low long, size long"
    found = by_block(rows, work, schema, BLOCK_BYTES).repartition("key")
    found = found.groupBy("key", "r1", "r2").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("d1", "d2", "low", "size")))
    found = found.withColumn("rivals", F.count("*").over(Window.partitionBy("key")))
    return staged(found.where("n > 1 or rivals > 1"), "regions")


def _region_bytes(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted regions with their bytes, one text of each digest being read for them."""

    def texts(ids: list, bodies: list[bytes]) -> pa.RecordBatch:
        distinct = list(dict.fromkeys(b for b in bodies if len(b) >= length))
        d1, d2 = digests(distinct)
        return _batch(d1=d1, d2=d2, body=squeeze(distinct))

    one = by_block(rows, texts, "d1 long, d2 long, body binary", BLOCK_BYTES).groupBy("d1", "d2").agg(F.first("body").alias("body"))
    places = wanted.groupBy("d1", "d2").agg(F.collect_list(F.struct("key", "r1", "r2", "n", "low", "size", "rivals")).alias("places"))

    @tidied
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body = loose(batch.column(0)[i].as_py())
                inner = batch.column(1)[i].values
                low, size = inner.field("low").to_numpy(), inner.field("size").to_numpy()
                raw = [body[a : a + s + length] for a, s in zip(low.tolist(), size.tolist(), strict=True)]
                yield _batch(**{c: inner.field(c) for c in ("key", "r1", "r2", "n", "rivals")}, raw=pa.array(raw, pa.binary()))

    schema = "key long, r1 long, r2 long, n long, rivals long, raw binary"
    return staged(one.join(places, ["d1", "d2"]).select("body", "places").mapInArrow(cut, schema), "region-bytes")


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edges[::2], edges[1::2] - 1


def shard_repeats(table: pa.Table, length: int) -> pa.Table:
    """(r1, r2, first, last): the repeated starts of a shard's single regions, from its suffix array."""
    raw = table["raw"].to_pylist()
    sizes = np.array([len(x) for x in raw]) + 1
    text = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8).astype(np.int16) + 1
    text = np.append(text, 0).astype(np.int16)  # 0xFF parts regions, as UTF-8 never holds it
    hit = reaching(text, suffix_array(text, length), length)
    begins = np.cumsum(sizes) - sizes
    starts = ragged(begins, sizes - length)
    region = np.repeat(np.arange(len(raw)), sizes - length)
    ok = np.zeros(len(text), bool)
    ok[starts] = hit[starts] & (table["n"].to_numpy() == 1)[region]
    first, last = _runs(ok)
    owner = np.searchsorted(begins, first, "right") - 1
    r1, r2 = table["r1"].to_numpy(), table["r2"].to_numpy()
    return pa.table({"r1": r1[owner], "r2": r2[owner], "first": first - begins[owner], "last": last - begins[owner]})


def _crowd_repeats(crowd: DataFrame, length: int) -> DataFrame:
    """The same for keys of very many regions: every string is counted by two hashes."""

    @tidied
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_numpy() for c in ("r1", "r2", "n")}
            for i, raw in enumerate(batch.column("raw").to_pylist()):
                data = np.frombuffer(raw, np.uint8)
                w1, w2 = mix(Rolling(data).every(length)), mix(Rolling(data, 1).every(length))
                full = {c: np.full(len(w1), v[i]) for c, v in columns.items()}
                yield _batch(**full, at=np.arange(len(w1)), w1=w1.view(np.int64), w2=w2.view(np.int64))

    every = crowd.select("r1", "r2", "n", "raw").mapInArrow(strings, "r1 long, r2 long, n long, at long, w1 long, w2 long")
    twice = every.groupBy("w1", "w2").agg(F.sum("n").alias("total")).where("total > 1").select("w1", "w2")
    return every.where("n = 1").join(twice, ["w1", "w2"]).select("r1", "r2", F.col("at").alias("first"), F.col("at").alias("last"))


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """(d1, d2, spans): for each text, by digest, the first and last starts of its repeated strings."""
    found = _counted_regions(rows, length)
    whole = found.where("n > 1").select("r1", "r2", F.lit(0).cast("long").alias("first"), F.col("size").alias("last"))
    open_keys = found.where("n = 1").select("key").distinct()
    raw = _region_bytes(rows, found.where("rivals > 1").join(open_keys, "key"), length)
    total = raw.where(F.col("rivals") <= CROWD).agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    few = raw.where(F.col("rivals") <= CROWD).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))

    def of_shard(table: pa.Table) -> pa.Table:
        try:
            return shard_repeats(table, length)
        finally:
            tidy()

    sorted_in = few.groupBy("shard").applyInArrow(of_shard, "r1 long, r2 long, first long, last long")
    counted = _crowd_repeats(raw.where(F.col("rivals") > CROWD), length)
    repeats = whole.unionByName(sorted_in).unionByName(counted)
    # written before they are joined, here and below, so that joins may split the rows of a region or text that very many share
    repeats = staged(repeats.groupBy("r1", "r2").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "repeats")

    def where(ids: list, bodies: list[bytes]) -> pa.RecordBatch:
        distinct = list(dict.fromkeys(bodies))
        r = regions(distinct, length)
        d1, d2 = digests(distinct)
        return _batch(r1=r["r1"], r2=r["r2"], d1=d1[r["document"]], d2=d2[r["document"]], low=r["low"])

    places = by_block(rows, where, "r1 long, r2 long, d1 long, d2 long, low long", BLOCK_BYTES)
    hits = places.join(repeats, ["r1", "r2"]).select("d1", "d2", F.struct("low", "runs").alias("hit"))
    return staged(hits.groupBy("d1", "d2").agg(F.collect_set("hit").alias("hits")), "hits")  # a set, as copies hit alike


def _edges(size: int, hits: pa.Scalar, length: int) -> np.ndarray:
    """True for each byte of a text of ``size`` bytes that a repeated string covers."""
    edges = np.zeros(size + 1, np.int64)
    if hits.is_valid:
        inner = hits.values.field("runs")
        low = np.repeat(hits.values.field("low").to_numpy(), inner.value_lengths().to_numpy())
        flat = inner.flatten()
        np.add.at(edges, low + flat.field("first").to_numpy(), 1)
        np.add.at(edges, low + flat.field("last").to_numpy() + length, -1)
    return np.cumsum(edges[:-1]) > 0


def _strip(bodies: Iterator[bytes], hits: pa.Array, length: int) -> tuple[list, list, list]:
    """Sizes, removed spans and kept bytes of texts."""
    sizes, runs, kept = [], [], []
    for body, h in zip(bodies, hits, strict=True):
        gone = _edges(len(body), h, length)
        begin, last = _runs(gone)
        sizes.append(len(body))
        runs.append([{"begin": a, "end": b + 1} for a, b in zip(begin.tolist(), last.tolist(), strict=True)])
        kept.append(np.frombuffer(body, np.uint8)[~gone].tobytes() if len(begin) else body)
    return sizes, runs, kept


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): every row's removed byte spans (begin, end) and what is left of its bytes."""
    rows = as_bytes(docs, id_col, text_col)
    spans = repeated_spans(rows, length)

    def packed(ids: list, bodies: list[bytes]) -> pa.RecordBatch:
        d1, d2 = digests(bodies)
        return _batch(doc_id=pa.array(ids, pa.int64()), d1=d1, d2=d2, body=squeeze(bodies))

    @tidied
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, kept = _strip(map(loose, batch.column(1).to_pylist()), batch.column(2), length)
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield _batch(doc_id=batch.column(0), n_bytes=np.array(sizes, np.int64), spans=pa.array(runs, kind), kept=pa.array(kept, pa.binary()))

    texts = by_block(rows, packed, "doc_id long, d1 long, d2 long, body binary", BLOCK_BYTES)
    joined = texts.join(spans, ["d1", "d2"], "left").select("doc_id", "body", "hits")
    return joined.mapInArrow(strip, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")


def without_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated strings cut out of the text, all other columns as they are.

    A character of which only some bytes are removed goes as a whole.
    """
    name, one, two, held = (unused(n, docs) for n in ("name", "d1", "d2", "hits"))
    spans = repeated_spans(as_bytes(docs, id_col, text_col), length).select(F.col("d1").alias(one), F.col("d2").alias(two), F.col("hits").alias(held))

    @F.arrow_udf("struct<d1:long,d2:long>")
    @tidied
    def named(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for bodies in parts:
            found = bodies.to_pylist()
            d1, d2 = digests(found) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.StructArray.from_arrays([pa.array(d1), pa.array(d2)], ["d1", "d2"])

    @F.arrow_udf("string")
    @tidied
    def cut(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bodies, hits in parts:
            yield pa.array([b.decode("utf-8", "ignore") for b in _strip((b.as_py() for b in bodies), hits, length)[2]], pa.string())

    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    keyed = docs.withColumn(name, named(body))
    joined = keyed.join(spans, (F.col(f"{name}.d1") == F.col(one)) & (F.col(f"{name}.d2") == F.col(two)), "left")
    new = F.when(F.col(held).isNull(), F.col(text_col)).otherwise(cut(body, F.col(held)))
    return joined.withColumn(text_col, new).drop(name, one, two, held)


def digest(removed: DataFrame) -> DataFrame:
    """Counts and a digest of what is left of every row, and the text itself, in which cut characters are replaced."""
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return removed.select(
        "doc_id", "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )
