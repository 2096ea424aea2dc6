"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents with equal shingle sets form a class, and one of them stands for it. Shingles get one global
order, rare ones first, from an estimate of their document frequency. If two sets of n and m shingles
are similar enough, they share at least ``ceil(threshold * n)`` shingles, so among the first
``n - ceil(threshold * n) + l`` of one and the corresponding first ones of the other they share ``l``.
Each document picks the ``l`` from 1 to ``MOST`` with the least estimated cost of scanning its prefix's
lists and of verifying what shares ``l`` of them, so documents of common shingles need more matches.

Candidates are verified exactly, on whole texts, in two rounds. In the first, the documents of a prefix
shingle meet only its first document, if they share a good part of their prefixes with it, and what
links joins one component. In the second, pairs whose
documents are still in different components and which share enough prefix shingles are verified. Large
families of near copies thus cost a star and not all their pairs; a link that the second round leaves
out joins documents of one component already, so components are those of all links.

Before the second round's texts are sent, pairs are tried on sketches: how many shingles of a set fall
into each of about n / 4 buckets. Sets share no more than the sum of the lesser counts, so a pair for
which that is too little cannot link. This bound is exact and loses nothing.

The frequency estimate sums, in a table of fixed size, what tasks count well above the mean of their
slots; it decides the order and ``l``, hence the cost, and never the result.

Defined results: null texts and texts without words have no shingles and link with nothing; repeated
rows each get their row, in one component; a row without an id takes the component of an equal set, if
there is one, and joins no others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import as_bytes, blocks, bucketed, by_block, loose, slices, squeeze, staged, tidied
from tickloom.llm.graph import components
from tickloom.llm.shingles import set_key, shingle_sets

BLOCK_BYTES = 1_000_000
#: Slots of the frequency table, so many bytes are sent to each task.
SLOTS = 1 << 21
#: The most prefix shingles that a document can be asked to share.
MOST = 4
#: Prefix lists of more documents than this are paired in tiles.
TILE = 256
#: Texts that are compared to one sending of another.
RUN = 2000
#: Pairs of the first round share this part of the shorter prefix, in percent.
LIKELY = 30
STAR_ROUNDS = 2
#: Bits of a shingle that prefix lists go by; a chance meeting is only one more candidate.
TOKEN_SHIFT = np.uint64(24)


def _frequencies(rows: DataFrame, k: int) -> np.ndarray:
    """Log2 of the estimated document frequency by slot of the fixed table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(SLOTS, np.int32), 0
        for _, bodies in blocks(batches, BLOCK_BYTES):
            slots = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(bodies, k)]) % np.uint64(SLOTS)
            names, n = np.unique(slots, return_counts=True)
            held[names.astype(np.int64)] += n.astype(np.int32)
            total += len(slots)
        often = np.flatnonzero(held >= max(4, 4 * total / SLOTS))
        yield pa.RecordBatch.from_arrays([pa.array(often.astype(np.int32)), pa.array(held[often].astype(np.int64))], ["slot", "n"])

    counted = rows.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counted.select("slot", F.floor(F.log2("n")).cast("byte").alias("level")).toArrow()
    table = np.zeros(SLOTS, np.uint8)
    table[found["slot"].to_numpy()] = found["level"].to_numpy()
    return table


def prefix(shingles: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of a set in global order, and how many of its shingles a partner must share."""
    n = len(shingles)
    need = -(-percent * n // 100)
    most = min(MOST, need)
    level = levels[shingles % np.uint64(SLOTS)]
    order = np.argsort((level.astype(np.uint64) << np.uint64(56)) | (shingles >> np.uint64(8)), kind="stable")[: n - need + most]
    costs = np.exp2(level[order].astype(np.float64)) - 1
    totals = np.cumsum(costs)[n - need :]
    share = np.arange(1, most + 1)
    best = int(np.argmin(totals + 8 * totals / share**2 + 0.5 * share))
    return (shingles[order[: n - need + best + 1]] >> TOKEN_SHIFT).astype(np.int64), best + 1


def _representatives(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, key, rep, n, share, tokens): one row per distinct non-empty set."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(_frequencies(rows, k))

    def work(ids: list, bodies: list[bytes]) -> pa.RecordBatch:
        seen: dict[bytes, int] = {}
        out: list[tuple] = []
        for i, s in zip(ids, shingle_sets(bodies, k), strict=True):
            if i is None or not len(s):
                continue
            key = set_key(s)
            if key in seen:
                at = seen[key]
                out[at] = (min(i, out[at][0]), *out[at][1:])
            else:
                seen[key] = len(out)
                tokens, share = prefix(s, sent.value, percent)
                out.append((i, key, len(s), share, tokens))
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "key", "n", "share", "tokens"])

    found = by_block(rows, work, "id long, key binary, n int, share int, tokens array<long>", BLOCK_BYTES)
    one = found.groupBy("key").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "share", "tokens")))
    return staged(one.withColumn("node", F.monotonically_increasing_id()), "sets")


def _texts(rows: DataFrame, wanted: DataFrame, k: int) -> str:
    """The table (node, sketch, body) of the sketches and compressed texts that stand for the wanted (node, key, rep)."""

    def packed(ids: list, bodies: list[bytes]) -> pa.RecordBatch:
        sets = shingle_sets(bodies, k)
        columns = [[set_key(s) if len(s) else None for s in sets], list(map(sketch, sets))]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.binary()) for c in columns), squeeze(bodies)], ["rep", "key", "sketch", "body"])

    texts = by_block(rows, packed, "rep long, key binary, sketch binary, body binary", BLOCK_BYTES)
    found = texts.join(wanted, ["rep", "key"]).dropDuplicates(["rep", "key"])  # dealt by the join already
    return bucketed(found.select("node", "sketch", "body"), "texts", "node")


def _dealt(pairs: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """Rows (a, run, b, <column>), one run after the other: first that of a, with null b, then those of its b.

    What stands for an a is thus sent once and not once a pair; an a of very many b has several such runs.
    """
    degree = F.count("*").over(Window.partitionBy("a"))
    dealt = staged(pairs.withColumn("run", F.pmod(F.xxhash64("b"), F.ceil(degree / RUN))), "pairs")
    heads = dealt.select("a", "run", F.lit(None).cast("long").alias("b"), F.col("a").alias("node")).distinct()
    wanted = heads.unionByName(dealt.withColumn("node", F.col("b")))
    rows = wanted.join(texts.select("node", column), "node").select("a", "run", "b", column)
    return rows.repartition("a", "run").sortWithinPartitions("a", "run", F.asc_nulls_first("b"))


def _pairs_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def sketch(shingles: np.ndarray) -> bytes | None:
    """How many shingles fall into each bucket, a power of two of them; null if a byte cannot hold a count."""
    buckets = 1 << max(3, (len(shingles) // 4).bit_length())
    counts = np.bincount((shingles & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def can_link(x: bytes | None, y: bytes | None, percent: int) -> bool:
    """False only if sets of these sketches cannot be similar enough."""
    if x is None or y is None:
        return True
    a, b = (np.frombuffer(v, np.uint8).astype(np.int32) for v in (x, y))
    size = min(len(a), len(b))
    a, b = a.reshape(-1, size).sum(0), b.reshape(-1, size).sum(0)
    both = int(np.minimum(a, b).sum())
    return 100 * both >= percent * (int(a.sum()) + int(b.sum()) - both)


def _plausible(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that sketches do not rule out."""

    @tidied
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, s in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("sketch").to_pylist(), strict=True):
                if b is None:
                    head = s
                elif can_link(head, s, percent):
                    found.append((a, b))
            yield _pairs_of(found)

    return _dealt(pairs, texts, "sketch").mapInArrow(compare, "a long, b long")


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole shingle sets are similar enough."""

    @tidied
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, ["body"], BLOCK_BYTES):
                found: list[tuple[int, int]] = []
                sets = shingle_sets(list(map(loose, part.column("body").to_pylist())), k)
                for a, b, s in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), sets, strict=True):
                    if b is None:
                        head = s
                        continue
                    both = len(np.intersect1d(head, s, assume_unique=True))
                    if 100 * both >= percent * (len(head) + len(s) - both):
                        found.append((a, b))
                yield _pairs_of(found)

    return staged(_dealt(pairs, texts, "body").mapInArrow(verify, "a long, b long"), "links")


def _stars(lists: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """Likely pairs (a, b) of each prefix list's leader and its members in other components.

    The leader is the member with most company in its lists, which a family's original has more of than
    its changed copies. With labels, only members outside the largest leader's component are led.
    """
    if labels is None:
        rows = lists.withColumn("component", F.col("node"))
    else:
        rows = lists.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rank = F.struct("weight", -F.col("node"))
    me = F.struct(rank.alias("rank"), "node", "n", "component")
    by_token = Window.partitionBy("token")
    led = rows.select("token", "node", "n", "component", me.alias("me"), F.max(me).over(by_token).alias("leader"))
    if labels is not None:
        led = led.where(F.col("component") != F.col("leader.component")).withColumn("leader", F.max("me").over(by_token))
    led = led.where(F.col("component") != F.col("leader.component"))
    pairs = led.select(
        F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b"), F.least("n", "leader.n").alias("small"), F.greatest("n", "leader.n").alias("large")
    )
    pairs = pairs.where(100 * F.col("small") >= percent * F.col("large")).groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("small").alias("small"))
    return pairs.where(100 * F.col("shared") >= LIKELY * (F.floor(F.col("small") * (100 - percent) / 100) + 1)).select("a", "b")


def _tiles(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of the members of long prefix lists, tile by tile; sizes and components are compared before pairing."""
    schema = "a long, b long, at_a int, at_b int, n_a int, n_b int, share_a int, share_b int"
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    spread = lists.withColumn("tile", own).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    spread = spread.select("*", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    columns = ("node", "place", "n", "share", "component")

    def pair(table: pa.Table) -> pa.Table:
        node, place, n, share, component, tile, low, high = (table[c].to_numpy() for c in (*columns, "tile", "low", "high"))
        x, y = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        out = []
        for i in x:
            j = y[(component[y] != component[i]) & (100 * np.minimum(n[y], n[i]) >= percent * np.maximum(n[y], n[i]))]
            j = j[node[j] > node[i]] if low[0] == high[0] else j
            first = node[j] > node[i]
            pick = lambda v: (np.where(first, v[i], v[j]), np.where(first, v[j], v[i]))  # noqa: B023, E731
            out.append([*pick(node), *pick(place), *pick(n), *pick(share)])
        names = [c.split()[0] for c in schema.split(", ")]
        types = [pa.int64()] * 2 + [pa.int32()] * 6
        return pa.table({c: pa.array(np.concatenate(v) if out else [], t) for c, v, t in zip(names, zip(*out, strict=True) if out else [[]] * 8, types, strict=True)})

    return spread.groupBy("token", "low", "high").applyInArrow(pair, schema)


def _rest(lists: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Untested candidate pairs whose documents are in different components and share enough prefix shingles."""
    side = lambda s: lists.where(F.col("members") <= TILE).select(
        "token", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "place", "n", "share", "component"))
    )
    near = (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b"))
    size = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    short = side("a").join(side("b"), "token").where(near & size)
    short = short.select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("place_a").alias("at_a"), F.col("place_b").alias("at_b"), "n_a", "n_b", "share_a", "share_b"
    )
    met = short.unionByName(_tiles(lists.where(F.col("members") > TILE), percent))
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("shared"), *(F.min(c).alias(c) for c in ("at_a", "at_b", "n_a", "n_b", "share_a", "share_b")))
    most = 1 + F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - F.col("at_b") - 1)  # shared from the first common one on
    enough = most * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))
    pairs = pairs.where((F.col("shared") >= F.least("share_a", "share_b")) & enough).select("a", "b")
    return pairs.join(tested, ["a", "b"], "left_anti")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_key) of every row: sets of ``words``-word shingles, linked from ``percent`` Jaccard on.

    ``set_key`` names the row's set, as ``set_name`` does, and is null for an empty one.
    """
    rows = as_bytes(docs, id_col, text_col)
    sets = _representatives(rows, words, percent)
    listed = sets.select("node", "n", "share", F.posexplode("tokens").alias("place", "token"))
    lists = listed.withColumn("members", F.count("*").over(Window.partitionBy("token"))).where("members > 1")
    lists = staged(lists, "lists")
    central = lists.groupBy("node").agg(F.sum(F.least("members", F.lit(1 << 20))).alias("weight"))
    lists = staged(lists.join(central, "node"), "lists")
    text_table = _texts(rows, sets.select("node", "key", "rep").join(central.select("node"), "node"), words)
    texts = docs.sparkSession.table(text_table)  # in buckets by node, so that no round deals the texts anew

    tested = links = first = None
    for _ in range(STAR_ROUNDS):
        stars = _stars(lists, first, percent)
        stars = staged(stars if tested is None else stars.join(tested, ["a", "b"], "left_anti"), "stars")
        found = _linked(stars, texts, words, percent)
        tested = stars if tested is None else tested.unionByName(stars)
        links = found if links is None else links.unionByName(found)
        first = components(links)

    labelled = lists.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("token")
    left = staged(labelled.join(mixed, "token").drop("weight"), "lists")
    more = _linked(_plausible(_rest(left, tested, percent), texts, percent), texts, words, percent)
    docs.sparkSession.sql(f"DROP TABLE {text_table}")
    linked = components(links.unionByName(more))

    def keys(ids: list, bodies: list[bytes]) -> pa.RecordBatch:
        found = shingle_sets(bodies, words)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(list(map(len, found)), pa.int64()), pa.array([set_key(s) if len(s) else None for s in found], pa.binary())],
            ["doc_id", "n_shingles", "key"],
        )

    members = by_block(rows, keys, "doc_id long, n_shingles long, key binary", BLOCK_BYTES)
    named = sets.join(linked, "node", "left").select("key", "rep", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_key = named.join(smallest, "component").select("key", "component_id")
    return members.join(of_key, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("key").alias("set_key"))


def set_name(text: Column, words: int = 5) -> Column:
    """The name of a text's set of shingles."""

    @F.arrow_udf("binary")
    @tidied
    def name(bodies: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in bodies:
            sets = (shingle_sets([b.as_py()], words)[0] for b in part)
            yield pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())

    return name(F.coalesce(text.cast("binary"), F.lit(b"")))
