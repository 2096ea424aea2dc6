"""Approximate nearest neighbours by a forest of random-projection trees.

Every tree splits by random directions at medians, which are fitted on a bounded sample of ``sample``
vectors; all vectors are indexed. For the largest inner product, vectors get one more component that
brings them to one length, so that nearness is an angle (queries have 0 there).

A query walks all trees at once: one priority queue holds the branches of all of them, the cheapest is
taken first, and a branch costs the squared distances by which the query lies on the other side of the
splits above it. It stops when the leaves found hold ``search`` times N**0.8 entries, N being the number of
vectors: the share of the index that a query reads falls as the index grows. Leaves are dealt to bins of at
most ``BIN`` vectors by their real sizes (a larger leaf is salted over several bins, and the questions to a
bin over copies of it, if there are many), and each bin compares its vectors to the queries that reached its
leaves. Leaf candidates are ranked again by their exact products.

Equal vectors are indexed once, with their ``k`` + 1 smallest ids, which is all that a result can hold.

Defined results: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part; rows without id neither; repeated rows count once; an id of several
vectors asks with the smallest of them, in order of components, and is found by its best; a query is never
its own result, nor is another row of its id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import staged, tidied

BIN = 16_384
LEAF = 100
#: A forest is sent to every task; so many levels bound its size.
LEVELS = 12
#: Entries that a query reads grow with this power of the number of vectors.
POWER = 0.8
#: Questions that a bin answers at once, on average.
QUESTIONS = 50_000


class Forest:
    """Directions and thresholds by tree, in heap order of the nodes; leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, trees: int, levels: int, seed: int):
        rng = np.random.default_rng(seed)
        self.levels, self.trees = levels, trees
        nodes = (1 << levels) - 1
        width = sample.shape[1]
        self.directions = rng.normal(size=(trees, nodes, width)).astype(np.float32)
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.thresholds = np.zeros((trees, nodes), np.float32)
        for t in range(trees):
            at = np.zeros(len(sample), np.int64)
            for level in range(levels):
                first = (1 << level) - 1
                for node in range(first, 2 * first + 1):
                    mine = at == node
                    if mine.any():
                        self.thresholds[t, node] = np.median(sample[mine] @ self.directions[t, node])
                at = 2 * at + 1 + self._right(sample, t, at)

    def _right(self, vectors: np.ndarray, tree: int, node: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", vectors, self.directions[tree][node]) > self.thresholds[tree][node]

    def leaves(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        at = np.zeros(len(vectors), np.int64)
        for _ in range(self.levels):
            at = 2 * at + 1 + self._right(vectors, tree, at)
        return at - ((1 << self.levels) - 1)

    def search(self, vectors: np.ndarray, sizes: np.ndarray, wanted: float) -> Iterator[list[tuple[int, int]]]:
        """For each query the (tree, leaf) that its shared queue gives, until they hold ``wanted`` entries."""
        first_leaf = (1 << self.levels) - 1
        for v in vectors:
            margins = (self.directions @ v - self.thresholds).tolist()
            queue = [(0.0, t, 0) for t in range(self.trees)]
            found: list[tuple[int, int]] = []
            held = 0
            while queue and held < wanted:
                cost, t, node = heapq.heappop(queue)
                if node >= first_leaf:
                    found.append((t, node - first_leaf))
                    held += sizes[t][node - first_leaf]
                    continue
                margin = margins[t][node]
                far = cost + margin * margin
                heapq.heappush(queue, (far if margin > 0 else cost, t, 2 * node + 1))
                heapq.heappush(queue, (cost if margin > 0 else far, t, 2 * node + 2))
            yield found


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def deal(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a tree's leaf sizes the first bin and the number of bins of each leaf: neighbours share a bin up to ``BIN`` vectors."""
    first, salts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    at, held = 0, 0
    for leaf, size in enumerate(sizes.tolist()):
        if held and held + size > BIN:
            at, held = at + 1, 0
        first[leaf], salts[leaf] = at, max(1, -(-size // BIN))
        held += size
        if salts[leaf] > 1:
            at, held = at + int(salts[leaf]), 0
    return first, salts


def nearest(
    vectors: DataFrame, is_query, k: int = 20, trees: int = 4, search: float = 6.0, sample: int = 20_000, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for which ``is_query`` (a condition on ``id``) holds."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(finite & F.exists("v", lambda x: x != 0))
    widths = v.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None:
        return spark.createDataFrame([], schema)
    width = widths["width"]
    v = v.where(F.size("v") == width)
    same = Window.partitionBy("v").orderBy("id")
    ranked = v.distinct().withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    index = staged(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("first_id", F.get("ids", F.lit(0))), "vectors")
    total, longest = index.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()

    fitted = index.orderBy(F.xxhash64("first_id"), "first_id").limit(sample).select("v").toArrow()
    base = _matrix(fitted["v"].combine_chunks(), width)
    levels = int(np.clip(np.ceil(np.log2(max(1, total / LEAF))), 1, LEVELS))
    lift = lambda m: np.concatenate([m, np.sqrt(np.maximum(0, longest - (m.astype(float) ** 2).sum(1)))[:, None].astype(np.float32)], axis=1)
    forest = spark.sparkContext.broadcast(Forest(lift(base), trees, levels, seed))
    questions = v.where(is_query).groupBy("id").agg(F.min("v").alias("v"))

    @tidied
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((trees, 1 << levels), np.int64)
        for batch in batches:
            lifted = lift(_matrix(batch.column(0), width))
            for t in range(trees):
                held[t] += np.bincount(forest.value.leaves(lifted, t), minlength=1 << levels)
        t, leaf = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(leaf.astype(np.int32)), pa.array(held[t, leaf])], ["t", "leaf", "n"])

    sizes = np.zeros((trees, 1 << levels), np.int64)
    for row in index.select("v").mapInArrow(locate, "t int, leaf int, n long").groupBy("t", "leaf").agg(F.sum("n").alias("n")).toLocalIterator():  # as many rows as leaves at most
        sizes[row["t"], row["leaf"]] = row["n"]
    first_bin, salts = zip(*map(deal, sizes), strict=True)
    plan = spark.sparkContext.broadcast((sizes.tolist(), np.array(first_bin), np.array(salts)))
    wanted = max(search * total**POWER, 4.0 * k)
    reached = questions.count() * min(1.0, wanted / (trees * total)) if total else 0
    copies = max(1, int(np.ceil(reached / QUESTIONS)))

    @tidied
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, bins_of, salts_of = plan.value
        for batch in batches:
            lifted = lift(_matrix(batch.column("v"), width))
            key = np.array(batch.column("first_id").to_numpy())
            for t in range(trees):
                leaf = forest.value.leaves(lifted, t)
                bins = (t << 40) + bins_of[t][leaf] + key % salts_of[t][leaf]
                for c in range(copies):
                    yield pa.RecordBatch.from_arrays([pa.array(bins * copies + c), pa.array(leaf.astype(np.int32)), batch.column("ids"), batch.column("v")], ["bin", "leaf", "ids", "v"])

    entries = index.mapInArrow(place, "bin long, leaf int, ids array<long>, v array<float>")

    @tidied
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bins_of, salts_of = plan.value
        for batch in batches:
            m = _matrix(batch.column("v"), width)
            flat = np.concatenate([m, np.zeros((len(m), 1), np.float32)], axis=1)
            at, bins, leaves = [], [], []
            for i, found in enumerate(forest.value.search(flat, held, wanted)):
                open_leaves: dict[int, list[int]] = {}
                for t, leaf in found:
                    for s in range(salts_of[t][leaf]):
                        open_leaves.setdefault((t << 40) + int(bins_of[t][leaf]) + s, []).append(leaf)
                at += [i] * len(open_leaves)
                bins += open_leaves.keys()
                leaves += open_leaves.values()
            taken, own = pa.array(at, pa.int64()), batch.column("id").to_numpy()[np.array(at, np.int64)]
            columns = [pa.array(np.array(bins, np.int64) * copies + own // 20 % copies), pa.array(own), pa.array(leaves, pa.list_(pa.int32())), batch.column("v").take(taken)]
            yield pa.RecordBatch.from_arrays(columns, ["bin", "id", "leaves", "v"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = questions.repartition(tasks, "id").mapInArrow(ask, "bin long, id long, leaves array<int>, v array<float>")

    def compare(rows: pa.Table, questions: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
        if not rows.num_rows or not questions.num_rows:
            return kind.empty_table()
        rows, questions = rows.combine_chunks(), questions.combine_chunks()
        m = _matrix(rows["v"].chunk(0), width).astype(np.float64)
        q = _matrix(questions["v"].chunk(0), width).astype(np.float64)
        names, leaf = np.unique(rows["leaf"].to_numpy(), return_inverse=True)
        own, leaves = questions["id"].to_pylist(), questions["leaves"].to_pylist()
        most = min(k + 1, len(m))
        out_q, out_r, out_s = [], [], []
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            open_leaf = np.zeros((len(part), len(names)), bool)
            for i, wanted in enumerate(leaves[at : at + 256]):
                open_leaf[i] = np.isin(names, wanted)
            scores = np.where(open_leaf[:, leaf], part @ m.T, -np.inf)
            least = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
            line, best = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))  # with all that tie with the last
            out_q += [own[at + i] for i in line.tolist()]
            out_r.append(best)
            out_s.append((m[best] * part[line]).sum(axis=1))
        taken = np.concatenate(out_r)
        return pa.table([pa.array(out_q, pa.int64()), rows["ids"].take(pa.array(taken)).combine_chunks(), pa.array(np.concatenate(out_s))], schema=kind)

    met = entries.groupBy("bin").cogroup(asked.groupBy("bin")).applyInArrow(compare, "query_id long, ids array<long>, score double")
    every = met.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
    one = every.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
