"""Isolation forests, and routing among experts by the posteriors of a mixture.

Each tree is built from its own bounded sample of rows, one tree a group; the trees together are a table of at most
``trees`` * 2 * ``sample`` nodes, which is sent to all tasks. All rows are scored by the mean length of their paths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODES = "tree int, node int, feature int, threshold double, yes int, no int, size int"


def usual_length(n: int) -> float:
    """The mean length of an unsuccessful search among ``n`` values."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grown(rows: np.ndarray, depth: int, rng: np.random.Generator) -> list[tuple[int, float, int, int, int]]:
    """A tree's nodes (feature, threshold, child below, child from there on, rows); a leaf has feature -1."""
    nodes: list = []
    waiting = [(rows, 0, None, 0)]
    while waiting:
        part, level, above, side = waiting.pop()
        me = len(nodes)
        if above is not None:
            nodes[above][2 + side] = me
        spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) else []
        if level >= depth or len(part) < 2 or not len(spread):
            nodes.append([-1, 0.0, -1, -1, len(part)])
            continue
        feature = int(rng.choice(spread))
        low, high = part[:, feature].min(), part[:, feature].max()
        threshold = float(rng.uniform(low, high))
        threshold = threshold if threshold > low else float(high)  # both sides have rows
        nodes.append([feature, threshold, -1, -1, len(part)])
        below = part[:, feature] < threshold
        waiting += [(part[~below], level + 1, me, 1), (part[below], level + 1, me, 0)]
    return [tuple(n) for n in nodes]


@dataclass
class Forest:
    """Trees as arrays by node, and how many rows each was built from at most."""

    columns: tuple[str, ...]
    trees: list[np.ndarray]
    sample: int

    def lengths(self, x: np.ndarray) -> np.ndarray:
        """Mean path lengths of rows."""
        total = np.zeros(len(x))
        for t in self.trees:
            feature, threshold, yes, no, size = t.T
            left = np.array([usual_length(int(n)) for n in size])
            at, level = np.zeros(len(x), int), np.zeros(len(x))
            going = np.flatnonzero(feature[at] >= 0)
            while len(going):
                here = at[going]
                below = x[going, feature[here].astype(int)] < threshold[here]
                at[going] = np.where(below, yes[here], no[here]).astype(int)
                level[going] += 1
                going = going[feature[at[going]] >= 0]
            total += level + left[at]
        return total / max(1, len(self.trees))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 2.0 ** (-self.lengths(x) / max(usual_length(self.sample), 1e-12))


def fit(df: DataFrame, columns: tuple[str, ...], trees: int = 50, sample: int = 256, seed: int = 42) -> Forest:
    """A forest of the rows that lack no value. Rows are drawn for each tree by a hash of their values, so reruns agree; of equal rows all or none are drawn."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).where(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in columns))
    n = rows.count()
    if not n:
        return Forest(columns, [], 0)
    bound = min(1.0, 2 * sample / n) * 2.0**64 - 2.0**63
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(*columns, t, F.lit(seed)) <= bound)
    dealt = rows.withColumn("tree", F.explode(drawn))  # about 2 * ``sample`` rows a tree
    order = Window.partitionBy("tree").orderBy(F.xxhash64(*columns, "tree", F.lit(seed + 1)), *columns)
    dealt = dealt.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    depth = max(1, math.ceil(math.log2(min(sample, n))))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        nodes = grown(group.sort_values("place")[list(columns)].to_numpy(), depth, np.random.default_rng((seed, tree)))
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "yes", "no", "size"])
        return out.assign(tree=tree, node=range(len(out)))[["tree", "node", "feature", "threshold", "yes", "no", "size"]]

    found = dealt.groupBy("tree").applyInPandas(build, NODES).toPandas().sort_values(["tree", "node"])
    return Forest(columns, [g[["feature", "threshold", "yes", "no", "size"]].to_numpy(float) for _, g in found.groupby("tree")], min(sample, n))


def score(df: DataFrame, forest: Forest, name: str = "anomaly") -> DataFrame:
    """``df`` with the score of each row, from 0 to 1 and highest for what is soonest alone; null for rows that lack a value."""
    sent = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def of(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            x = np.column_stack([c.to_numpy(float) for c in part])
            known = ~np.isnan(x).any(axis=1)
            out = np.full(len(x), np.nan)
            if sent.value.trees and known.any():
                out[known] = sent.value.scores(x[known])
            yield pd.Series(out).astype(object).where(known, None) if not known.all() else pd.Series(out)

    return df.withColumn(name, F.nanvl(of(*(F.col(c).cast("double") for c in forest.columns)), F.lit(None).cast("double")))


def mixture(df: DataFrame, columns: tuple[str, ...], experts: int, seed: int = 42, rounds: int = 50) -> GaussianMixtureModel:
    """A mixture of normal distributions over rows that lack no value; it can be saved and loaded."""
    rows = VectorAssembler(inputCols=list(columns), outputCol="__mixed", handleInvalid="skip").transform(df)
    return GaussianMixture(featuresCol="__mixed", probabilityCol="__share", predictionCol="__part", k=experts, seed=seed, maxIter=rounds).fit(rows)


def routed(df: DataFrame, model: GaussianMixtureModel, columns: tuple[str, ...], experts: list[Column], name: str = "routed") -> DataFrame:
    """``df`` with the experts' values, each weighted by the chance that the row is of its part of the mixture."""
    rows = VectorAssembler(inputCols=list(columns), outputCol="__mixed", handleInvalid="keep").transform(df)
    share = vector_to_array("__share")
    blend = sum((F.get(share, F.lit(k)) * e for k, e in enumerate(experts)), F.lit(0.0))
    return model.transform(rows).withColumn(name, blend).select(*df.columns, name)
