"""Quality classifier: document evidence combined with site posteriors by hierarchical empirical Bayes.

Two logistic models, for quality and for toxicity, are fitted on a bounded sample of labelled rows
(``sample`` documents). Their inputs are the words, word beginnings and marks of a text that the sample
shows to go with a label, and binned shares of symbols, capitals and repeated words. A model's log odds
less those of its base rate are the evidence that a document gives by itself.

Sites come in two levels, host (``source``) and path (``source`` and ``lang``). Grouped aggregation over
all documents gives each site the sum of its documents' probabilities. A host's rate is shrunk towards the global
one, and a path's towards its host's, by beta priors whose strengths are estimated from the spread of
the rates over sites, so that sparse sites follow their parents. A document's own probability is taken out
of the rates of its sites and of the global one, so that its evidence counts once: its posterior log odds
are its evidence plus those of what the others say of its path.

Each text is scored once: evidence is written with the carried columns before sites are summed up.

Defined results: null text is an empty text; a null host or path is a site; repeated rows each get their
row and stand for each other in the rates; of labels of one id one counts, by order of its values, and
those with a null do not; without usable labels of both kinds a model gives no evidence and the rate one
half, and documents are kept; an empty table gives an empty result; other columns stay as they are in
``with_posteriors``, except ``p_quality`` and ``p_toxic``, which it sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import blocks, staged, text_of, tidied, unused

BLOCK_BYTES = 4 << 20
#: Site tables of at most so many rows are sent to the tasks; larger ones are joined by shuffling.
FEW_SITES = 20_000
EDGE = ".,;:!?\"'()"
MARKS = re.compile(r"[^\w\s]+\Z")


def _word_features(word: str) -> tuple[int, ...]:
    low = word.lower()
    core = low.strip(EDGE)
    names = ["=" + core]
    names += ["^" + core[:n] for n in (4, 5, 6) if len(core) > n]
    if (m := MARKS.search(word)) and m.group() not in EDGE:
        names.append("$" + m.group()[:3])
    return tuple(xxhash.xxh64_intdigest(n) >> 1 for n in names)


def _shape_features(text: str, words: list[str]) -> list[int]:
    n = max(1, len(words))
    letters = sum(map(str.isupper, words)) / n
    symbols = sum(map(text.count, "#*$%&|<>")) / n
    distinct = len(set(words)) / n
    shares = {"upper": letters, "symbols": symbols, "distinct": distinct}
    names = [f"#{k}{min(10, int(10 * v))}" for k, v in shares.items()] + [f"#words{min(12, len(words).bit_length())}"]
    return [xxhash.xxh64_intdigest(x) >> 1 for x in names]


class Features:
    """Distinct features of texts; those of words are kept in a table of bounded size."""

    LIMIT = 100_000

    def __init__(self, wanted: dict[int, int] | None = None):
        self.wanted = wanted
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        found = _word_features(word)
        if self.wanted is not None:
            found = tuple(self.wanted[f] for f in found if f in self.wanted)
        if len(self.known) >= self.LIMIT:
            self.known.clear()
        self.known[word] = found
        return found

    def __call__(self, body: bytes) -> list[int]:
        text = text_of(body)
        words = text.split()
        out: set[int] = set()
        get = self.known.get
        for w in set(words):
            f = get(w)
            if f is None:
                f = self._of(w)
            if f:
                out.update(f)
        shape = _shape_features(text, words)
        out.update(shape if self.wanted is None else (self.wanted[f] for f in shape if f in self.wanted))
        return list(out)


@dataclass(frozen=True)
class Model:
    """Weights of the chosen features for each target, and the log odds of its base rate."""

    index: dict[int, int]
    weights: np.ndarray
    bias: np.ndarray
    base: np.ndarray

    def evidence(self, features: list[int]) -> np.ndarray:
        return self.weights[:, features].sum(axis=1) + self.bias - self.base


TARGETS = ("quality", "toxic")


def _log_odds(p):
    return np.log(p) - np.log1p(-p)


def fit_logistic(rows: np.ndarray, columns: np.ndarray, n: int, width: int, y: np.ndarray, steps: int = 100, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full gradient steps with momentum; (rows, columns) are the places of the ones."""
    w, b = np.zeros(width), float(_log_odds(y.mean()))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[columns], n) + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(columns, error[rows], width) / n + ridge * w, error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - change[:-1], b - change[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, features: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits both models on at most ``sample`` labelled documents, with at most ``features`` features a target."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), *(F.col(t).cast("int").alias(t) for t in TARGETS)).dropna()
    known = known.groupBy("id").agg(F.min(F.struct(*TARGETS)).alias("y")).select("id", "y.*").orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    # ``sample`` rows of three numbers at most are broadcast; the texts that they label are kept, so that all are read once
    train = staged(texts.join(F.broadcast(known), "id").select("body", *TARGETS), "train")

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
        for batch in batches:
            pairs = pa.array(list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)), pa.list_(pa.int32()))
            yield from blocks([pa.RecordBatch.from_arrays([pairs, batch.column(0)], ["y", "body"])], BLOCK_BYTES)

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Features()
        for ys, bodies in labelled(batches):
            each = [find(b) for b in bodies]
            flat = np.fromiter((f for fs in each for f in fs), np.int64)
            names, at = np.unique(flat, return_inverse=True)
            y = np.repeat(np.array(ys), list(map(len, each)), axis=0)
            n = np.bincount(at, minlength=len(names))
            hits = [np.bincount(at, y[:, t], len(names)).astype(np.int64) for t in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names, n, *hits)], ["f", "n", *TARGETS])

    totals = train.agg(F.count("*").alias("n"), *(F.sum(t).alias(t) for t in TARGETS)).first()
    n = totals["n"]
    rates = [(totals[t] or 0) / n if n else 0.5 for t in TARGETS]
    counted = train.mapInArrow(count, "f long, n long, quality long, toxic long").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("n", *TARGETS)))
    counted = staged(counted.where(f"n >= {5 if n > 2000 else 3}"), "features")
    chosen: set[int] = set()
    for t, rate in zip(TARGETS, rates, strict=True):
        score = F.abs(F.col(t) - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)) + 1)
        chosen |= {r["f"] for r in counted.orderBy(F.desc(score), "f").limit(features).collect()}
    index = {f: i for i, f in enumerate(sorted(chosen))}
    sent = docs.sparkSession.sparkContext.broadcast(index)

    @tidied
    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Features(sent.value)
        for ys, bodies in labelled(batches):
            each = [find(b) for b in bodies]
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.list_(pa.int32())), pa.array(each, pa.list_(pa.int32()))], ["y", "fs"])

    table = train.mapInArrow(active, "y array<int>, fs array<int>").toArrow().combine_chunks()
    weights, bias = np.zeros((2, max(1, len(index)))), np.zeros(2)
    base = np.zeros(2)
    if n:
        y = table["y"].combine_chunks().flatten().to_numpy().reshape(-1, 2)
        order = np.lexsort(y.T[::-1])  # sums in one order, whatever the tasks' order
        lists = [table["fs"][int(i)].values.to_numpy() for i in order]
        rows = np.repeat(np.arange(len(lists)), list(map(len, lists)))
        columns = np.concatenate(lists)
        for t, rate in enumerate(rates):
            if 0 < rate < 1:
                base[t] = _log_odds(rate)
                weights[t], bias[t] = fit_logistic(rows, columns, len(lists), len(index), y[order, t].astype(float))
    return Model(index, weights, bias, base)


def _strengths(sites: DataFrame, parent: str) -> dict[str, float]:
    """For each target the strength of a beta prior around the rates in ``<target><parent>``.

    It is the moment estimate from the spread of raw rates around their parents' over what binomial noise
    alone would give; no more spread than that means full shrinkage.
    """
    n, aggs = F.col("n"), [F.sum("n").alias("n"), F.sum(F.col("n") ** 2).alias("n2")]
    for t in TARGETS:
        raw, p = F.col(t) / n, F.col(t + parent)
        aggs += [F.sum(n * (raw - p) ** 2).alias(f"{t}_between"), F.sum(p * (1 - p)).alias(f"{t}_noise"), F.avg(p * (1 - p)).alias(f"{t}_var")]
    found = sites.agg(*aggs).first()
    out = {}
    for t in TARGETS:
        room = found["n"] - found["n2"] / found["n"] if found["n"] else 0
        variance = max(0.0, (found[f"{t}_between"] - found[f"{t}_noise"]) / room) if room > 0 else 0.0
        out[t] = min(1e9, max(1.0, found[f"{t}_var"] / variance - 1)) if variance > 0 else 1e9
    return out


def site_sums(scored: DataFrame, host: str, path: str, chance: dict[str, Column]) -> tuple[DataFrame, dict[str, float], dict[str, float], dict[str, float]]:
    """The table (host, path, n, sums, host_n, host sums) of all paths; global sums; strengths for hosts and for paths."""
    summed = scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n"), *(F.sum(chance[t]).alias(t) for t in TARGETS))
    paths = staged(summed, "paths")
    hosts = staged(paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", *TARGETS))), "hosts")
    row = hosts.agg(*(F.sum(c).alias(c) for c in ("n", *TARGETS))).first()
    every = {c: row[c] or 0 for c in ("n", *TARGETS)}
    rate = {t: (every[t] + 0.5) / (every["n"] + 1) for t in TARGETS}
    of_hosts = _strengths(hosts.withColumns({f"{t}_global": F.lit(rate[t]) for t in TARGETS}), "_global")
    shrunk = {f"{t}_host": (F.col(t) + of_hosts[t] * rate[t]) / (F.col("n") + of_hosts[t]) for t in TARGETS}
    named = hosts.withColumns(shrunk).select(F.col("host").alias("h"), F.col("n").alias("host_n"), *(F.col(t).alias(f"host_{t}") for t in TARGETS), *shrunk)
    joined = paths.join(named, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return joined, every, of_hosts, _strengths(joined, "_host")


def with_posteriors(
    docs: DataFrame, model: Model, text_col: str = "text", host_col: str = "source", path_col: str = "lang", carry: list[str] | None = None
) -> DataFrame:
    """``docs``, or its columns ``carry``, with ``p_quality`` and ``p_toxic``, and all rows as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<quality:double,toxic:double>")
    @tidied
    def evidence(bodies: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = Features(sent.value.index)
        for batch in bodies:
            e = np.array([sent.value.evidence(find(b.as_py())) for b in batch]).reshape(-1, 2)
            yield pa.StructArray.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], list(TARGETS))

    columns = [c for c in (docs.columns if carry is None else carry) if c not in ("p_quality", "p_toxic")]
    own, host, path = (unused(n, docs) for n in ("evidence", "host", "path"))
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    scored = docs.select(*columns, F.col(host_col).alias(host), F.col(path_col).alias(path), evidence(body).alias(own))
    scored = staged(scored, "evidence")
    base = dict(zip(TARGETS, model.base.tolist(), strict=True))
    chance = {t: 1 / (1 + F.exp(-(F.col(f"{own}.{t}") + base[t]))) for t in TARGETS}
    sites, every, of_hosts, of_paths = site_sums(scored, host, path, chance)
    prefix = unused("site", docs)
    sites = staged(sites.select(*(F.col(c).alias(f"{prefix}_{c}") for c in ("host", "path", "n", *TARGETS, "host_n", *(f"host_{t}" for t in TARGETS)))), "sites")
    side = F.broadcast(sites) if sites.count() <= FEW_SITES else sites
    joined = scored.join(side, F.col(host).eqNullSafe(F.col(f"{prefix}_host")) & F.col(path).eqNullSafe(F.col(f"{prefix}_path")), "left")
    out = {}
    for t in TARGETS:
        others = lambda total: F.greatest(total - chance[t], F.lit(0.0))  # noqa: B023, E731
        above = (others(F.lit(float(every[t]))) + 0.5) / max(1, every["n"])
        of_host = (others(F.col(f"{prefix}_host_{t}")) + of_hosts[t] * above) / (F.col(f"{prefix}_host_n") - 1 + of_hosts[t])
        rate = (others(F.col(f"{prefix}_{t}")) + of_paths[t] * of_host) / (F.col(f"{prefix}_n") - 1 + of_paths[t])
        rate = F.least(F.greatest(rate, F.lit(1e-9)), F.lit(1 - 1e-9))
        out[f"p_{t}"] = 1 / (1 + F.exp(-(F.col(f"{own}.{t}") + F.log(rate) - F.log1p(-rate))))
    return joined.select(*columns, *(v.alias(k) for k, v in out.items()))


def kept() -> Column:
    """The verdict on rows with posteriors; toxicity is the costlier miss, so it needs less certainty."""
    return (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.3)
