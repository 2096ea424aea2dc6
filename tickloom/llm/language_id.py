"""Language identification by the nearest of several centroids a language.

A text is a vector of its character n-grams of one to three letters, with the beginnings and ends of words; everything
that is no letter only parts words. N-grams are hashed to ``WIDTH`` places, weighted by the root of their count and
their inverse document frequency over all documents that may be learned from, and vectors have length one.

Each language has up to ``centroids`` centroids: spherical k-means of at most ``sample`` of its documents, drawn by a hash,
one language a group. All documents are compared with all centroids by cosine, and the nearest gives the language and the
score. A prediction is rejected if it is further from its centroid than the documents are that were learned from:
below the mean of those that fell to this centroid, in their own language, less ``spread`` standard deviations, over all of
them and not only the sample.

Texts are counted in blocks of at most ``ROWS`` rows and about ``PIECE`` bytes, and longer ones piece by piece, so memory
does not grow with a text.

Defined results: null text, and text without a letter, is ``und`` with score 0 and rejected; so is every text if there is
nothing to learn from. A row without id is predicted, but is neither learned from nor held out. Rows with a null
language teach nothing. Repeated rows are rows of their own, of which the sample may hold each; equally near
centroids go by the name of their language. An empty table gives an empty result; other columns stay as they are. More than
``most`` languages raise an error, as centroids are sent to every task.
"""

from __future__ import annotations

import codecs
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import mix, staged, tidied, unused

WIDTH = 8192
PIECE = 1 << 20
ROWS = 128
UNKNOWN = "und"
FOUND = "struct<at:int, score:double>"


@functools.cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _places(codes: np.ndarray, owner: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and hashed place of every n-gram that ends in ``codes``, and the two symbols to go on from; ``tail`` are the two before.

    A symbol is a letter, or 0 for what is between words.
    """
    symbols = np.where(letters()[codes], codes, 0)
    before = np.concatenate([tail[-1:], symbols[:-1]])
    held = (symbols != 0) | (before != 0)
    symbols, owner = symbols[held], owner[held]
    c = np.concatenate([tail, symbols]).astype(np.uint64)
    last, middle, first = c[2:], c[1:-1], c[:-2]
    two = (last << np.uint64(21)) | middle
    ones, twos, threes = last != 0, (last != 0) | (middle != 0), middle != 0
    keys = np.concatenate([last[ones], two[twos] | np.uint64(1 << 43), ((two << np.uint64(21)) | first)[threes]])
    places = (mix(keys) % np.uint64(WIDTH)).astype(np.int64)
    return np.concatenate([owner[ones], owner[twos], owner[threes]]), places, c[-2:].astype(np.uint32)


def counts(bodies: list[bytes]) -> np.ndarray:
    """How often each place occurs in each text of UTF-8 bytes; a text without letters has none."""
    n, none = len(bodies), np.zeros(2, np.uint32)
    if sum(map(len, bodies)) <= PIECE:
        texts = [f" {b.decode('utf-8', 'replace').lower()} " for b in bodies]
        owner, places, _ = _places(_codes("".join(texts)), np.repeat(np.arange(n), list(map(len, texts))), none)
        return np.bincount(owner * WIDTH + places, minlength=n * WIDTH).reshape(n, WIDTH)
    out = np.zeros((n, WIDTH), np.int64)
    for i, body in enumerate(bodies):
        decoder, tail = codecs.getincrementaldecoder("utf-8")("replace"), none
        for at in range(0, len(body) + 1, PIECE):
            end = at + PIECE > len(body)
            codes = _codes(decoder.decode(body[at : at + PIECE], end).lower() + " " * end)
            if len(codes):
                _, places, tail = _places(codes, np.zeros(len(codes), np.int64), tail)
                out[i] += np.bincount(places, minlength=WIDTH)
    return out


def _blocks(bodies: pa.Array) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for body in bodies:
        b = body.as_py() or b""
        if held and (len(held) == ROWS or size + len(b) > PIECE):
            yield held
            held, size = [], 0
        held.append(b)
        size += len(b)
    if held:
        yield held


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Vectors of length one; of a text without n-grams, zeros."""
    v = np.sqrt(found).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def spherical(vectors: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Up to ``k`` centroids of vectors of length one; each starts at the vector that is furthest from those before, the first nearest the mean."""
    chosen = [int((vectors @ vectors.mean(0)).argmax())]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < k and near.min() < 1 - 1e-6:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for _ in range(rounds):
        at = (vectors @ centroids.T).argmax(1)
        means = np.stack([vectors[at == c].mean(0) if (at == c).any() else centroids[c] for c in range(len(centroids))])
        moved = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
        if np.allclose(moved, centroids, atol=1e-7):
            break
        centroids = moved
    return centroids


class Model:
    """Inverse document frequencies, and centroids with the language of each, in order of languages."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, languages: list[str]):
        self.idf, self.centroids, self.languages = idf, centroids, languages

    def nearest(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each text, -1 for none, and the cosine."""
        found = counts(bodies)
        if not len(self.centroids):
            return np.full(len(bodies), -1), np.zeros(len(bodies))
        near = weighted(found, self.idf) @ self.centroids.T
        at = near.argmax(1)
        known = found.any(axis=1)
        return np.where(known, at, -1), np.where(known, np.clip(near[np.arange(len(at)), at], 0, 1), 0).astype(float)


def _body(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))


def fit(docs: DataFrame, sample: int = 500, centroids: int = 4, most: int = 1000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """The model of all rows of ``docs``; the centroids are of at most ``sample`` documents a language."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("chance"), _body(text_col).alias("body"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()}
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages: centroids are sent to every task")

    @tidied
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for bodies in _blocks(batch.column(0)):
                found = counts(bodies) > 0
                seen += found.sum(0)
                n += int(found.any(axis=1).sum())
        places = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *places.tolist()], pa.int32()), pa.array([n, *seen[places].tolist()], pa.int64())], ["place", "n"])

    n, seen = 0, np.zeros(WIDTH)
    for place, many in known.select("body").mapInArrow(frequencies, "place int, n long").groupBy("place").agg(F.sum("n")).collect():  # WIDTH + 1 rows
        if place < 0:
            n = many
        else:
            seen[place] = many
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + 1
    if not n:
        return Model(idf, np.zeros((0, WIDTH), np.float32), [])

    # about twice as many as wanted, so that few rows are ranked and the rank makes the bound exact
    wide = 2.0**63
    drawn = F.create_map(*(F.lit(x) for lang, size in sizes.items() for x in (lang, wide * min(1.0, 4 * sample / size) - wide)))
    drawn = known.where(F.col("chance") <= F.element_at(drawn, F.col("lang")))

    @tidied
    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for bodies in _blocks(batch.column("body")):
                found = counts(bodies)
                rows = weighted(found, idf)
                places = [np.flatnonzero(f).astype(np.int32) for f in found]
                part = batch.slice(at, len(bodies)).select(["lang", "chance"])
                at += len(bodies)
                values = [rows[i, p] for i, p in enumerate(places)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["lang", "chance", "places", "weights"])

    order = Window.partitionBy("lang").orderBy("chance", "places", "weights")
    vectors = drawn.mapInArrow(vectorise, "lang string, chance long, places array<int>, weights array<float>").where(F.size("places") > 0)
    vectors = vectors.withColumn("row", F.row_number().over(order)).where(F.col("row") <= sample)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        dense = np.zeros((len(group), WIDTH), np.float32)
        for line, places, weights in zip(dense, group["places"], group["weights"], strict=True):
            line[places] = weights
        found = spherical(dense, centroids)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": list(found)})

    found = vectors.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<float>").toPandas()  # ``centroids`` rows a language
    found["order"] = range(len(found))
    found = found.sort_values(["lang", "order"])
    return Model(idf, np.stack(found["centroid"].to_list()).astype(np.float32), found["lang"].to_list()) if len(found) else Model(idf, np.zeros((0, WIDTH), np.float32), [])


def identify(docs: DataFrame, learn: Column, spread: float = 4.0, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", carry: list[str] | None = None, **how) -> DataFrame:
    """``docs``, or its columns ``carry``, with ``lang_pred``, ``score`` and ``rejected``; only rows for which ``learn`` holds are learned from."""
    spark = docs.sparkSession
    model = fit(docs.where(learn), text_col=text_col, lang_col=lang_col, id_col=id_col, **how)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(FOUND)
    @tidied
    def nearest(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found = [sent.value.nearest(bodies) for bodies in _blocks(column)]
            at, score = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(2))
            yield pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(score.astype(float))], ["at", "score"])

    columns = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score", "rejected")]
    own, taught, right = (unused(c, docs) for c in ("found", "taught", "right"))
    taken = F.coalesce(learn & F.col(id_col).isNotNull(), F.lit(False))
    scored = staged(docs.select(*columns, taken.alias(taught), F.col(lang_col).cast("string").alias(right), nearest(_body(text_col)).alias(own)), "languages")
    names = F.array(*(F.lit(x) for x in model.languages)) if model.languages else F.array().cast("array<string>")
    predicted = F.when(F.col(f"{own}.at") >= 0, F.get(names, F.col(f"{own}.at")))
    taught_rows = scored.where(F.col(taught) & (F.col(right) == predicted)).groupBy(F.col(f"{own}.at").alias("at"))
    limits = [0.0] * len(model.languages)
    for at, mean, std in taught_rows.agg(F.avg(f"{own}.score"), F.stddev_pop(f"{own}.score")).collect():  # a row a centroid
        limits[at] = mean - spread * std
    limit = F.get(F.array(*map(F.lit, limits)), F.col(f"{own}.at")) if limits else F.lit(None).cast("double")
    rejected = F.coalesce(F.col(f"{own}.score") < limit, F.lit(True))
    return scored.select(*columns, F.coalesce(predicted, F.lit(UNKNOWN)).alias("lang_pred"), F.col(f"{own}.score").alias("score"), rejected.alias("rejected"))
