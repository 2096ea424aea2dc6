"""Hard negatives, language identification and centroid clustering against brute-force versions, on small fixtures with odd cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import centroid_clustering, hard_negatives, language_id
from tickloom.llm.common import mix

SCHEMA = "vec_id long, embedding array<double>, label int, row string, id string, v int, anchor int, block int"


def vectors(width, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=width)], int(i % 4)) for i in range(-60, 240)]
    twin = rows[110][1]
    rows += [(1000 + i, twin, i % 3) for i in range(60)]  # equal vectors and so ties
    rows += [rows[5], rows[110], (50, twin, 1), (400, [0.0] * width, 2), (401, [30_000.0, *[-1.0] * (width - 1)], 1), (450, [2.0**19 / width, *[0.5] * (width - 1)], 1)]
    odd = [None, [], [1.0], [None, *[1.0] * (width - 1)], [math.nan, *[1.0] * (width - 1)], [math.inf, *[1.0] * (width - 1)], [1e200, *[1.0] * (width - 1)], [1.0] * (width + 1)]
    rows += [(2000 + 50 * k, v, 1) for k, v in enumerate(odd)] + [(3000, twin, None), (None, twin, 1)]
    return rows


def frame(spark, rows, label=True):
    df = spark.createDataFrame([(i, v, y, "r", "i", 3, 4, 5) for i, v, y in rows], SCHEMA).repartition(3, F.rand(1))
    return df if label else df.drop("label")


def usable(rows, width, scale, most):
    for i, v, y in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(scale * c) for c in v]
            if max(map(abs, x)) <= most:
                yield i, x, y


@pytest.mark.parametrize("blocks", [False, True])
def test_hard_negatives(spark, monkeypatch, blocks):
    if blocks:  # several blocks of anchors; the driver decides on them
        monkeypatch.setattr(hard_negatives, "SENT", 1)
        monkeypatch.setattr(hard_negatives, "LINES", 7)
    rows = vectors(6)
    good = [r for r in usable(rows, 6, 256, math.isqrt(2**62 // 6)) if r[0] is not None and r[2] is not None]
    want = Counter()
    for a, (i, x, y) in enumerate(good):
        if i % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, z, strict=True)), j, l) for b, (j, z, l) in enumerate(good) if b != a)
        for s, j, _ in [r for r in scored if r[2] == y][:5]:
            inside = [(t, k) for t, k, l in scored if l != y and 50 * -s <= 100 * -t <= 95 * -s][:3]
            want.update((i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(inside))
    found = hard_negatives.mine(frame(spark, rows), F.col("id") % 50 == 0).collect()
    assert Counter(map(tuple, found)) == want and len(want) > 30


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(frame(spark, []), F.col("id") % 50 == 0).collect() == []
    assert hard_negatives.mine(frame(spark, [(0, [1.0], 1), (50, [1.0], 2), (1, None, 1)]), F.col("id") % 50 == 0).collect() == []
    assert hard_negatives.mine(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)]), F.col("id") % 50 == 0).collect() == []


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for bound in (100, 2**20, 2**28):
        a, b = (rng.integers(-bound, bound, (5, 64)) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
        assert hard_negatives.products(a.astype(float), b.astype(float)).tolist() == want


def lloyd(rows, k, rounds, scale, width):
    """Plain rounds over Python integers."""
    good = list(usable(rows, width, scale, math.isqrt(2**60 // width)))
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x, _ in good if i is not None)[:k]
    centroids = [x for _, x in first]
    far = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c, strict=True))
    nearest = lambda x: min((far(x, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        at = [nearest(x)[1] for _, x, _ in good]
        for c in range(len(centroids)):
            mine = [x for (_, x, _), a in zip(good, at, strict=True) if a == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = [(i, *reversed(nearest(x))) for i, x, _ in good]
    per = Counter()
    for _, c, d in found:
        per[c] += d
    name = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return Counter((i, c, d, per[c], sum(per.values()), name(c)) for i, c, d in found)


@pytest.mark.parametrize(("k", "rounds", "keep"), [(8, 10, 500), (3, 2, 500), (20, 6, 500), (8, 10, 5), (8, 0, 60)])
def test_clusters(spark, k, rounds, keep):
    rows = vectors(6)[-keep:] if keep != 5 else [(i, [float(i % 3)] * 6, 0) for i in range(5)]
    found = centroid_clustering.cluster(frame(spark, rows, label=False), k=k, rounds=rounds, width=6).collect()
    assert Counter(map(tuple, found)) == lloyd(rows, k, rounds, 1024, 6)


def test_clusters_of_nothing(spark):
    assert centroid_clustering.cluster(frame(spark, [])).collect() == []
    assert centroid_clustering.cluster(frame(spark, [(1, None, 0), (None, [0.5] * 64, 0)])).collect() == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("vectors_", "bounds_"))]


def test_bounds_certify_and_stay_right():
    rng = np.random.default_rng(5)
    centres = rng.integers(-3000, 3000, (24, 8))
    x = (centres[rng.integers(0, 24, 4000)] + rng.integers(-300, 300, (4000, 8))).astype(np.int64)
    x[:200] = x[0]
    centroids, kept = x[:: 4000 // 24][:24].copy(), 6
    bounds, by, spared = centroid_clustering.Bounds.unknown(len(x), kept), np.zeros(24), 0
    for _ in range(12):
        bounds.keep(kept)
        bounds.shift(by)
        work = bounds.renew(x, centroids)
        assert work[:4].sum() == len(x)
        spared += work[0]
        exact = ((x[:, None] - centroids) ** 2).sum(2)
        assert bounds.cluster.tolist() == exact.argmin(1).tolist()
        root = np.sqrt(exact.astype(float))
        assert (bounds.upper >= root[np.arange(len(x)), bounds.cluster] - 1e-9).all()
        tracked = np.zeros((len(x), 25), bool)
        tracked[np.arange(len(x))[:, None], bounds.near] = True
        tracked[np.arange(len(x)), bounds.cluster] = True
        assert (np.where(tracked[:, :24], np.inf, root).min(1) >= bounds.rest).all()
        kept = centroid_clustering.adapted(work, kept, 24)
        moved = np.stack([x[bounds.cluster == c].sum(0) // max(1, (bounds.cluster == c).sum()) if (bounds.cluster == c).any() else centroids[c] for c in range(24)])
        by, centroids = np.sqrt(((moved - centroids) ** 2).sum(1).astype(float)), moved
    assert spared > 12 * len(x) / 3


def grams(text):
    """Places of the n-grams of up to three symbols, by their definition."""
    out = Counter()
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    for w in words:
        s = [0, *map(ord, w), 0]
        for i in range(len(s)):
            for n in (1, 2, 3):
                g = s[i : i + n]
                if len(g) < n or (n == 1 and not g[0]):
                    continue
                key = g[0] if n == 1 else (g[1] << 21 | g[0] | 1 << 43) if n == 2 else ((g[2] << 21 | g[1]) << 21 | g[0])
                out[int(mix(np.array([key], np.uint64))[0] % np.uint64(language_id.WIDTH))] += 1
    return out


def test_counts_by_piece(monkeypatch):
    texts = ["", " .. ", "a", "Ünï 東京 don't", "x1y  z\n\nÉté", "the end" * 40 + " 12 " + "ends�!" * 9]
    want = [grams(t) for t in texts]
    as_counter = lambda row: Counter({int(p): int(row[p]) for p in np.flatnonzero(row)})
    bodies = [t.encode() for t in texts]
    assert [as_counter(r) for r in language_id.counts(bodies)] == want
    for piece in (1, 2, 7):
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert [as_counter(language_id.counts([b])[0]) for b in bodies] == want


TONGUES = {"aa": "baba bado dabo", "bb": "xyxi yxix", "cc": "moonu nuum ünü"}


def documents(n=240):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(TONGUES))
        pieces = [w[k : k + 2] for w in TONGUES[lang].split() for k in range(len(w) - 1)]
        rows.append((i, " ".join("".join(rng.choices(pieces, k=3)) for _ in range(rng.randint(3, 40))), lang))
    rows += [(n, None, "aa"), (n + 1, "", "bb"), (n + 2, "12 -- 9", "cc"), (n + 3, rows[0][1], None), (None, rows[0][1], "bb"), rows[0], rows[0]]
    return rows + [(n + 4, "xyxi " * 300_000, "bb")]


def test_languages(spark):
    rows = documents()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    quarter = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    schema = "doc_id long, text string, lang string, found int, taught int, right int, score string"
    docs = spark.createDataFrame([(*r, 1, 2, 3, "s") for r in rows], schema).repartition(3)
    found = language_id.identify(docs, quarter != 2, sample=20).collect()
    assert [f.name for f in docs.schema if f.name != "score"] == list(found[0].asDict())[:-3]
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter((i, t) for i, t, _ in rows)
    known = {(i, t): x for i, t, x in rows if x}
    for r in found:
        if r["text"] is None or not any(map(str.isalpha, r["text"])):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        assert r["lang_pred"] in TONGUES and 0 < r["score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] != 243:
            assert r["lang_pred"] == known[r["doc_id"], r["text"]] and not (r["rejected"] and 40 < len(r["text"]) < 1000)
    lied = docs.withColumn("lang", F.when(quarter == 2, F.lit("zz")).otherwise(F.col("lang")))
    key = lambda rs: Counter((r["doc_id"], r["lang_pred"], r["score"], r["rejected"]) for r in rs)
    assert key(language_id.identify(lied, quarter != 2, sample=20).collect()) == key(found)
    strange = docs.withColumn("text", F.when(F.col("doc_id") == 3, "qqq www qqqw").otherwise(F.col("text"))).where("doc_id != 3 or text is not null")
    (row,) = [r for r in language_id.identify(strange, (quarter != 2) & (F.col("doc_id") != 3), sample=20).collect() if r["doc_id"] == 3]
    assert row["rejected"] and row["lang_pred"] in TONGUES
    assert any(held(r["doc_id"]) for r in found)


def test_languages_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.identify(empty, F.lit(True)).collect() == []
    mute = spark.createDataFrame([(1, "words", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert {tuple(r)[3:] for r in language_id.identify(mute, F.lit(True)).collect()} == {("und", 0.0, True)}
    with pytest.raises(ValueError, match="languages"):
        language_id.identify(spark.range(9).selectExpr("id as doc_id", "'x' as text", "cast(id as string) as lang"), F.lit(True), most=5)


def test_held_out_accuracy(spark):
    from tickloom.llm.queries import op12_language_id

    folder = "/root/testdata/sf0.01"
    found = op12_language_id(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right >= 0.98 * n
