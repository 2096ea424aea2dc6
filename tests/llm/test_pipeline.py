"""The corpus pipeline on the small tables, every stage against a brute-force version on what came in."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import oracles, quality_classifier

DATA = "/root/testdata/sf0.001"
BLANK = r"[^\x20\x09-\x0D]+"


def rules(rows):
    con = duckdb.connect()
    frame = rows.assign(doc_id=range(len(rows)))
    con.register("documents", frame)
    kept = con.execute(oracles.rules_sql()).df().set_index("doc_id")["kept"]
    return rows[[bool(kept[i]) for i in range(len(rows))]]


def classifier(rows, model):
    """Evidence of each text, and rates of its path and host without it, one document after the other."""
    find = quality_classifier.Features(model.index)
    e = np.array([model.evidence(find((t or "").encode())) for t in rows["text"]])
    p = 1 / (1 + np.exp(-(e + model.base)))
    host, path = rows["source"].to_numpy(), list(zip(rows["source"], rows["lang"], strict=True))
    ok = np.ones(len(rows), bool)
    for t, limit in enumerate((0.5, 0.3)):
        x, n = p[:, t], len(rows)

        def strength(groups, parents, x=x):
            members = defaultdict(list)
            for g, v in zip(groups, x, strict=True):
                members[g].append(v)
            sizes = np.array([len(v) for v in members.values()], float)
            raw, above = np.array([np.mean(v) for v in members.values()]), np.array([parents[g] for g in members])
            room = sizes.sum() - (sizes**2).sum() / sizes.sum()
            spread = (sizes * (raw - above) ** 2).sum() - (above * (1 - above)).sum()
            variance = max(0.0, spread / room) if room > 0 else 0.0
            return min(1e9, max(1.0, (above * (1 - above)).mean() / variance - 1)) if variance > 0 else 1e9

        rate = (x.sum() + 0.5) / (n + 1)
        of_hosts = strength(host, {h: rate for h in host})
        shrunk = {h: (x[host == h].sum() + of_hosts * rate) / ((host == h).sum() + of_hosts) for h in set(host)}
        of_paths = strength(path, {q: shrunk[q[0]] for q in path})
        for i in range(n):
            mine, same = host == host[i], np.array([q == path[i] for q in path])
            above = (x.sum() - x[i] + 0.5) / n
            of_host = (x[mine].sum() - x[i] + of_hosts * above) / (mine.sum() - 1 + of_hosts)
            r = (x[same].sum() - x[i] + of_paths * of_host) / (same.sum() - 1 + of_paths)
            posterior = 1 / (1 + np.exp(-(e[i, t] + np.log(r) - np.log1p(-r))))
            ok[i] &= posterior >= limit if t == 0 else posterior < limit
    return rows[ok]


def near_copies(rows):
    words = [re.findall(BLANK, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in rows["text"]]
    sets = [{tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    ids, group = rows["doc_id"].tolist(), list(range(len(rows)))
    for a in range(len(sets)):
        for b in range(a):
            if group[a] != group[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min(i for i, h in zip(ids, group, strict=True) if h == g) for g in set(group)}
    return rows[[not s or i == least[g] for i, s, g in zip(ids, sets, group, strict=True)]]


def repeats(rows):
    bodies = [(t or "").encode() for t in rows["text"]]
    starts = Counter(b[i : i + 400] for b in bodies for i in range(len(b) - 399))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 399):
            if starts[b[s : s + 400]] > 1:
                gone[s : s + 400] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore"))
    left = rows.assign(text=out, n_chars=list(map(len, out)))
    return left[[bool(t.strip(" ")) for t in out]]


def same(found, wanted):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(map(tuple, found[names].to_numpy().tolist())) == Counter(map(tuple, wanted[names].to_numpy().tolist()))


def test_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    stages = [f for _, f in pipeline.STAGES]
    for k, stage in enumerate(stages[:-1]):
        before = docs.toPandas()
        model = quality_classifier.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet")) if k == 1 else None
        docs = stage(spark, docs, DATA).persist()
        after = docs.toPandas()
        assert docs.columns == columns and 0 < len(after) <= len(before)
        same(after, classifier(before, model) if k == 1 else (rules, None, near_copies, repeats)[k](before))
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    lengths = {r["doc_id"]: len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()}
    packed = stages[-1](spark, docs, DATA).toPandas()
    assert packed.groupby("doc_id")["length"].sum().to_dict() == lengths
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_near_copies_of_repeated_ids(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(6)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    a, b, c = words(60), words(60), words(60)
    near = a + " more"
    rows = [(1, a), (2, near), (2, b), (3, c), (3, c), (None, a), (4, ""), (4, ""), (5, None), (1, near)]
    made = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, key int, digest int")
    found = pipeline.near_copies(spark, made, "").collect()
    kept = Counter((r["doc_id"], r["text"]) for r in found)
    assert sum(kept[1, t] for t in (a, near)) == 1 and kept[2, near] == kept[None, a] == 0
    assert kept[2, b] == kept[3, c] == kept[4, ""] == kept[5, None] == 1 and len(found) == 5


def test_empty_table(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.where(F.lit(True)).count() == 0
