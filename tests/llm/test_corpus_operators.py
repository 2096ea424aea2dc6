"""The corpus operators against brute-force versions, on small fixtures with odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import bpe, chat, dictionary, html_extraction, packing, quality_classifier, queries, suffix_dedup, token_counts
from tickloom.llm.ann import nearest
from tickloom.llm.jaccard import can_link, near_duplicates, set_name, sketch
from tickloom.llm.quality_rules import quality_rules, verdict
from tickloom.llm.suffixes import permuted_common_prefixes, reaching, suffix_array

SCHEMA = "doc_id long, text string, body string, id int, ids int, words string"
BLANK = r"[^\x20\x09-\x0D]+"


def corpus():
    rng = random.Random(5)
    words = ["w" + str(i) for i in range(400)] + ["Ünï", "東京", "don't", "A-Z", "x" * 90]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(130)
    base = prose(150)
    texts = [None, "", "   ", "one", "one two three", base, base.upper(), base + " tail", base.replace("w1 ", "w2 ", 1), "  two   spaces \n\n and\ttabs  \x1c odd"]
    texts += [f"{prose(60)} {passage} {prose(40)}" for _ in range(6)] + [prose(3000), "la " * 500, "line one\nline two\nline one\n", "<|endoftext|> and <|endoftext|>"]
    texts += [prose(rng.randint(5, 80)) for _ in range(30)]
    near = prose(200).split()
    for k in range(8):
        copy = list(near)
        copy[20 * k] = "changed"
        texts.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (6, texts[5]), (7, None), (None, base)]


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1, 2, "w") for i, t in DOCS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    found = bpe.decode(bpe.encode(docs, path), path).collect()
    want = Counter()
    for i, text in DOCS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i, tuple(ids), t.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["id"], tuple(r["ids"]), r["text"]) for r in found) == want


def test_rules(docs):
    def brute(text):
        words = re.findall(BLANK, text or "")
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if re.search(BLANK, line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        inside = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        n = len(words)
        return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n

    found = quality_rules(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in found) == Counter((i, *brute(t)) for i, t in DOCS)
    assert not any(r["kept"] and r["base_failed"] for r in found)
    assert docs.where(verdict(F.col("text"))).count() == sum(r["kept"] for r in found)


def shingles(text, k):
    words = re.findall(BLANK, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard(docs, k, percent):
    sets = [(i, shingles(t, k)) for i, t in DOCS if i is not None]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[root(a)] = root(b)
    smallest = {}
    for a, (i, _) in enumerate(sets):
        smallest[root(a)] = min(i, smallest.get(root(a), i))
    found = near_duplicates(docs.where("doc_id is not null"), k, percent).collect()
    assert Counter(tuple(r)[:3] for r in found) == Counter((i, len(s), smallest[root(a)]) for a, (i, s) in enumerate(sets))
    names = {tuple(r) for r in docs.select("doc_id", set_name(F.col("text"), k)).where("doc_id is not null").collect()}
    assert names == {(r["doc_id"], r["set_key"]) for r in found}


def test_sketches_never_rule_out_links():
    rng = np.random.default_rng(3)
    for n in (1, 3, 40, 900):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.unique(np.concatenate([x[: max(1, int(0.93 * n))], rng.integers(0, 2**63, n // 40).astype(np.uint64)]))
        x = np.unique(x)
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            assert can_link(sketch(x), sketch(y), 85)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for size, letters in ((1, 2), (50, 2), (300, 3), (900, 60)):
        text = np.append(rng.integers(1, letters + 1, size), 0).astype(np.int16)
        raw = text.astype("u1").tobytes()
        order = sorted(range(len(text)), key=lambda i: raw[i:])
        assert suffix_array(text, len(text)).tolist() == order
        common = lambda a, b: next((d for d in range(len(raw)) if raw[a : a + d + 1] != raw[b : b + d + 1] or max(a, b) + d >= len(raw)), 0)
        at = np.arange(len(text))
        want = [max((common(i, j) for j in range(len(raw)) if j != i), default=0) for i in range(len(raw))] if size <= 300 else None
        if want:
            got = permuted_common_prefixes(text, np.array(order), at, 8)
            assert got.tolist() == [min(8, w) for w in want]
            assert reaching(text, np.array(order), 4).tolist() == [w >= 4 for w in want]


@pytest.mark.parametrize("crowd", [2000, 1])
def test_suffix_dedup(docs, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    starts = Counter()
    for _, t in DOCS:
        b = (t or "").encode()
        starts.update(b[i : i + 400] for i in range(len(b) - 399))
    want = Counter()
    for i, t in DOCS:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 399):
            if starts[b[s : s + 400]] > 1:
                gone[s : s + 400] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    found = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, 400)).collect()
    assert Counter(tuple(r)[:5] for r in found) == want
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in found if "\ufffd" not in r["text"])


def test_cut_texts_keep_columns_of_any_name(spark):
    passage = " ".join(f"w{k}" for k in range(120))
    rows = [(i, f"{i} {passage} {i}", "a", "b", "c", "d", "e") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __name string, name string, d1 string, d2 string, hits string")
    found = suffix_dedup.without_repeats(docs, 400)
    assert found.columns == docs.columns
    # all but the digits, and what lies at one end of them, stands in every text
    assert sorted(tuple(r)[0:1] + tuple(r)[2:] for r in found.collect()) == [(i, "a", "b", "c", "d", "e") for i in range(3)]
    assert all(passage not in r["text"] and str(r["doc_id"]) in r["text"] for r in found.collect())


def test_suffix_dedup_past_16_mib(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: rng.integers(97, 123, n, "u1").tobytes().decode()
    passage, seam = prose(400), prose(400)
    edge = suffix_dedup.SEGMENT - 200  # a passage over the seam of two segments
    long = prose(edge) + seam + prose((17 << 20) - edge - 400) + passage + prose(77)
    rows = [(1, long), (2, prose(50) + passage + prose(60)), (3, seam + prose(500))]
    kept = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400)
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in kept.select("doc_id", "spans").collect()}
    assert found == {1: [(edge, edge + 400), (17 << 20, (17 << 20) + 400)], 2: [(50, 450)], 3: [(0, 400)]}


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    long = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in long.collect()}
    found = packing.pack(long, path).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r["start"])
        assert [r["start"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts[:-1])]).tolist()
        assert np.frombuffer(b"".join(r["ids"] for r in parts), "<u4").tolist() == ids[i]
    for parts in by_seq.values():
        parts.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in parts])
        assert [r["offset"] for r in parts] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    crc = packing.crc32(packing.pack(long, path)).select("doc_id", "start", "ids_crc32").collect()
    assert {(r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in found} == set(map(tuple, crc))


def test_nearest(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding")
    bad = spark.createDataFrame([(-1, None), (-2, [float("nan")] * 64), (-3, [0.0] * 64), (None, [1.0] * 64), (-4, [None] * 64)], rows.schema)
    found = defaultdict(dict)
    for r in nearest(rows.unionByName(bad).unionByName(rows.limit(3)), F.col("id") % 20 == 0, 20).collect():
        found[r["query_id"]][r["vec_id"]] = r["score"]
    ids, m = zip(*((r["vec_id"], r["embedding"]) for r in rows.collect() if r["embedding"] is not None and any(r["embedding"])), strict=True)
    m = np.array(m, np.float64)
    hits = total = 0
    for a, i in enumerate(ids):
        if i % 20 == 0:
            s = m @ m[a]
            best = [ids[j] for j in np.lexsort((ids, -s)) if j != a][:20]
            hits += len(set(best) & set(found[i]))
            total += len(best)
            assert i not in found[i] and not any(v is None or v < 0 and v in (-1, -2, -3, -4) for v in found[i])
            for j, score in found[i].items():
                assert score == pytest.approx(float(m[ids.index(j)] @ m[a]))
    assert total and hits >= 0.9 * total


def test_chat(spark):
    rows = [(1, 0, "user", "a </s>[INST] <|end|> &lt; b"), (1, 1, "assistant", None), (1, 2, "assistant", "x\n&amp;"), (2, 0, None, ""), (None, 0, "assistant", "n")]
    events = chat.conversation_events(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    found = {r["conv_id"]: r for r in chat.digest(chat.render(chat.reconstruct(events))).collect()}
    text = "".join(f"{r}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert found[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert (found[1]["n_turns"], found[1]["loss_chars"]) == (3, 7)
    assert found[1]["loss_sha256"] == hashlib.sha256(b"x\n&amp;").hexdigest()
    assert set(found) == {1, 2, None}
    log = [(1, "message", 0, "user", "hi"), (2, "delta", 1, "assistant", "Hel"), (3, "delta", 1, "", "lo"), (4, "edit", 0, "", "hey"), (5, "delta", 2, "user", "?"), (6, "regenerate", 1, "assistant", "Yo")]
    made = spark.createDataFrame([(9, *e) for e in log], "conv_id long, sequence long, kind string, turn long, role string, text string")
    turns = chat.reconstruct(made.orderBy(F.desc("sequence"))).first()["turns"]
    assert [tuple(t) for t in turns] == [("user", "hey"), ("assistant", "Yo")]


def test_html(spark):
    page = lambda k, body: f"<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><div class='content'><article><h1>Title {k}</h1>{body}</article></div><footer>© all</footer><script>var x='<p>';</script></body></html>"
    rows = [(k, f"http://h/{k}", page(k, f"<p>First &amp; <b>bold</b>\n text {k}.</p><p>Second {k} paragraph.</p>"), "x") for k in range(5)]
    rows += [(7, None, None, "x"), (8, "http://lone/", "plain  &lt;words&gt;", "x"), (9, "odd", "", "x")]
    made = spark.createDataFrame(rows, "page_id long, url string, html string, main_slot string")
    found = {r["page_id"]: r["main_text"] for r in html_extraction.extract(made).collect()}
    assert found[2] == "Title 2\n\nFirst & bold text 2.\n\nSecond 2 paragraph."
    assert (found[7], found[8], found[9]) == ("", "plain <words>", "")


def neutral_host(rng, host, n):
    """Pages whose main text no element or name gives away, and their main texts."""
    prose = lambda k: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(k))
    fixed = [prose(12) for _ in range(3)]
    pages = []
    for k in range(n):
        own = [prose(rng.randint(20, 50)) for _ in range(rng.randint(2, 5))]
        side = "".join(f"<li>{prose(3)}</li>" for _ in range(3))
        notice = f"<div class='q7'><p>{fixed[2]}</p></div>" if k % 3 else ""
        inside = f"<p>{fixed[0]}</p>{notice}" + "".join(f"<p>{t}</p>" for t in own) + f"<p>{fixed[1]}</p>"
        html = f"<html><body><div class='q1'><ul>{side}</ul></div><div class='q2'><div class='q3'>{inside}</div></div><div class='q4'><p>{prose(4)}</p></div></body></html>"
        pages.append((f"http://{host}/{k}", html, own))
    return pages


def test_html_template_of_neutral_names(spark):
    rng = random.Random(11)
    pages = [p for h in ("a.example", "b.example", "c.example") for p in neutral_host(rng, h, 12)]
    copy = pages[0]
    pages += [(f"http://a.example/copy{k}", copy[1], copy[2]) for k in range(30)]  # most pages of the host are copies of one
    rows = [(k, u, h, "x") for k, (u, h, _) in enumerate(pages)]
    found = {r["page_id"]: r["main_text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, main_text string").repartition(5)).collect()}

    def brute(u, h):
        """The paragraphs of the element of most text that fewer than half of the host's pages hold."""
        host = [set(re.findall("<p>(.*?)</p>", x)) for v, x, _ in pages if v.split("/")[2] == u.split("/")[2]]
        mine = re.findall("<p>(.*?)</p>", re.search("<div class='q3'>.*<div class='q4'>", h)[0])
        return [t for t in mine if 2 * sum(t in s for s in host) < len(host)]

    for k, (u, h, own) in enumerate(pages):
        if "b.example" in u or "c.example" in u:
            assert found[k] == "\n\n".join(own) == "\n\n".join(brute(u, h))
            assert html_extraction.main_text(html_extraction.Page(h), None) != found[k]  # the template decides
        elif h == copy[1]:
            assert all(t in found[k] for t in own)


def test_html_keeps_what_articles_share(spark):
    """Hosts of few pages that share a heading or a sentence keep it, written out by hand; so does any article."""
    page = lambda body: f"<html><body><div class='nav'><a href='/'>Home</a></div>{body}<footer>Example Press</footer></body></html>"
    heading, quote = "Weekly review", "All that glitters is not gold, as the old saying goes."
    rows, want = [], []
    for host, n, box in (("two", 2, "article"), ("three", 3, "div"), ("four", 4, "article"), ("five", 5, "div"), ("many", 30, "article")):
        for k in range(n):
            shared = quote if k < 2 else f"Nobody said anything in week {k}."
            rows.append((f"https://{host}.example/{k}", page(f"<{box} class='x'><h1>{heading}</h1><p>Report number {k} of {host} tells what happened.</p><p>{shared}</p></{box}>")))
            want.append(f"{heading}\n\nReport number {k} of {host} tells what happened.\n\n{shared}")
    for k in range(9):  # a host of nothing but copies
        rows.append((f"https://copies.example/{k}", page(f"<div class='x'><h1>{heading}</h1><p>{quote}</p></div>")))
        want.append(f"{heading}\n\n{quote}")
    for k in range(9):  # a line that stands once in the same element of every page is the template's
        rows.append((f"https://lines.example/{k}", page(f"<div class='x'><h2>{heading}</h2><p>Report number {k} tells what happened this time, and a bit more.</p><p>{quote if k < 5 else k}</p></div>")))
        want.append(f"Report number {k} tells what happened this time, and a bit more.\n\n{quote if k < 5 else k}")
    found = html_extraction.extract(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string").repartition(4)).collect()
    assert {r["page_id"]: r["main_text"] for r in found} == dict(enumerate(want))


def test_html_class_over_two_slots_is_no_template():
    token = lambda path, text=None, s=1, pages=6: {"path": path, "text": text, "s1": s, "s2": s, "pages": pages, "total": pages, "chars": 10}
    root = [token("/b", s=5, pages=9), token("/b/x", s=5, pages=9), token("/b/y", s=5, pages=9)]
    straddling = [token("/b/x", 1), token("/b/y", 2)]
    assert html_extraction.nested_classes(root + straddling) == [root]
    nested = [token("/b/x/n"), token("/b/x/n", 3)]
    assert html_extraction.nested_classes(root + nested) == [root, nested]
    assert html_extraction.template(root + nested)[1] == [3]


def test_html_names_around_and_inside_the_text():
    text = lambda body: html_extraction.main_text(html_extraction.Page(f"<html><body>{body}</body></html>"), None)
    prose = "<p>" + "A sentence of the text. " * 9 + "</p>"
    kept = ("A sentence of the text. " * 9).strip()
    article = f"<article><div class='entry-header'><h1>Title</h1></div>{prose}<section class='legal'><p>The law says so.</p></section><div class='ad'>Buy</div></article>"
    want = f"Title\n\n{kept}\n\nThe law says so."
    for name in ("has-sidebar", "no-sidebar", "content-sidebar", "main-menu-layout", "sidebar"):
        assert text(f"<div class='{name}'>{article}</div>") == want, name
        assert text(f"<div class='{name}'><div>{prose}</div></div><div class='site-footer'>All rights</div>") == kept, name
    assert text(f"<form id='page'>{article}</form>") == want
    comments = f"<div id='comments'><article>{'<p>Me too.</p>' * 3}</article></div>"
    assert text(f"<main>{article}{comments}</main>") == text(f"{article}{comments}") == want
    assert text(f"<article>{prose}<div class='related'><a href='/'>Another page</a></div></article><div class='sidebar'>Side</div>") == kept


def test_token_counts(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.read_scores(path)
    floor = min(scores.values()) - 10

    def brute(word):
        best = [(0.0, 0)]
        for d in range(1, len(word) + 1):
            options = [(best[s][0] + scores[word[s:d]], best[s][1] - 1) for s in range(d) if word[s:d] in scores]
            if word[d - 1] not in scores:
                size = len(word[d - 1].encode())
                options.append((best[d - 1][0] + size * floor, best[d - 1][1] - size))
            best.append(max(options))
        return -best[-1][1]

    want = Counter()
    for i, t in DOCS:
        words = [w.decode() for w in (t or "").encode().split()]
        want[i, len(words), sum(brute(token_counts.MARK + w) for w in words)] += 1
    assert Counter(map(tuple, token_counts.token_counts(docs, path).collect())) == want


def test_prefixes_are_scored_once(spark):
    """Words dealt in order: a prefix has one node in all tries, but for those that a border cuts; a frequent prefix is cut."""
    rng = random.Random(3)
    words = ["http" + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)] + ["w" + str(i) for i in range(600)]
    words = sorted({w.encode() for w in words})
    deal = dictionary.even_borders(rng.sample(words, 800), 16)
    buckets = [[w.decode() for w in words if deal(w) == b] for b in range(16)]
    assert sum(map(len, buckets)) == len(words) and max(map(len, buckets)) < 2 * len(words) / 16
    tries = [token_counts.Trie({"h": -1.0, "tt": -2.0}) for _ in buckets]
    for trie, part in zip(tries, buckets, strict=True):
        for w in part:
            trie.insert(w)
    prefixes = {w[:n] for w in words for n in range(1, len(w) + 1)}
    assert sum(len(t.best) - 1 for t in tries) <= len(prefixes) + 15 * max(map(len, words))
    assert dictionary.even_borders([], 4)(b"any") == 0 and dictionary.even_borders([b"a"] * 9, 4)(b"b") == 1

    rows = spark.createDataFrame([(i, bytearray(b" ".join(words[i::40]))) for i in range(40)], "id long, body binary")
    found = dictionary.sampled_borders(rows, str.split, str, 8)
    assert len(found.borders) == 7 and sorted(found.borders) == list(found.borders)


def test_digest_tells_blocks_of_other_words():
    tags = [(0, b"ab"), (0, b"c")]
    assert dictionary._digest(tags) == dictionary._digest([(1, b"ab"), (2, b"c")])
    assert len({dictionary._digest(t) for t in (tags, [(0, b"a"), (0, b"bc")], [(0, b"ab"), (0, b"d")], [])}) == 4


def test_classifier_held_out(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    fitted = labels.where("doc_id % 3 != 0")
    scored = quality_classifier.with_posteriors(docs, quality_classifier.fit(docs, fitted)).join(labels.where("doc_id % 3 = 0").select("doc_id", "quality", "toxic"), "doc_id")
    rows = scored.select("p_quality", "quality", "p_toxic", "toxic").dropna().collect()
    assert len(rows) > 50
    assert np.mean([(r["p_quality"] >= 0.5) == (r["quality"] == 1) for r in rows]) >= 0.8
    assert np.mean([(r["p_toxic"] >= 0.3) == (r["toxic"] == 1) for r in rows]) >= 0.8


def test_empty_tables(spark, empty):
    word, byte, piece = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    chats = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    results = [
        bpe.digest(bpe.decode(bpe.encode(empty, byte), byte)), quality_rules(empty), near_duplicates(empty), packing.pack(empty, word), token_counts.token_counts(empty, piece),
        suffix_dedup.digest(suffix_dedup.remove_repeats(empty)), nearest(vectors, F.col("id") % 20 == 0), html_extraction.extract(pages),
        chat.digest(chat.render(chat.reconstruct(chat.conversation_events(chats)))),
    ]
    assert [r.count() for r in results] == [0] * len(results)
    sites = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    model = quality_classifier.fit(sites, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality_classifier.with_posteriors(sites, model).count() == 0


def test_queries_are_registered():
    numbers = {int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()}
    assert numbers == set(range(1, 14))
