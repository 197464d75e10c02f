"""The ten operators against brute force, exact round trips, or held-out accuracy, and on awkward tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import common as C
from tidegauge.llm import html as H
from tidegauge.llm import licenses as L
from tidegauge.llm import mixing as M
from tidegauge.llm import nearest as N
from tidegauge.llm import orderminhash as O
from tidegauge.llm import packing as P
from tidegauge.llm import quality as Q
from tidegauge.llm import substring as S
from tidegauge.llm import toxicity as T
from tidegauge.llm import warc as W

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, sources=None):
    rows = [((ids[i] if ids else i), t, "en", (sources[i] if sources else f"s{i % 3}"), None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(r, n, words=None):
    words = words or [f"w{k}" for k in range(400)]
    return " ".join(r.choice(words) for _ in range(n))


ODD = ["", None, " \n\t ", "one", "x" * 5000, "é ü\nß", "a b c d", "a b c d"]


# --- words


def test_words_and_windows():
    r = random.Random(1)
    texts = [*ODD, *("".join(r.choice("ab \t\n\x0b\x0c\ré ") for _ in range(r.randint(0, 60))) for _ in range(200))]
    w = C.Words(pa.array(texts, pa.string()))
    by = {}
    for d, t in enumerate(texts):
        want = (t or "").encode().split()
        got = [w.data[a:b].tobytes() for a, b in zip(w.starts[w.first[d] : w.first[d + 1]], w.ends[w.first[d] : w.first[d + 1]], strict=True)]
        assert got == want
        for x, h in zip(want, w.hash[w.first[d] : w.first[d + 1]], strict=True):
            assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)
    at, doc = w.windows(3)
    h = C.window_hash(w.hash, at, 3)
    seen = {}
    for i, d, x in zip(at, doc, h, strict=True):
        key = tuple(w.data[a:b].tobytes() for a, b in zip(w.starts[i : i + 3], w.ends[i : i + 3], strict=True))
        assert seen.setdefault(key, x) == x and w.first[d] <= i <= w.first[d + 1] - 3
    assert len(set(seen.values())) == len(seen)


# --- 1 toxicity


def toxic_corpus(n=400):
    r = random.Random(4)
    texts, labels = [], []
    for i in range(n):
        t = prose(r, 80).split()
        if i % 4 == 0:
            for _ in range(6):
                t[r.randrange(len(t))] = r.choice(["vile", "rotten", "nasty"])
        texts.append(" ".join(t))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_toxicity_held_out(spark):
    texts, y = toxic_corpus()
    d = docs(spark, texts + ODD)
    labels = spark.createDataFrame([(i, 1, v) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in T.score(d, labels).collect()}
    assert len(got) == len(texts) + len(ODD) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = np.mean([(got[i] >= T.THRESHOLD) == y[i] for i in held])
    assert right > 0.95
    assert got[len(texts)] < T.THRESHOLD  # an empty text
    assert T.clean(d, labels).columns == d.columns


def test_toxicity_without_labels(spark):
    d = docs(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in T.score(d.withColumn("score", F.lit("clash")), none).collect()] == [0.0, 0.0]
    assert T.score(d.limit(0), none).count() == 0


def test_held_out_rows_never_train(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    got = [r["doc_id"] for r in T.training_rows(docs(spark, ["t"] * 60), labels).collect()]
    assert got and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in got)


def test_whole_texts_train(spark):
    ids = [i for i in range(30) if zlib.crc32(str(i).encode()) % 3 != 1]
    long = "plain words " * 3000 + "vile"
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    assert {r["text"] for r in T.training_rows(docs(spark, [long] * 30), labels).collect()} == {long}


# --- 2 substring dedup


def brute_substring(rows, width):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_substring_against_brute_force(spark):
    r = random.Random(7)
    shared = [prose(r, n) for n in (50, 55, 120, 49)]
    texts = [prose(r, r.randint(0, 90)) + " " + r.choice([*shared, ""]) + "\n" + prose(r, r.randint(0, 60)) + " " + r.choice([*shared, ""]) for _ in range(60)]
    texts += [texts[3], texts[3], texts[5] + " tail", " ".join(["same"] * 130), " ".join(["same"] * 90), *ODD]
    rows = list(enumerate(texts)) + [(None, texts[0]), (2, texts[9]), (2, texts[9])]
    d = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    got = sorted([tuple(x) for x in S.digests(d).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], key=str)
    assert got == brute_substring(rows, 50)
    kept = S.dedup_substrings(d)
    assert kept.columns == d.columns and kept.count() == len(rows)
    digest = sorted(hashlib.sha256(b" ".join((x["text"] or "").encode().split())).hexdigest() for x in kept.collect())
    assert digest == sorted(x[3] for x in got)
    assert S.digests(d.limit(0)).count() == 0


def test_cover_has_every_difference():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


# --- 3 licenses


def test_licenses(spark):
    long = dict(L.TEMPLATES)["bsd"]
    texts = ["Released under the MIT License.", "x MIT\nlicense, mit LICENSE", long.replace("source", "any source", 1), "Licensed under CC BY-NC 4.0.", "GNU General Public License", "nothing here", *ODD, "İ mit license K"]
    d = docs(spark, texts)
    got = {r["doc_id"]: r for r in L.scan(d).collect()}
    assert [got[i]["labels"] for i in range(6)] == ["mit", "mit", "bsd", "cc-by-nc", "gpl", ""]
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (2, 1, 3) and 0.6 <= got[2]["score"] < 1 and got[3]["score"] == 1.0
    assert len(got) == len(texts) and got[6]["n_words"] == 0 and got[6]["first_word"] is None
    con = duckdb.connect()
    documents = pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    con.register("documents", documents)
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = con.sql(L.oracle()).fetchall()
    assert sorted(want) == sorted(tuple(r[c] for c in cols) for r in got.values())
    assert L.scan(d.union(d).limit(0)).count() == 0 and L.scan(d.union(d)).count() == 2 * len(texts)
    plan = L.scan(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 4 html


def test_html_blocks():
    page = "<head><title>T</title><style>x</style></head><body><nav><ul><li><a href='/'>Home</a><li>B</ul></nav><article><h1>A &amp;  B</h1><p><b>one<br><p>two <i>in</i>line<!-- no --></p></article><script>var x='<p>';</script><footer>&copy;"
    assert [t for _, t, _ in H.blocks(page)] == ["Home", "B", "A & B", "one", "two inline", "©"]
    assert H.blocks("") == [] and [t for _, t, _ in H.blocks("plain < text")] == ["plain < text"]


def test_html_labeller(spark):
    r = np.random.default_rng(1234)
    right = total = 0
    model = H.trained()
    for _ in range(60):
        page, y = H.synthetic_page(r)
        q = H.label(model, [H.blocks(page)])[0] >= 0.5
        right, total = right + int((q == np.array(y)).sum()), total + len(y)
    assert right / total > 0.99
    page = '<html><body><div class="ad">Buy now</div><nav><ul><li><a href="/">x</a></li></ul></nav><article><h1>Title here.</h1><p>First &amp; last words of it.</p></article><footer>&copy; us</footer></body></html>'
    d = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (1, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((x["page_id"], x["text"], x["n_chars"]) for x in H.extract(d).collect())
    want = "Title here.\nFirst & last words of it."
    assert got == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)] and H.extract(d.limit(0)).count() == 0


def test_html_layouts():
    """Pages by hand, in layouts beside the generator's: what a reader would call the article, and nothing else."""
    say = "The weather in this town was rather mild, and many people went out to the river. They walked for hours along its banks."
    article = (
        f"<html><body><header><a href='/'>The Site</a></header><nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>News</a></li></ul></nav><article><header><h1>A title of it</h1></header><p>{say}</p>"
        f"<table><tr><th>Year</th><th>Town</th></tr><tr><td>1990</td><td>Rome</td></tr></table><pre>x = 1 + y</pre><figure><img src=a><figcaption>A picture of the river</figcaption></figure>"
        f"<aside class='related'><p>You may also like</p></aside><dl><dt>River</dt><dd>It flows.</dd></dl><p>{say}</p><form><label>Your name</label></form></article>"
        f"<section class='comments'><h3>2 comments</h3><p>I was there too, and it rained all day long.</p></section><footer>© 2024 X</footer></body></html>"
    )
    cases = {
        f"<body><p>One. {say}</p><p>Two. {say}</p></body>": ["One. " + say, "Two. " + say],
        say: [say],
        f"<p>{say}</p>": [say],
        article: ["A title of it", say, "Year", "Town", "1990", "Rome", "x = 1 + y", "A picture of the river", "River", "It flows.", say],
        f"<html><body><div id='header'>My site</div><div class='sidebar'><h3>Recent posts</h3><p>{say}</p></div><div id='content'><h1>Title</h1><p>{say}</p><ul><li>The first of all things</li></ul></div>"
        "<div class='cookie-banner'>Accept all cookies</div><div id='footer'>Copyright</div></body></html>": ["Title", say, "The first of all things"],
    }
    model = H.trained()
    for page, want in cases.items():
        leaves = H.blocks(page)
        assert [t for (_, t, _), q in zip(leaves, H.label(model, [leaves])[0], strict=True) if q >= 0.5] == want


def test_html_long_page_by_stretches(monkeypatch):
    model, r = H.trained(), random.Random(2)
    leaves = H.blocks("<nav><p>Home</p></nav><article>" + "".join(f"<p>{prose(r, 8)}</p>" for _ in range(300)) + "</article><footer>Imprint</footer>")
    few = H.blocks("<p>One more page.</p>")
    whole = H.label(model, [leaves, few])
    monkeypatch.setattr(H, "STRETCH", 7)
    for a, b in zip(whole, H.label(model, [leaves, few]), strict=True):
        assert np.allclose(a, b, atol=1e-9)
    assert (whole[0][1:-1] >= 0.5).all() and whole[0][0] < 0.5 > whole[0][-1]


# --- 5 mixing


def water(sizes, cycle, share, limit):
    t = {s: 0.0 for s in sizes}
    rest, open_ = share * sum(sizes.values()), list(sizes)
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(sizes)}
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > limit * sizes[s]]
        if not full:
            return t | {s: weight[s] * level for s in open_}
        for s in full:
            t[s] = limit * sizes[s]
            rest -= t[s]
            open_.remove(s)
    return t


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    r = random.Random(seed)
    sources = [r.choice(["a", "a", "a", "é", "Z", "b", None]) for _ in range(150)]
    texts = [prose(r, r.randint(0, 40)) for _ in range(146)] + [None, "", "dup x", "dup x"]
    d = docs(spark, texts, [*range(148), 148, 148], sources)
    got = M.mix(d).collect()
    sizes = collections.Counter()
    for s, t in zip(sources, texts, strict=True):
        sizes[s] += len((t or "").split())
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    want = water({s: sizes[s] for s in names}, (5, 2, 1), 1.5, 2.0)
    taken = collections.Counter()
    for x in got:
        assert 0 <= x["taken"] <= 2 * x["size"] and x["target"] == pytest.approx(want[x["source"]]) and x["source_size"] == sizes[x["source"]]
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in names) and len(got) == 150
    again = M.mix(d.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert M.mixed_documents(d).columns == d.columns and M.mix(d.limit(0)).count() == 0


def test_one_document(spark):
    assert [x["taken"] for x in M.mix(docs(spark, ["a b c d"])).collect()] == [6]


# --- 6 quality


def test_quality_base_columns():
    r = random.Random(3)
    texts = [*ODD, "a b\na b\n\n \na b", " ".join("abcdefgh") + " q " + " ".join("abcdefgh"), "#x* $%&|<> é", *(prose(r, 60, ["u", "v", "w"]) for _ in range(20))]
    got = Q.base_columns(C.Words(pa.array(texts, pa.string())))
    for d, t in enumerate(texts):
        t = t or ""
        w = t.encode().split()
        win = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + k for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert tuple(int(got[k][d]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_viterbi_against_brute_force():
    r = np.random.default_rng(0)
    f = Q.Field()
    f.w, f.step = r.normal(size=(Q.N_FEATURES, 2)), r.normal(size=(2, 2))
    x = r.normal(size=(5, 7, Q.N_FEATURES))
    n = r.integers(1, 6, 7)
    got = f.decode(x, np.arange(5)[:, None] < n[None, :])
    for d in range(7):
        paths = np.array(np.meshgrid(*[[0, 1]] * n[d], indexing="ij")).reshape(n[d], -1).T
        score = [sum(x[t, d] @ f.w[:, p[t]] for t in range(n[d])) + sum(f.step[p[t - 1], p[t]] for t in range(1, n[d])) for p in paths]
        assert list(got[: n[d], d]) == list(paths[int(np.argmax(score))])


def test_quality_held_out(spark):
    r = random.Random(9)
    good = lambda: "\n".join(prose(r, 30).capitalize() + "." for _ in range(4))
    bad = lambda: "\n".join(" | ".join(prose(r, 20).split()) + " |" for _ in range(4))
    texts = [good() if i % 2 else bad() for i in range(200)] + ODD
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in Q.judge(docs(spark, texts), labels).collect()}
    assert np.mean([got[i]["kept"] == bool(i % 2) for i in range(100, 200)]) > 0.97
    assert all(got[200 + k]["base_failed"] and not got[200 + k]["kept"] for k in range(len(ODD)))
    assert Q.judge(docs(spark, texts), labels.limit(0)).where("kept").count() > 0 and Q.judge(docs(spark, texts).limit(0), labels).count() == 0


def test_lines_beyond_the_first_thousands_train(spark):
    r = random.Random(3)
    start = "\n".join(prose(r, 30) for _ in range(60))
    assert len(start) > 8000
    tail = {1: "\n".join(prose(r, 30).capitalize() + "." for _ in range(150)), 0: "\n".join(" | ".join(prose(r, 20).split()) + " |" for _ in range(150))}
    texts = [start + "\n" + tail[i % 2] for i in range(40)] + [tail[1], tail[0]]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["content_share"] for x in Q.judge(docs(spark, texts), labels).where("doc_id >= 40").collect()}
    assert got[40] > 0.9 and got[41] < 0.1


# --- 7 warc


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "<p>b é</p>", "<p>a</p>", None, "", "z" * 600_000, "<p>a</p>"]
    url = ["http://x/?a=1 2", "u\r\nv", None, "", "é", "big", "k"]
    rows = [(i, u, h) for i, (u, h) in enumerate(zip(url, html, strict=True))] + [(None, "n", "<p>b é</p>"), (6, "k", "<p>a</p>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = W.write_archives(d, f"file://{tmp_path}/w").collect()
    got = W.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert len(got) == len(rows) == len(index)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    urls = collections.Counter((i, u) for i, u, _ in rows)
    for x in got:
        h = next((h or "") for i, _, h in rows if i == x["page_id"])
        b = h.encode()
        assert x["payload_bytes"] == len(b) and x["payload_digest"] == base64.b32encode(hashlib.sha1(b).digest()).decode()
        response = x["page_id"] == last[h]
        assert x["record_type"] == ("response" if response else "revisit") and x["refers_to"] == (None if response else last[h])
        assert bytes(x["payload"]) == (b if response else b"")
        urls[x["page_id"], x["url"]] -= 1
    assert not +urls
    for x in index:  # one record by one frame
        head, _ = W.read_record((tmp_path / "w" / x["bundle"]).read_bytes(), x["frame"], x["offset"])
        assert head["WARC-Record-ID"] == x["record_id"]
    assert all(x["record_type"] == "response" for x in W.classify(d, min_bytes=10**9).selectExpr("if(revisit, 'revisit', 'response') record_type").collect())
    assert W.round_trip(d.limit(0)).count() == 0


# --- 8 near duplicates


def jaccard(a, b):
    def grams(t):
        w = t.split()
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])

    x, y = grams(a), grams(b)
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(11)
    base = [prose(r, r.randint(5, 150), [f"v{k}" for k in range(3000)]) for _ in range(25)]
    texts = list(base)
    for b in base[:12]:
        for edits in (1, 1, 2, 4):
            w = b.split()
            for _ in range(edits):
                w[r.randrange(len(w))] = f"edit{r.random()}"
            texts.append(" ".join(w))
    texts += [base[0], base[0].replace(" ", "\n"), "hi", "hi", *ODD]
    d = docs(spark, texts)
    got = {x["doc_id"]: x["class_id"] for x in O.near_duplicates(d).collect()}
    real = [i for i, t in enumerate(texts) if (t or "").split()]
    parent = {i: i for i in real}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in real:
        for j in real:
            if i < j and jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert {i: got[i] for i in real} == {i: find(i) for i in real}
    assert all(got[i] == i for i in range(len(texts)) if i not in parent)
    kept = O.keep_one(d.union(d.limit(3)))
    assert kept.columns == d.columns
    ids = sorted(x["doc_id"] for x in kept.collect())
    assert ids == sorted({find(i) for i in real} | {i for i in range(len(texts)) if i not in parent})
    assert O.near_duplicates(d.limit(0)).count() == 0


def test_alignment_against_dynamic_programming():
    r = np.random.default_rng(2)
    for _ in range(300):
        a = r.integers(0, 5, r.integers(1, 60)).astype(np.uint32)
        b = np.delete(a, r.integers(0, len(a), 3)) if r.random() < 0.5 and len(a) > 5 else r.integers(0, 5, r.integers(1, 60)).astype(np.uint32)
        for _ in range(3):
            if len(b):
                b = np.insert(b, r.integers(0, len(b)), 9)
        m = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                m[i + 1, j + 1] = m[i, j] + 1 if a[i] == b[j] else max(m[i, j + 1], m[i + 1, j])
        lcs = int(m[-1, -1])
        for t in (0.3, 0.8):
            s = O.similarity(a, b, t)
            want = lcs / (len(a) + len(b) - lcs)
            assert (s == pytest.approx(want)) if want >= t else s < t
        assert O._by_rows(a, b, len(a) + len(b)) == lcs
        bound = O._may_link([a], [b], 0.5)
        both = sum((collections.Counter(a.tolist()) & collections.Counter(b.tolist())).values())
        assert bound[0, 0] == (both >= 0.5 * (len(a) + len(b) - both) - 1e-3)


def test_order_matters():
    w = C.Words(pa.array([" ".join(map(str, range(60))), " ".join(map(str, [*range(30, 60), *range(30)]))]))
    h, first = O.kmers(w)
    short = (h >> np.uint64(32)).astype(np.uint32)
    assert O.similarity(short[: first[1]], short[first[1] :]) < 0.8


# --- 9 packing


def test_packing(spark):
    from tokenizers import Tokenizer

    r = random.Random(13)
    texts = [prose(r, r.randint(0, 900)) for _ in range(40)] + ODD + ["a \n b", "<|endoftext|> x", prose(r, 6000)]
    d = docs(spark, texts, [*range(len(texts) - 1), None])
    got = P.pack_documents(d).collect()
    t = Tokenizer.from_file(P.default_tokenizer())
    t.encode_special_tokens = True
    want = {(i if i < len(texts) - 1 else None): [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for x in got:
        ids = np.frombuffer(x["ids"], "<u4")
        assert x["length"] == len(ids) and x["ids_crc32"] == zlib.crc32(bytes(x["ids"])) and x["doc_tokens"] == len(want[x["doc_id"]])
        pieces[x["doc_id"]].append((x["start"], ids.tolist()))
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    assert set(pieces) == set(want)
    for i, p in pieces.items():
        p.sort()
        assert [k for _, ids in p for k in ids] == want[i] and all(s == sum(len(q) for _, q in p[:n]) for n, (s, _) in enumerate(p))
    size = []
    for s in sequences.values():
        s.sort()
        assert all(o == sum(k for _, k in s[:n]) for n, (o, _) in enumerate(s))
        size.append(sum(k for _, k in s))
    assert max(size) <= 2048 and len(size) <= sum(map(len, want.values())) / 2048 + 2
    assert sorted(map(str, P.pack_documents(d.repartition(3)).collect())) == sorted(map(str, got)) and P.pack_documents(d.limit(0)).count() == 0


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    t, e, r = Tokenizer.from_file(P.default_tokenizer()), P.Encoder(P.default_tokenizer()), random.Random(5)
    t.encode_special_tokens = True
    pool = [chr(c) for c in [*range(0x250), 0x1680, 0x2000, 0x200B, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x301]]
    texts = ["".join(r.choice(pool) if r.random() < 0.3 else r.choice("  \n\tab1'sre.,é") for _ in range(r.randint(0, 40))) for _ in range(500)]
    assert [x.tolist() for x in e(pa.array(texts))] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]


def test_neighbours_are_lexical():
    a, b = np.arange(0, 300), np.arange(1000, 1300)
    order = [a, b, a.copy(), b.copy()]
    first = P.pack(np.full(4, 300), order, 600)
    assert sorted(sorted(d for d, _, _ in s) for s in first) == [[0, 2], [1, 3]]


def test_a_seed_asks_for_all_its_tokens():
    own, shared = np.arange(100, 140), np.arange(1, 11)
    others = [np.arange(1000 + 20 * i, 1020 + 20 * i) for i in range(3)]
    pieces = [np.concatenate([own, shared]), *others, np.concatenate([shared, np.arange(5000, 5010)]), others[0].copy()]
    first = P.pack(np.array([len(x) for x in pieces]), pieces, 70)
    assert {d for s in first if any(x[0] == 0 for x in s) for d, _, _ in s} == {0, 4}


def test_scores_against_brute_force_bm25():
    r = np.random.default_rng(6)
    pieces = [r.choice(400, r.integers(0, 120), p=np.arange(400, 0, -1) / 80200).astype(np.uint32) for _ in range(70)]
    pieces[3] = pieces[2].copy()
    corpus = P.Corpus.of(pieces)
    index = P.Index(pieces, corpus)
    df, mean = collections.Counter(t for p in pieces for t in set(p.tolist())), np.mean([len(p) for p in pieces])
    for seed in range(0, 70, 7):
        want = []
        for p in pieces:
            tf, s = collections.Counter(p.tolist()), 0.0
            for t in set(pieces[seed].tolist()):
                if df[t] > 1:
                    s += np.log1p((70 - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (P.K1 + 1) / (tf[t] + P.K1 * (1 - P.B + P.B * len(p) / mean))
            want.append(s)
        assert index.scores(seed) == pytest.approx(np.array(want), rel=1e-4, abs=1e-4)


def test_tiny_texts_are_sharded_too(spark):
    d = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN '' ELSE 'a' END AS text")
    got = P.pack_documents(d, window=64, shard_tokens=500)
    assert got.selectExpr("shiftright(sequence_id, 32) AS s").distinct().count() >= 4 and got.agg(F.sum("length")).first()[0] == 4500


def test_close_documents_share_a_shard(spark):
    r = random.Random(8)
    vocabularies = [[f"{chr(97 + k)}{prose(r, 1)}{i}" for i in range(40)] for k in range(4)]
    texts = [" ".join(r.choice(vocabularies[i % 4]) for _ in range(60)) for i in range(240)]
    got = P.pack_documents(docs(spark, texts), window=512, shard_tokens=4000).collect()
    shards = collections.defaultdict(collections.Counter)
    for x in got:
        shards[x["sequence_id"] >> 32][x["doc_id"] % 4] += 1
    assert len(shards) > 4 and {x["doc_id"] for x in got} == set(range(240))
    assert np.mean([max(c.values()) / sum(c.values()) for c in shards.values()]) > 0.75
    again = P.pack_documents(docs(spark, texts).repartition(3), window=512, shard_tokens=4000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_frequencies_are_of_all_documents(spark):
    pieces = [np.array([1, 2, 3]), np.array([2, 3]), np.array([3, 4])]
    blobs = [(x.astype(np.uint16).tobytes() + b"\0",) for x in pieces]
    got = P._corpus(spark.createDataFrame(blobs, "ids binary").repartition(3), 2048)
    want = P.Corpus.of(pieces)
    assert (got.n, got.mean, got.terms.tolist()) == (3, 7 / 3, [1, 2, 3, 4]) and np.allclose(got.idf, want.idf)


# --- 10 nearest neighbours


def vectors(spark, n=600, dim=16, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)).astype(np.float32)
    x[50:55] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)] + [(9000, None), (9100, [0.0] * dim), (9200, [float("nan")] * dim), (9300, [None] * dim), (9400, [1.0]), (None, [1.0] * dim), (5, [float(v) for v in x[5]])]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))


def test_nearest(spark):
    x, d = vectors(spark)
    got = collections.defaultdict(list)
    for r in N.search(d).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y = x.astype(np.float64)
    assert sorted(got) == [0, 100, 200, 300, 400, 500]
    for q, found in got.items():
        dist = np.sqrt(((y - y[q]) ** 2).sum(1))
        want = sorted((i for i in range(len(y)) if i != q), key=lambda i: (dist[i], i))[:10]
        assert [i for i, _ in found] == want and [s for _, s in found] == pytest.approx([dist[i] for i in want], abs=1e-12)
    assert N.search(d.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0]), (2, [1.0, 2.5])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in N.search(few).orderBy("rank").collect()] == [(1, 2, 0.5), (2, 1, 1.0)]


def test_windows_alone_find_neighbours_that_stand_out(spark):
    r = np.random.default_rng(8)
    centre = r.normal(size=(60, 16)) * 3
    x = np.repeat(centre, 20, axis=0) + r.normal(size=(1200, 16)) * 0.1
    d = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for row in N.search(d, window=60, exact=False).collect():
        got[row["query_id"]].add(row["vec_id"])
    hits = total = 0
    for q, found in got.items():
        dist = ((x - x[q]) ** 2).sum(1)
        dist[q] = np.inf
        hits, total = hits + len(found & set(np.argsort(dist)[:10].tolist())), total + 10
    assert hits / total >= 0.9


def exact_neighbours(ids, x, every, k=10):
    out = []
    for i in range(len(x)):
        if ids[i] % every == 0:
            d = np.zeros(len(x))
            for n in range(x.shape[1]):
                d += (x[:, n] - x[i, n]) ** 2
            d = np.sqrt(d)
            o = [j for j in np.lexsort((ids, d)) if j != i][:k]
            out += [(int(ids[i]), r + 1, int(ids[j]), float(d[j])) for r, j in enumerate(o)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["large", "hot"])
def test_large_norms_and_a_hot_vector(spark, kind):
    """Unit noise around 1e7, and a vector that a third of the rows share: as brute force has it, with few rows on the way."""
    r = np.random.default_rng(12)
    x = r.normal(size=(1500, 16)) + (1e7 if kind == "large" else 0)
    if kind == "hot":
        x[::3] = x[0]
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "vec_id long, embedding array<double>")
    got = sorted((q["query_id"], q["rank"], q["vec_id"], q["score"]) for q in N.search(v, every=50).collect())
    assert got == exact_neighbours(np.arange(len(x)), x, 50)
    ids = np.arange(0, 1500, 50)
    near = list(N._within(ids, x[ids], np.full(len(ids), 1e300), 10)([pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(list(x))], names=["vec_id", "v"])]))
    assert sum(len(b) for b in near) == 10 * len(ids)


def test_hilbert_steps_are_neighbours():
    side = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    key = N.hilbert(side, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(side[np.argsort(key)], axis=0)).sum(1) == 1).all()
