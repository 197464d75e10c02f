"""Texts made to collide, columns that clash with helper names, rows that share an id, repeated rows, long texts and empty tables, for every operator."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import common as C
from tidegauge.llm import licenses as L
from tidegauge.llm import mixing as M
from tidegauge.llm import orderminhash as O
from tidegauge.llm import packing as P
from tidegauge.llm import quality as Q
from tidegauge.llm import substring as S
from tidegauge.llm import toxicity as T

from .test_operators import ODD, brute_substring, docs, prose, toxic_corpus


def thue_morse(n, x, y):
    return [(x, y)[bin(k).count("1") % 2] for k in range(n)]


def swapped_pair(n=1024):
    """Two texts of the words f0 a f1 b ..., with a and b exchanged: sums over powers of a base modulo 2**64 can't tell them apart."""
    t, u = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    return [" ".join(w for k in range(n) for w in (f"f{k}", x[k])) for x in (t, u)]


def test_swapped_pair_shares_nothing(spark):
    texts = swapped_pair()
    d = docs(spark, texts)
    assert [r["n_removed"] for r in S.digests(d).collect()] == [0, 0]
    assert O.near_duplicates(d).select("class_id").distinct().count() == 2
    w = C.Words(pa.array(["".join(thue_morse(4096, "a", "b")), "".join(thue_morse(4096, "b", "a"))]))
    assert len(set(w.hash.tolist())) == len(set(w.second.tolist())) == 2
    whole = C.text_hashes(C.Words(pa.array(texts)), np.arange(2))
    assert len(set(whole[0].tolist())) == len(set(whole[1].tolist())) == 2


def test_long_words_and_lengths():
    words = ["x" * n for n in (1, 7, 8, 9, 15, 16, 17, 255, 256, 257, 100_000)]
    w = C.Words(pa.array([" ".join(words), " ".join(reversed(words))]))
    assert len(set(w.hash.tolist())) == len(words) and sorted(w.hash[: len(words)]) == sorted(w.hash[len(words) :])
    assert not set(w.hash.tolist()) & set(w.second.tolist())


HELPERS = ["_id", "_key", "_cut", "_own", "_k", "_words", "row", "doc", "text_key", "rep", "node", "size", "hash", "salt", "target", "score", "_n", "_t", "_d", "spread", "kept", "label", "place"]


def clashing(spark, texts, ids=None):
    return docs(spark, texts, ids).select("*", *[F.lit(f"own {h}").alias(h) for h in HELPERS])


def test_names_that_clash(spark):
    r = random.Random(3)
    base = prose(r, 120)
    texts = [base, base, base + " and more", prose(r, 60), *ODD]
    d = clashing(spark, texts)
    plain = docs(spark, texts)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    for stage in (O.keep_one, S.dedup_substrings, M.mixed_documents):
        got = stage(d)
        assert got.columns == d.columns
        assert all(x[h] == f"own {h}" for x in got.collect() for h in HELPERS)
        assert same(got.select(*plain.columns), stage(plain))
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(len(texts))], "doc_id long, quality int, toxic int, label string")
    for run in (S.digests, L.scan, M.mix, P.pack_documents, lambda x: Q.judge(x, labels)):
        assert run(d).count() >= len(texts)
    kept = T.clean(d, labels)
    assert kept.columns == d.columns and all(x["score"] == "own score" for x in kept.collect())


def test_one_id_with_several_texts(spark):
    r = random.Random(8)
    a, b = prose(r, 80), prose(r, 80)
    d = docs(spark, [a, b, b, a + " end", ""], ids=[1, 1, 5, 6, 1])
    kept = sorted((x["doc_id"], x["text"]) for x in O.keep_one(d).collect())
    assert kept == sorted([(1, a), (1, b), (1, "")])
    got = {(x["doc_id"], x["n_words"]): (x["class_id"], x["class_size"]) for x in O.near_duplicates(d).collect()}
    assert got[(5, 80)] == (1, 2) and got[(6, 81)] == (1, 2) and got[(1, 0)] == (1, 1)


def test_repeated_rows(spark):
    texts, y = toxic_corpus(120)
    labels = spark.createDataFrame([(i, v, v) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    once = docs(spark, texts)
    twice = once.union(once)
    for run in (lambda d: T.score(d.select("doc_id", "text"), labels), lambda d: Q.judge(d, labels), L.scan):
        a, b = (sorted(map(str, run(d).collect())) for d in (once, twice))
        assert sorted(a + a) == b
    pieces = P.pack_documents(twice).collect()
    assert sum(x["length"] for x in pieces) == 2 * sum(x["length"] for x in P.pack_documents(once).collect())
    assert O.keep_one(twice).count() == O.keep_one(once).count()
    got = sorted((tuple(x) for x in S.digests(twice).collect()), key=str)
    assert got == brute_substring([(i, t) for i, t in enumerate(texts)] * 2, S.WIDTH)
    assert M.mix(twice).count() == 2 * len(texts)


def test_long_text(spark):
    r = random.Random(10)
    long = "\n".join(prose(r, 40) for _ in range(2500))
    d = docs(spark, [long, long.replace("w1 ", "w2 ", 3), prose(r, 30)])
    assert [x["class_id"] for x in sorted(O.near_duplicates(d).collect())] == [0, 0, 2]
    assert sorted((tuple(x) for x in S.digests(d).collect()), key=str) == brute_substring([(x["doc_id"], x["text"]) for x in d.collect()], S.WIDTH)
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert {x["doc_id"]: x["n_words"] for x in Q.judge(d, labels).collect()}[0] == 100_000
    assert T.score(d, labels).count() == 3 and L.scan(d).agg(F.max("n_words")).first()[0] == 100_000
    assert sum(x["length"] for x in P.pack_documents(d).collect() if x["doc_id"] == 0) > 100_000


def test_empty_tables(spark):
    d = docs(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for run in (S.digests, S.dedup_substrings, O.near_duplicates, O.keep_one, L.scan, M.mix, M.mixed_documents, P.pack_documents, lambda x: Q.judge(x, labels), lambda x: T.score(x, labels), lambda x: T.clean(x, labels)):
        assert run(d).count() == 0


@pytest.mark.parametrize("texts", [[], ODD], ids=["empty", "odd"])
def test_pipeline_on_awkward_tables(spark, tmp_path, texts):
    d = clashing(spark, [*texts, "x"], ids=[*range(len(texts)), None]) if texts else clashing(spark, ["x"]).limit(0)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert "sequence_id" in out.columns and (out.count() > 0) == bool(texts)


def test_join_by_count_is_an_inner_join(spark):
    left = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(3000)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k <> 5").withColumn("extra", F.col("k") * 10)
    got, want = C.join_by_count(left, right, ["k"], "n", "v"), left.join(right, "k")
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())
