"""License scans by diagonal voting, with DataFrame functions only.

Every rolling word k-gram of every document is joined to the k-grams of the templates; a hit votes for the diagonal
(place in the document minus place in the template). Votes are summed by document, template and diagonal, diagonals at most
GAP apart merge into one span, which so survives a few inserted or missing words, and a span stands if at least
COVERAGE of the template's k-grams were hit in it, compared word by word and not by hash alone.

Null and empty texts: no words, no labels, score 0. Equal rows give equal results; rows that share an id are told apart by their text.
The templates are fixed, a few hundred words, so that side is broadcast.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, text_key

K = 3
GAP = 3
COVERAGE = 0.6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that label by themselves.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices as licenses and their users word them.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
)


def words(text: str = "text"):
    low = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, SEPARATORS), "")


def templates(spark, given=TEMPLATES, k: int = K) -> DataFrame:
    """k-grams of the templates: template, label, t_place, t_grams (of the template in all), t_words."""
    t = spark.createDataFrame([(n, label, text) for n, (label, text) in enumerate(given)], "template int, label string, t_text string")
    w = F.split("t_text", " ")
    t = t.withColumn("w", w).withColumn("t_grams", F.size("w") - (k - 1))
    grams = F.transform(F.sequence(F.lit(0), F.col("t_grams") - 1), lambda i: F.slice("w", i + 1, k))
    return t.select("template", "label", "t_grams", F.posexplode(grams).alias("t_place", "t_words"))


def spans(docs: DataFrame, given=TEMPLATES, k: int = K, gap: int = GAP, coverage: float = COVERAGE) -> DataFrame:
    """Verified spans: doc_id, text_key, label, template, first_place, last_place (of words, from 0), coverage."""
    prepare(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), words().alias("w"))
    d = d.select("doc_id", "text_key", F.posexplode(F.arrays_zip(*[(F.col("w") if i == 0 else F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0)))).alias(f"w{i}") for i in range(k)])).alias("place", "g"))
    d = d.withColumn("h", F.xxhash64(*[F.col(f"g.w{i}") for i in range(k)]))
    t = templates(docs.sparkSession, given, k)
    t = t.withColumn("h", F.xxhash64(*[F.col("t_words")[i] for i in range(k)]))
    exact = d["h"] == t["h"]
    for i in range(k):
        exact = exact & (F.col(f"g.w{i}") == F.col("t_words")[i])
    votes = d.join(F.broadcast(t), exact)
    # equal rows vote together; what they hit is a set of places, so that they count once
    key = ["doc_id", "text_key", "template", "label", "t_grams"]
    diagonals = votes.groupBy(*key, (F.col("place") - F.col("t_place")).alias("diagonal")).agg(F.collect_set("t_place").alias("hit"), F.min("place").alias("first_place"), F.max("place").alias("last_place"))
    order = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int"), F.lit(1))
    merged = diagonals.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order))
    found = merged.groupBy(*key, "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hits"), F.min("first_place").alias("first_place"), (F.max("last_place") + k - 1).alias("last_place"))
    return found.withColumn("coverage", F.col("hits") / F.col("t_grams")).where(F.col("coverage") >= coverage).select("doc_id", "text_key", "label", "template", "first_place", "last_place", "coverage")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best coverage of a verified span, else 0) of every row."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), words().alias("w"))
    n = F.size("w")

    def places(phrase: str):
        p = phrase.split(" ")
        at = lambda i: F.forall(F.array(*[F.get("w", i + j) == F.lit(x) for j, x in enumerate(p)]), lambda y: y)
        return F.when((n >= len(p)) & F.array_contains("w", p[-1]) & F.array_contains("w", p[0]), F.filter(F.sequence(F.lit(0), n - len(p)), at)).otherwise(F.array().cast("array<int>"))

    for i, (phrase, _) in enumerate(PHRASES):
        d = d.withColumn(f"p{i}", places(phrase))
    d = d.withColumn("n_words", n.cast("long")).drop("w")
    hits = [F.col(f"p{i}") for i in range(len(PHRASES))]
    base = F.array_compact(F.array(*[F.when(F.size(h) > 0, F.lit(label)) for h, (_, label) in zip(hits, PHRASES, strict=True)]))
    d = d.select("doc_id", "text_key", "n_words", F.concat(*hits).alias("at"), base.alias("base"))
    own = spans(docs).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("own"), F.max("coverage").alias("score"))
    j = d.alias("d").join(own.alias("o"), F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.text_key") == F.col("o.text_key")), "left")
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return j.select(
        F.col("d.doc_id").alias("doc_id"), "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        join(F.col("base")).alias("base_labels"), join(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same by plain SQL, k-grams compared as strings."""
    given = ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES)
    return rf"""
WITH d AS (SELECT doc_id, text, hash(coalesce(text, '')) AS k,
         regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT DISTINCT doc_id, k, w FROM d),
p AS (SELECT doc_id, k, w, unnest(range(len(w))) AS i FROM u),
phrase(phrase, label) AS (VALUES {phrases}),
b AS (SELECT p.doc_id, p.k, p.i, phrase.label FROM p JOIN phrase ON array_to_string(p.w[p.i + 1 : p.i + len(string_split(phrase.phrase, ' '))], ' ') = phrase.phrase
      WHERE p.w[p.i + 1] IN ('mit', 'apache', 'general')),
bb AS (SELECT doc_id, k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels, list_distinct(list(label)) AS bl FROM b GROUP BY ALL),
given(template, label, t) AS (VALUES {given}),
tw AS (SELECT template, label, string_split(t, ' ') AS w FROM given),
tg AS (SELECT template, label, len(w) - {K - 1} AS t_grams, w, unnest(range(len(w) - {K - 1})) AS t_place FROM tw),
tt AS (SELECT template, label, t_grams, t_place, array_to_string(w[t_place + 1 : t_place + {K}], ' ') AS g FROM tg),
g AS (SELECT doc_id, k, i AS place, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM p WHERE i <= len(w) - {K}),
v AS (SELECT g.doc_id, g.k, tt.template, tt.label, tt.t_grams, g.place - tt.t_place AS diagonal, tt.t_place FROM g JOIN tt ON g.g = tt.g),
f AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, k, template ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM v),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, k, template ORDER BY diagonal RANGE UNBOUNDED PRECEDING) AS span FROM f),
m AS (SELECT doc_id, k, label, count(DISTINCT t_place) / t_grams::DOUBLE AS coverage FROM s GROUP BY doc_id, k, template, label, t_grams, span),
o AS (SELECT doc_id, k, list(label) AS ol, max(coverage) AS score FROM m WHERE coverage >= {COVERAGE} GROUP BY ALL)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(bb.n_base, 0)::BIGINT AS n_base, bb.first_word::BIGINT AS first_word, bb.last_word::BIGINT AS last_word, coalesce(bb.base_labels, '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bb.bl, []), coalesce(o.ol, [])))), ','), '') AS labels, coalesce(o.score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN bb ON d.doc_id IS NOT DISTINCT FROM bb.doc_id AND d.k = bb.k LEFT JOIN o ON d.doc_id IS NOT DISTINCT FROM o.doc_id AND d.k = o.k"""
