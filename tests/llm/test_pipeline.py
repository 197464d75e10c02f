"""The pipeline on a small corpus, stage by stage, and the queries of the subpackage."""

from __future__ import annotations

import random

import corpus_pipeline
from tidegauge.llm import queries

from .test_operators import docs, prose, toxic_corpus


def test_pipeline(spark, tmp_path):
    r = random.Random(21)
    texts, y = toxic_corpus(200)
    texts += [texts[1] + " more", texts[1], prose(r, 60) + " " + texts[5]]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, v) for i, v in enumerate(y)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = d.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {x["doc_id"] for x in d.select("doc_id").collect()}
        assert d.columns == columns or name == "packing"
    bad = {i for i, v in enumerate(y) if v}
    assert len(bad & ids["toxicity"]) <= 2 and len(ids["toxicity"]) >= 150
    assert 1 in ids["near_dedup"] and not {200, 201} & ids["near_dedup"]
    cut = spark.read.parquet(f"{tmp_path}/substring_dedup").where("doc_id = 202").first()["text"]
    assert texts[5] not in cut and cut.startswith(texts[202][:100])
    assert ids["packing"] == ids["mixing"] <= ids["substring_dedup"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == d.count()


def test_stages_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    assert set(queries.ORACLES) <= set(queries.QUERIES) and [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 11)] == [1] * 10
