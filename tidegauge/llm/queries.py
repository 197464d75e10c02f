"""The registered queries of this subpackage, one for each operator and the pipeline, and SQL where it can express them."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, licenses, mixing, nearest, orderminhash, packing, quality, substring, toxicity, warc
from .common import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(documents(spark, sf_dir).select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_words")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(documents(spark, sf_dir))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderminhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "n_words")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir)).drop("ids")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_license_scans": op3_license_scans,
    "op4_html_extraction": op4_html_extraction,
    "op5_mixing": op5_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc": op7_warc,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_packing": op9_packing,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "pipeline": pipeline,
}

_OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM d),
s AS (SELECT r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, n - 48)) AS i FROM n WHERE n >= 50)),
m AS (SELECT h, min(doc_id) AS low FROM s GROUP BY h),
c AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS k FROM s JOIN m USING (h) WHERE low < doc_id),
g AS (SELECT r, list(k) AS gone FROM c GROUP BY r)
SELECT doc_id, n::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, n + 1), lambda k: NOT list_contains(gone, k)), lambda k: w[k]) END, ' ')) AS kept_sha256
FROM n LEFT JOIN g USING (r)"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::INTEGER >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
_OP7 = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, payload_bytes AS b, max(page_id) AS last FROM p GROUP BY ALL)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p JOIN m USING (h) WHERE p.payload_bytes = m.b"""

ORACLES = {"op2_substring_dedup": _OP2, "op3_license_scans": licenses.oracle(), "op7_warc": _OP7, "op10_nearest_neighbours": nearest.ORACLE}
