"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a hash; a source's share is the documents below a threshold, so a larger budget keeps all
that a smaller one took. Tokens are summed by source and hash bucket, the bucket in which the budget ends is
found on the running sums, and only that bucket's documents are binned again by the next bits. Nothing is sorted
by document. A budget above a source's size first takes the whole source, then goes on with a second pass
in the same order. The one document at the boundary gives only the words that are still missing.

Null source: a source of its own, last. Null or empty text: size 0, takes 0. Rows that are equal in id and text
tie in the hash and share what is missing evenly (rounded down). An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, prepare, table

#: Bits of the hash that one level of the histogram uses.
BITS = 12
LEVELS = 5
#: Sources up to this count are broadcast (as their few numbers each); more are joined by shuffle.
BROADCAST_SOURCES = 20_000


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, share: float, cycle: tuple, limit: float) -> DataFrame:
    """totals: source, source_size, one row for each source. Adds target: share of all sizes, divided by the cycle's weights over
    sources in code-point order, each at most limit times its size; what is above is dealt out again by weight.

    The level L at which sum(min(limit * size, weight * L)) is the whole budget is found on running sums over size / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int"))
    t = totals.withColumn("_w", weight).withColumn("_cap", F.lit(float(limit)) * F.col("source_size")).withColumn("_r", F.col("_cap") / F.col("_w"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("_all", F.lit(float(share)) * F.sum("source_size").over(everything))
    full = Window.orderBy("_r", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = Window.orderBy("_r", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # were the sources before this one full, and the others level: the level they would have
    t = t.withColumn("_level", (F.col("_all") - (F.sum("_cap").over(full) - F.col("_cap"))) / F.sum("_w").over(rest))
    # the first source that wouldn't overflow at its level settles it
    t = t.withColumn("_nth", F.row_number().over(Window.orderBy("_r", F.col("source").asc_nulls_last())))
    t = t.withColumn("_level", F.min_by("_level", F.when(F.col("_level") <= F.col("_r"), F.col("_nth"))).over(everything))
    return t.withColumn("target", F.when(F.col("_level").isNull() | (F.col("_w") * F.col("_level") > F.col("_cap")), F.col("_cap")).otherwise(F.col("_w") * F.col("_level"))).select("source", "source_size", "target")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def plan(docs: DataFrame, share: float = 1.5, cycle: tuple = (5, 2, 1), limit: float = 2.0, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Two tables: of documents (doc_id, source, size, hash) and of sources (source, source_size, target, passes, budget, bound,
    missing, tied): every document gives passes times its size, and once more if its hash is below bound; those at
    bound share what is missing."""
    prepare(docs.sparkSession)
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size"), F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).alias("_h"))
    d = table(d.withColumn("hash", F.shiftrightunsigned("_h", 64 - BITS * LEVELS)).drop("_h"), "sizes")
    totals = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(totals, share, cycle, limit)
    t = t.withColumn("_whole", F.floor(F.col("target") + 0.5)).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("_whole") / F.col("source_size"))).otherwise(0))
    t = table(t.withColumn("budget", F.col("_whole") - F.col("passes") * F.col("source_size")).drop("_whole"), "targets")
    bounds = t.select("source", F.col("budget").alias("missing"), F.lit(0).cast("long").alias("bound"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        b = _small(bounds)
        inside = d if level == 0 else d.join(b.select("source", "bound"), d["source"].eqNullSafe(b["source"])).where(F.shiftright("hash", shift + BITS) == F.col("bound")).select(d["source"], "size", "hash")
        bins = inside.groupBy("source", F.shiftright("hash", shift).alias("bin")).agg(F.sum("size").alias("tokens"), F.count("*").alias("tied"))
        before = F.sum("tokens").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.withColumn("before", F.coalesce(before, F.lit(0).cast("long")))
        m = bins.join(b.select(F.col("source").alias("_s"), "missing"), F.col("source").eqNullSafe(F.col("_s")))
        # the first bin in which the running sum goes over what is missing
        m = m.where((F.col("before") <= F.col("missing")) & (F.col("before") + F.col("tokens") > F.col("missing")))
        bounds = table(m.select("source", (F.col("missing") - F.col("before")).alias("missing"), F.col("bin").alias("bound"), "tied"), "bounds")
    s = t.alias("t").join(bounds.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")), "left").select("t.*", "b.missing", "b.bound", "b.tied")
    return d, s


def mix(docs: DataFrame, share: float = 1.5, cycle: tuple = (5, 2, 1), limit: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, size, source, source_size, target, taken (words that the mix takes, repeats counted) of every row of docs."""
    d, s = plan(docs, share, cycle, limit, seed)
    s = _small(s.withColumnRenamed("source", "_s"))
    once = F.when(F.col("bound").isNull() | (F.col("size") == 0), 0).when(F.col("hash") < F.col("bound"), F.col("size")).when(F.col("hash") == F.col("bound"), F.floor(F.col("missing") / F.col("tied"))).otherwise(0)
    return d.join(s, d["source"].eqNullSafe(s["_s"])).select("doc_id", "size", "source", "source_size", "target", (F.col("passes") * F.col("size") + once).cast("long").alias("taken"), "hash")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: a row for each time that a document is taken, whole or, at a boundary, in part counted as
    once more if at least half of it was missing; columns as in docs. A document that the mix doesn't reach is left out."""
    seed = how.get("seed", 17)
    d, s = plan(docs, **how)
    s = _small(s.withColumnRenamed("source", "_s"))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 64 - BITS * LEVELS)
    own = docs.select(F.struct("*").alias("_d"), h.alias("_h"), n_words().alias("_n"))
    j = own.join(s, F.col("_d.source").cast("string").eqNullSafe(F.col("_s")))
    once = F.when(F.col("bound").isNull(), 0).when(F.col("_h") < F.col("bound"), 1).when((F.col("_h") == F.col("bound")) & (2 * F.floor(F.col("missing") / F.col("tied")) >= F.col("_n")) & (F.col("_n") > 0), 1).otherwise(0)
    times = (F.col("passes") + once).cast("int")
    return j.withColumn("_t", times).where("_t > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_t")))).select("_d.*")
