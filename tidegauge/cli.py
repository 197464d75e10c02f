"""Command line: python -m tidegauge.cli snapshot|query|list. Snapshots and query results are written as Parquet or JSON."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry
from .operators import cross_section as X
from .plans import t2


def snapshot(spark: SparkSession, sf_dir: str, tickers: list[str] | None = None, tier: int | None = None) -> DataFrame:
    """Each ticker's last scored row, ranked in its tier. A ticker that doesn't exist is an error, not an empty result."""
    f = X.tier_rank(X.latest(t2.frame(spark, sf_dir)))
    if tier is not None:
        f = f.where(F.col("tier") == tier)
    if tickers:
        asked = spark.createDataFrame([(t,) for t in tickers], "ticker string")
        unknown = [r["ticker"] for r in asked.join(f, "ticker", "left_anti").collect()]
        if unknown:
            raise SystemExit(f"unknown tickers: {', '.join(sorted(unknown))}")
        f = f.where(F.col("ticker").isin(tickers))
    return f.select("ticker", "tier", "session", "phase", "quadrant", "csri", "csri_delta", "rank", "percentile", "mansfield_rs", "rs_mom", "breadth", "cmf", "inst", "mom_12_1")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidegauge", description=__doc__)
    p.add_argument("what", choices=["snapshot", "query", "list"])
    p.add_argument("name", nargs="?", help="of the query")
    p.add_argument("--tables", help="folder of the input tables")
    p.add_argument("--out", help="folder to write to; without it, rows are shown")
    p.add_argument("--format", choices=["parquet", "json", "csv"], default="parquet")
    p.add_argument("--tickers", type=lambda x: [t.strip() for t in x.split(",") if t.strip()])
    p.add_argument("--tier", type=int, choices=[1, 2])
    a = p.parse_args(args)
    if a.what == "list":
        print("\n".join(registry.QUERIES))
        return
    if not a.tables or a.what == "query" and a.name not in registry.QUERIES:
        p.error("--tables and, for query, the name of a query are needed")
    spark = SparkSession.builder.appName("tidegauge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = snapshot(spark, a.tables, a.tickers, a.tier) if a.what == "snapshot" else registry.QUERIES[a.name](spark, a.tables)
    if a.out:
        df.write.mode("overwrite").format(a.format).save(a.out)
    else:
        df.show(50, truncate=False)


if __name__ == "__main__":
    main()
