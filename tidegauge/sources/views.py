"""Canonical tables that the operators work on, derived from the star schema at hand.

Bars are daily open, high, low, close and volume by ticker: tier 1 by part type, tier 2 by brand, the benchmark over all
line items, and constituents by type and brand. Trades come from the event stream, short interest from open orders, macro series from
weekly order totals by region. Only the columns that a view uses are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as priced lots. The order of lots within a session is fixed by four key columns."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("session"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"))
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    return l.join(p, "l_partkey")


def to_bars(lots: DataFrame, *keys: str) -> DataFrame:
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lots.groupBy(*keys, "session").agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("quantity").alias("volume"))


def bars_t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_bars(ticks(spark, sf_dir).withColumnRenamed("p_type", "ticker"), "ticker")


def bars_t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_bars(ticks(spark, sf_dir).withColumnRenamed("p_brand", "ticker"), "ticker")


def bars_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("session"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"))
    return to_bars(l)


def bars_const(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_bars(ticks(spark, sf_dir).withColumn("parent", F.col("p_type")).withColumn("ticker", F.concat_ws("/", "p_type", "p_brand")), "parent", "ticker")


def bars_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tiers with a tier column."""
    return bars_t1(spark, sf_dir).withColumn("tier", F.lit(1)).unionByName(bars_t2(spark, sf_dir).withColumn("tier", F.lit(2)))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("event_type").alias("ticker"), F.col("ts").cast("date").alias("day"), "ts", "event_id", F.col("value").alias("price"), (k * 100).alias("size"),
        F.when(F.col("user_id") % 5 < 2, 4).otherwise(11).alias("exchange"), F.when(F.col("user_id") % 5 == 0, (1 + F.col("user_id") % 3).cast("int")).alias("trf_id"),
    )


def short_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements on the 15th and at month's end, by order priority: open orders' total, and the mean daily total of all orders."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus", "o_totalprice")
    o = o.withColumn("settlement", F.when(F.dayofmonth("day") <= 15, F.date_add(F.trunc("day", "month"), 14)).otherwise(F.last_day("day")))
    return o.groupBy("ticker", "settlement").agg(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(0.0)).alias("short_interest"), (F.sum("o_totalprice") / F.countDistinct("day")).alias("avg_daily_volume"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly order totals by region of the customer, dated on Mondays."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.to_date(F.date_trunc("week", "o_orderdate")).alias("obs_date"), "o_totalprice")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    r = read(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("series_id"))
    # nation and region have fixed sizes
    return o.join(c, "o_custkey").join(F.broadcast(n), "n_nationkey").join(F.broadcast(r), "r_regionkey").groupBy("series_id", "obs_date").agg(F.sum("o_totalprice").alias("value"))


_ORDER = "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _bars_sql(key: str, ticker: str, extra: str = "") -> str:
    group = ", ".join(x for x in (key, "session") if x)
    head = f"{ticker} AS ticker, " if ticker else ""
    return f"""SELECT {head}{extra}session, first(price {_ORDER}) AS open, max(price) AS high, min(price) AS low, last(price {_ORDER}) AS close, sum(quantity) AS volume FROM lots GROUP BY {group}"""


#: The same views for the SQL oracles, by name; each stands in a WITH list after those it uses.
SQL = {
    "lots": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE AS session, l_extendedprice / l_quantity AS price, l_quantity AS quantity, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey",
    "bars_t1": _bars_sql("p_type", "p_type"),
    "bars_t2": _bars_sql("p_brand", "p_brand"),
    "bars_bench": _bars_sql("", ""),
    "bars_const": _bars_sql("p_type, p_brand", "p_type || '/' || p_brand", "p_type AS parent, "),
    "bars_all": "SELECT *, 1 AS tier FROM bars_t1 UNION ALL SELECT *, 2 AS tier FROM bars_t2",
    "trades": "SELECT event_type AS ticker, ts::DATE AS day, ts, event_id, value AS price, (props->>'$.k')::DOUBLE * 100 AS size, CASE WHEN user_id % 5 < 2 THEN 4 ELSE 11 END AS exchange, CASE WHEN user_id % 5 = 0 THEN 1 + user_id % 3 END AS trf_id FROM events",
    "short_int": "SELECT o_orderpriority AS ticker, CASE WHEN day(o_orderdate) <= 15 THEN (date_trunc('month', o_orderdate) + INTERVAL 14 DAY)::DATE ELSE last_day(o_orderdate::DATE) END AS settlement, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS short_interest, sum(o_totalprice) / count(DISTINCT o_orderdate::DATE) AS avg_daily_volume FROM orders GROUP BY ALL",
    "macro": "SELECT r_name AS series_id, date_trunc('week', o_orderdate)::DATE AS obs_date, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
}


def with_sql(*names_and_sql: tuple[str, str] | str) -> str:
    """A WITH list of these: names of SQL above, or (name, SQL) pairs."""
    parts = [(x, SQL[x]) if isinstance(x, str) else x for x in names_and_sql]
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts)
