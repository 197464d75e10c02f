"""Daily flow summaries from a stream of trades, written once for each ticker and day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tick_direction(trades: DataFrame) -> DataFrame:
    """trades with dir, the sign of the price against the kept trade before it on that ticker and day. The last price is state, so it carries
    over batch boundaries; a batch's trades are taken in order of ts and event_id."""
    out = "ticker string, day date, ts timestamp, event_id long, price double, size double, exchange int, trf_id int, dir double"

    def run(key, pdfs: Iterator[pd.DataFrame], state):
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        before = pdf["price"].shift(1)
        if len(pdf):
            before.iloc[0] = last if last is not None else pdf["price"].iloc[0]
            state.update((float(pdf["price"].iloc[-1]),))
        pdf["dir"] = (pdf["price"] > before).astype(float) - (pdf["price"] < before).astype(float)
        yield pdf[["ticker", "day", "ts", "event_id", "price", "size", "exchange", "trf_id", "dir"]]

    t = trades.where("size > 0 and price > 0").select("ticker", "day", F.col("ts").cast("timestamp").alias("ts"), "event_id", "price", "size", "exchange", "trf_id")
    return t.groupBy("ticker", "day").applyInPandasWithState(run, out, "last double", "append", "NoTimeout")


def daily_volume(trades: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling days by event time with a watermark: volume, off-exchange volume and count by ticker; a day is emitted once it can't change."""
    t = trades.where("size > 0 and price > 0").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = t.groupBy("ticker", F.window("at", "1 day")).agg(F.sum("size").alias("volume"), F.sum(F.when(F.col("exchange") == 4, F.col("size")).otherwise(0.0)).alias("off_volume"), F.count("*").alias("trades"))
    return g.select("ticker", F.col("window.start").cast("date").alias("day"), "volume", "off_volume", "trades")


def sessions(trades: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Bursts of trading: session windows that end after a gap."""
    t = trades.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = t.groupBy("ticker", F.session_window("at", gap)).agg(F.count("*").alias("trades"), F.sum("size").alias("volume"))
    return g.select("ticker", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "trades", "volume")


def write_once(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("ticker", "day")) -> StreamingQuery:
    """Appends a stream of summaries to a table, each key once, whatever a batch repeats; runs until what is available is done."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(list(keys))
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):  # any error of reading ends the batch, so nothing is written twice
            new = new.join(spark.read.schema(batch.schema).parquet(path).select(*keys), list(keys), "left_anti")
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
