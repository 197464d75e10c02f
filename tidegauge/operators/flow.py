"""Order flow from trades, macro liquidity, and the daily summaries between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import blend, clip

BLOCK_SIZE, BLOCK_NOTIONAL = 10_000, 200_000
#: Weights of the observed flow score.
FLOW_WEIGHTS = {"dark": 0.35, "off": 0.25, "direction": 0.25, "block": 0.15}


def session_flow(trades: DataFrame, trf: list[int] | None = None, block_size: float = BLOCK_SIZE, block_notional: float = BLOCK_NOTIONAL, page_cap: int | None = None) -> DataFrame:
    """One row for each ticker and day from its trades (ticker, day, ts, event_id, price, size, exchange, trf_id). A trade counts as up
    or down against the kept trade just before it; a first trade and an unchanged price count as neither. With page_cap, a day of that many trades or more is truncated."""
    trf = [4] if trf is None else trf
    t = trades.where("size > 0 and price > 0")
    before = F.lag("price").over(Window.partitionBy("ticker", "day").orderBy("ts", "event_id"))
    t = t.withColumns({"_n": F.col("size") * F.col("price"), "_dir": F.coalesce(F.signum(F.col("price") - before), F.lit(0.0)), "_off": F.col("exchange").isin(*trf)})
    t = t.withColumns({"_dark": F.col("_off") & F.col("trf_id").isNotNull(), "_block": (F.col("size") >= block_size) | (F.col("_n") >= block_notional)})

    def part(cond: Column, x: str = "size") -> Column:
        return F.sum(F.when(cond, F.col(x)).otherwise(0.0))

    block = F.col("_block")
    g = t.groupBy("ticker", "day").agg(
        F.sum("size").alias("volume"), F.count("*").alias("trades"), F.sum("_n").alias("notional"), part(F.col("_off")).alias("off_volume"), part(F.col("_dark")).alias("dark_volume"),
        F.sum(block.cast("int")).alias("block_count"), part(block).alias("block_volume"), part(block & F.col("_off")).alias("block_off"), part(block & (F.col("_dir") > 0)).alias("up_volume"), part(block & (F.col("_dir") < 0)).alias("down_volume"),
        F.max("size").alias("largest_print"), F.max("_n").alias("largest_notional"),
    )
    nz = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    g = g.withColumns({
        "vwap": nz("notional", "volume"), "off_share": nz("off_volume", "volume"), "dark_share": nz("dark_volume", "volume"), "block_share": nz("block_volume", "volume"), "block_off_share": nz("block_off", "block_volume"),
        "block_direction": (F.col("up_volume") - F.col("down_volume")) / F.nullif(F.col("up_volume") + F.col("down_volume"), F.lit(0.0)),
        "dark_equals_off": F.abs(F.col("dark_volume") - F.col("off_volume")) <= F.greatest(F.lit(1.0), F.col("off_volume") * 1e-6),
    })
    return g.withColumn("truncated", F.lit(False) if page_cap is None else F.col("trades") >= page_cap)


def multi_session(daily: DataFrame, days: int = 20, least: int = 3) -> DataFrame:
    """Over each ticker's last days sessions: latest, mean and trend (mean of the last three less the mean of all before; null under four)."""
    w = Window.partitionBy("ticker")
    f = daily.withColumn("_back", F.row_number().over(w.orderBy(F.desc("day")))).where(F.col("_back") <= days)
    out = [F.count("*").alias("sessions"), F.max("largest_print").alias("largest_print"), F.max("largest_notional").alias("largest_notional"), F.max_by("block_count", "day").alias("block_count_latest"), F.avg("block_count").alias("block_count_mean"), F.avg("notional").alias("adv"), F.sum(F.col("truncated").cast("int")).alias("truncated_days"), F.bool_and("dark_equals_off").alias("dark_equals_off"), F.avg("block_direction").alias("block_direction"), F.max("day").alias("day")]
    for c in ("off_share", "dark_share", "block_share"):
        late, early = F.avg(F.when(F.col("_back") <= 3, F.col(c))), F.avg(F.when(F.col("_back") > 3, F.col(c)))
        out += [F.max_by(c, "day").alias(f"{c}_latest"), F.avg(c).alias(f"{c}_mean"), (late - early).alias(f"{c}_trend")]
    return f.groupBy("ticker").agg(*out).where(F.col("sessions") >= least)


def trailing(daily: DataFrame, days: int = 20, least: int = 3) -> DataFrame:
    """What the flags look at, for each ticker and day over its last days sessions up to it; trends as in multi_session. Rows with least sessions."""
    own = Window.partitionBy("ticker").orderBy("day")
    w = own.rowsBetween(1 - days, 0)
    trend = lambda c: F.avg(c).over(own.rowsBetween(-2, 0)) - F.avg(c).over(own.rowsBetween(1 - days, -3))
    f = daily.select("ticker", "day", trend("dark_share").alias("dark_trend"), trend("off_share").alias("off_trend"), F.avg("block_direction").over(w).alias("block_direction"), F.max("largest_notional").over(w).alias("largest_notional"), F.count("*").over(w).alias("_n"))
    return f.where(F.col("_n") >= least).drop("_n")


def flow_score() -> Column:
    """-1 to 1 from trends and direction; where dark volume is all off-exchange volume the two are one signal with both weights."""
    w = FLOW_WEIGHTS
    off, dark = clip(25 * F.col("off_share_trend"), -1, 1), clip(30 * F.col("dark_share_trend"), -1, 1)
    rest = [(w["direction"], clip(2 * F.col("block_direction"), -1, 1)), (w["block"], clip(20 * F.col("block_share_trend"), -1, 1))]
    return F.when(F.col("dark_equals_off"), blend([(w["dark"] + w["off"], off), *rest])).otherwise(blend([(w["off"], off), (w["dark"], dark), *rest]))


def block_buckets(multi: DataFrame) -> DataFrame:
    """Tags of a ticker's block trading (not a partition): by share, surprise of share and count against their means, the largest print's
    dollars, and direction. adv: daily dollar volume, or null."""
    surprise = lambda x: F.col(f"{x}_latest") / F.nullif(F.col(f"{x}_mean"), F.lit(0.0))
    m = multi.withColumns({"surprise": surprise("block_share"), "count_surprise": surprise("block_count")})
    c = F.col
    small = c("adv").isNull() | (c("adv") <= 200e6)
    rules = (
        ("Safe Bets", (c("block_share_latest") >= 0.20) & (c("surprise").isNull() | (c("surprise") < 1.5)) & (c("block_direction").isNull() | (c("block_direction") > -0.25))),
        ("Most Unusual", F.coalesce(c("surprise") >= 1.5, F.lit(False)) | (c("count_surprise") >= 2)), ("Top Positions", c("largest_notional") >= 50e6), ("Longshots", (F.abs("block_direction") >= 0.30) & (c("block_share_latest") >= 0.15) & small),
    )
    return m.withColumn("buckets", F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), n) for n, r in rules])))


def flow_panel(daily: DataFrame, days: int = 5) -> DataFrame:
    """For each day, means over the days sessions before it; the day itself isn't looked at."""
    w = Window.partitionBy("ticker").orderBy("day").rowsBetween(-days, -1)
    names = ("off_share", "dark_share", "block_share", "block_direction")
    return daily.withColumns({f"prior_{c}": F.avg(c).over(w) for c in names} | {"prior_n": F.count("*").over(w)}).where(F.col("prior_n") >= days)


def legacy_off_share(trades: DataFrame) -> DataFrame:
    """Latest day's share of volume on exchange 4 less the mean of the days before."""
    g = trades.where("size > 0").groupBy("ticker", "day").agg((F.sum(F.when(F.col("exchange") == 4, F.col("size")).otherwise(0.0)) / F.sum("size")).alias("share"))
    g = g.withColumn("_last", F.max("day").over(Window.partitionBy("ticker")))
    return g.groupBy("ticker").agg((F.max(F.when(F.col("day") == F.col("_last"), F.col("share"))) - F.avg(F.when(F.col("day") < F.col("_last"), F.col("share")))).alias("off_change"))


def macro_trend(series: DataFrame, weeks: int = 13, back: int = 156) -> DataFrame:
    """By series: the last value, its change over weeks against the value known then, and that change's z-score among such changes in
    the last back weeks (10 observations, 5 changes at least). The step between observations follows each series' own frequency."""
    w = Window.partitionBy("series_id")
    s = series.where("value is not null").withColumns({"_end": F.max("obs_date").over(w)})
    s = s.withColumn("_rn", F.row_number().over(w.orderBy("obs_date")))
    last = s.groupBy("series_id").agg(F.count("*").alias("n"), F.max("obs_date").alias("last_date"), F.max_by("value", "obs_date").alias("last"), F.max_by("value", F.when(F.col("obs_date") <= F.date_sub("_end", 7 * weeks), F.col("obs_date"))).alias("prev"))
    recent = s.where(F.col("obs_date") >= F.date_sub("_end", 7 * back)).withColumns({"_k": F.count("*").over(w), "_i": F.row_number().over(w.orderBy("obs_date"))})
    recent = recent.withColumn("_step", F.greatest(F.lit(1), F.floor(F.col("_k") * weeks / back)))
    ago = recent.select("series_id", (F.col("_i") + F.col("_step")).alias("_i"), F.col("value").alias("_v"))
    diffs = recent.join(ago, ["series_id", "_i"]).groupBy("series_id").agg(F.count("*").alias("n_diffs"), F.avg(F.col("value") - F.col("_v")).alias("_m"), F.stddev_pop(F.col("value") - F.col("_v")).alias("_s"), F.max("_k").alias("look"))
    t = last.join(diffs, "series_id", "left").withColumn("change", F.col("last") - F.col("prev"))
    enough = (F.col("n") >= 10) & (F.col("look") > 20) & (F.col("n_diffs") > 5)
    return t.select("series_id", "last_date", "last", "change", (F.col("change") / F.abs(F.nullif("prev", F.lit(0.0))) * 100).alias("change_pct"), F.when(enough, (F.col("change") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).alias("z"))


def liquidity(trends: DataFrame, weights: dict[str, tuple[float, int]]) -> DataFrame:
    """The weighted mean of the series' z-scores, each in its direction, and the regime. weights: (weight, direction) by series."""
    case = lambda k: F.coalesce(*[F.when(F.col("series_id") == n, float(w[k])) for n, w in weights.items()])
    t = trends.withColumns({"_w": case(0), "_d": case(1)}).where("_w is not null and z is not null")
    g = t.agg((F.sum(F.col("_w") * F.col("_d") * F.col("z")) / F.sum("_w")).alias("impulse"), F.count("*").alias("n_series"))
    return g.withColumn("regime", F.when(F.col("impulse") > 0.5, "EXPANDING").when(F.col("impulse") > -0.5, "NEUTRAL").when(F.col("impulse").isNotNull(), "DRAINING"))


def off_exchange_venues(venues: DataFrame, fallback: int = 4) -> DataFrame:
    """exchange: ids of venues (id, type) of type TRF, whatever the case; the fallback where there is none."""
    ids = venues.where("upper(type) = 'TRF' and id is not null").agg(F.collect_set(F.col("id").cast("int")).alias("ids"))
    return ids.select(F.explode(F.when(F.size("ids") > 0, F.col("ids")).otherwise(F.array(F.lit(fallback)))).alias("exchange"))


def off_exchange_volume(trades: DataFrame, venues: DataFrame) -> DataFrame:
    """ticker, day, volume, off_volume by a table of venues."""
    t = trades.where("size > 0 and price > 0").join(off_exchange_venues(venues).withColumn("_off", F.lit(True)), "exchange", "left")
    return t.groupBy("ticker", "day").agg(F.sum("size").alias("volume"), F.sum(F.when(F.col("_off"), F.col("size")).otherwise(0.0)).alias("off_volume"))


def curve_note(spread: str = "value"):
    """What a yield curve's last spread says."""
    return F.when(F.col(spread) < 0, "inverted").when(F.col(spread) > 0.5, "steepening").when(F.col(spread).isNotNull(), "flat")
