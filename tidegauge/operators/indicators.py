"""Per-instrument indicators. Every function takes bars (ticker, session, open, high, low, close, volume and any other columns) and
returns them with its columns added. All windows partition by ticker and order by session, so a chain of indicators
shuffles its bars once. All are causal: later bars never change earlier rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import clip, flag, lag, last_rows, lead, mean, median, new_run, ordered, position, ratio, roll, run_id, total, z


def returns(bars: DataFrame, spans: tuple[int, ...] = (1, 5, 21, 63)) -> DataFrame:
    return bars.withColumns({f"ret_{n}": ratio("close", lag("close", n)) - 1 for n in spans})


def volume_z(bars: DataFrame, n: int = 60) -> DataFrame:
    b = bars.withColumns({"_lv": F.log1p("volume"), "_ld": F.log1p(F.col("volume") * F.col("close"))})
    return b.withColumns({"volume_z": z("_lv", n), "dollar_volume_z": z("_ld", n)}).drop("_lv", "_ld")


def relative_strength(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """rs: close over the benchmark's close on shared sessions, 100 at the first of them. Sessions that either lacks drop out."""
    b = bars.join(bench.select("session", F.col("close").alias("bench_close")), "session").where("close is not null and bench_close is not null")
    b = b.withColumn("_rs", ratio("close", "bench_close"))
    first = F.first("_rs").over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("rs", F.col("_rs") / first * 100).drop("_rs")


def mansfield(rs: DataFrame, n: int = 200) -> DataFrame:
    return rs.withColumn("mansfield_rs", (ratio("rs", mean("rs", n, max(30, n // 4))) - 1) * 100)


def rrg_raw(rs: DataFrame, short: int = 10, long: int = 40, mom: int = 10, least: int = 60) -> DataFrame:
    """Relative rotation: the ratio of a short to a long mean of relative strength, and its momentum, from least sessions on."""
    r = rs.withColumn("n_bars", position()).withColumn("_ratio", 100 * ratio(mean("rs", short), mean("rs", long)))
    r = r.withColumn("rs_mom_raw", F.when(F.col("n_bars") >= least, 100 * ratio("_ratio", mean("_ratio", mom))))
    return r.withColumn("rs_ratio_raw", F.when(F.col("n_bars") >= least, F.col("_ratio"))).drop("_ratio")


def money_flow(bars: DataFrame, n: int = 21) -> DataFrame:
    """cmf: where closes stood in their range, weighted by volume. A bar without range adds nothing."""
    spread = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    b = bars.withColumn("_mf", F.coalesce(((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / spread * F.col("volume"), F.lit(0.0)))
    return b.withColumn("cmf", ratio(total("_mf", n, max(1, n // 3)), total("volume", n, max(1, n // 3)))).drop("_mf")


def ad_balance(bars: DataFrame, n: int = 25, move: float = 0.002) -> DataFrame:
    """Up days less down days on more than the average volume, as a share of n."""
    b = bars.withColumns({"_r": ratio("close", lag("close")) - 1, "_av": mean("volume", 50, 20)})
    heavy = F.col("volume") > F.col("_av")
    b = b.withColumn("_ad", flag((F.col("_r") > move) & heavy) - flag((F.col("_r") < -move) & heavy))
    return b.withColumn("ad_balance", total("_ad", n, 8) / n).drop("_r", "_av", "_ad")


def absorption(bars: DataFrame, n: int = 25) -> DataFrame:
    """Heavy volume that closes high in its range without moving the price."""
    b = volume_z(bars) if "volume_z" not in bars.columns else bars
    clv = (F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    quiet = 1 / (1 + F.coalesce(F.abs(ratio("close", lag("close")) - 1) / 0.004, F.lit(0.0)))
    heavy = F.when(F.col("volume_z").isNotNull(), F.greatest("volume_z", F.lit(0.0)))
    b = b.withColumn("_ab", (clv - 0.5) * 2 * heavy * quiet)
    return b.withColumn("absorption", mean("_ab", n, 8)).drop("_ab")


def block_intensity(bars: DataFrame, n: int = 25, least: int = 12) -> DataFrame:
    """The share of the window's volume on its heaviest eighth of days, over what an even spread would give; and its z-score."""
    w = last_rows(n)
    b = bars.withColumn("_vs", F.sort_array(F.collect_list("volume").over(w), asc=False))
    size = F.size("_vs")
    k = F.greatest(F.lit(3), F.floor(size / 8).cast("int"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = add(F.slice("_vs", F.lit(1), k)) / F.nullif(add(F.col("_vs")), F.lit(0.0)) - k / size
    b = b.withColumn("block_intensity", F.when(size >= least, share)).drop("_vs")
    return b.withColumn("block_intensity_z", z("block_intensity", 120, 30))


def momentum(bars: DataFrame, long: int = 252, skip: int = 21, name: str = "mom_12_1") -> DataFrame:
    """Return from long + skip sessions back to skip sessions back, with one bar to spare."""
    now, then = lag("close", skip) if skip else F.col("close"), lag("close", long + skip)
    return bars.withColumn(name, F.when((position() >= long + skip + 2) & (then > 0), (now / then - 1) * 100))


def momentum_variants(bars: DataFrame) -> DataFrame:
    for name, long, skip in (("mom_12_1", 252, 21), ("mom_6_1", 126, 21), ("mom_3_1", 63, 21), ("mom_12_0", 252, 0)):
        bars = momentum(bars, long, skip, name)
    return bars


def volume_trend(bars: DataFrame, recent: int = 20, base: int = 60) -> DataFrame:
    """Median of recent non-zero volumes against the median of the base before them; the windows don't overlap."""
    b = bars.withColumn("_v", F.nullif("volume", F.lit(0.0)))
    return b.withColumn("volume_trend", (ratio(median("_v", recent, recent // 2), median("_v", base, base // 2, skip=recent)) - 1) * 100).drop("_v")


def volume_regime(bars: DataFrame, span: int = 252) -> DataFrame:
    """On readings of volume_trend alone: z-score and percentile against the last span readings, regime, its run, slope and labels."""
    t = volume_trend(bars).where("volume_trend is not null")
    w, x = last_rows(span), F.col("volume_trend")
    t = t.withColumns({"readings": position(), "_sd": F.stddev_pop(x).over(w), "_mean": F.avg(x).over(w), "_all": F.collect_list(x).over(w)})
    t = t.withColumn("trend_z", F.when(F.col("_sd") > 0, (x - F.col("_mean")) / F.col("_sd")).otherwise(0.0))
    t = t.withColumn("trend_pct", F.size(F.filter("_all", lambda e: e < F.col("volume_trend"))) / F.size("_all") * 100)
    t = t.withColumn("regime", F.when(x > 15, "expanding").when(x < -10, "contracting").otherwise("flat"))
    t = t.withColumn("changed", new_run("regime")).withColumn("_run", run_id())
    t = t.withColumn("run_days", F.row_number().over(Window.partitionBy("ticker", "_run").orderBy("session")))
    t = t.withColumn("trend_slope", x - lag("volume_trend", 21))
    strength = F.abs("trend_z")
    return (
        t.withColumn("sustained", F.col("run_days") >= 20)
        .withColumn("direction", F.when(F.col("trend_slope") > 5, "building").when(F.col("trend_slope") < -5, "rolling over").when(F.col("trend_slope").isNotNull(), "steady"))
        .withColumn("strength", F.when(strength >= 2.5, "extreme").when(strength >= 1.5, "strong").when(strength >= 0.75, "notable").otherwise("unremarkable"))
        .where("readings >= 30")
        .drop("_sd", "_mean", "_all", "_run", "changed")
    )


def distribution_days(bars: DataFrame, n: int = 25, move: float = 0.002) -> DataFrame:
    """Days in the last n that fell (rose) on more volume than the day before."""
    r, more = ratio("close", lag("close")) - 1, F.col("volume") > lag("volume")
    b = bars.withColumns({"_d": flag((r < -move) & more), "_a": flag((r > move) & more)})
    return b.withColumns({"dist_days": total("_d", n, 8), "acc_days": total("_a", n, 8)}).drop("_d", "_a")


def price_volume_divergence(bars: DataFrame, n: int = 42) -> DataFrame:
    """What the price did over n sessions against what volume did, from n + 10 bars on."""
    b = volume_trend(bars) if "volume_trend" not in bars.columns else bars
    move, v = (ratio("close", lag("close", n)) - 1) * 100, F.col("volume_trend")
    b = b.withColumns({"n_bars": position(), "price_move": move})
    p = F.col("price_move")
    kind = F.when((p > 3) & (v < -10), "bearish").when((p < -3) & (v < -10), "bullish").when((p > 3) & (v > 15), "confirmed_up").when((p < -3) & (v > 15), "confirmed_down").otherwise("none")
    enough = (F.col("n_bars") >= n + 10) & p.isNotNull() & v.isNotNull()
    return b.withColumns({"divergence": F.when(enough, kind), "depletion": F.when(enough, kind.isin("bearish", "bullish"))})


def obv_slope(bars: DataFrame, n: int = 21) -> DataFrame:
    """Signed volume of the last n sessions over their volume; null until n sessions lie behind."""
    b = bars.withColumn("_s", F.coalesce(F.signum(F.col("close") - lag("close")), F.lit(0.0)) * F.col("volume"))
    return b.withColumn("obv_slope", F.when(position() > n, ratio(total("_s", n), total("volume", n, 5)))).drop("_s")


def moving_averages(bars: DataFrame, spans: tuple[int, ...] = (20, 50, 150, 200)) -> DataFrame:
    b = bars.withColumns({f"sma_{n}": mean("close", n) for n in spans})
    return b.withColumns({f"above_{n}": F.when(F.col(f"sma_{n}").isNotNull(), F.col("close") > F.col(f"sma_{n}")) for n in spans})


def breadth(constituents: DataFrame, n: int = 50, least_bars: int = 55, least_names: int = 8) -> DataFrame:
    """parent, session, breadth: of a parent's constituents with an average, the share (in 100) that close above it. A constituent counts
    from its least_bars-th bar on, and a parent has a breadth from the day on which least_names of its constituents do."""
    c = constituents.withColumns({"_sma": mean("close", n), "_bars": position()}).where(F.col("_bars") >= least_bars)
    entry = c.groupBy("parent", "ticker").agg(F.min("session").alias("_since"))
    nth = F.row_number().over(Window.partitionBy("parent").orderBy("_since", "ticker"))
    entry = entry.withColumn("_nth", nth).where(F.col("_nth") == least_names).select("parent", "_since")
    day = c.where("_sma is not null").groupBy("parent", "session").agg((F.avg(flag(F.col("close") > F.col("_sma"))) * 100).alias("breadth"), F.count("*").alias("n_names"))
    return day.join(entry, "parent").where(F.col("session") >= F.col("_since")).drop("_since")


def short_interest_metrics(settlements: DataFrame, as_of: DataFrame, lag_days: int = 14) -> DataFrame:
    """For each (ticker, as_of): the last settlement published by then (lag_days after it), its days to cover, percentile among
    all published (12 at least, strictly below), and change against the mean of the six before (7 at least)."""
    w = ordered("ticker", "settlement")
    s = settlements.where("short_interest is not null or avg_daily_volume is not null").withColumn("days_to_cover", ratio("short_interest", "avg_daily_volume"))
    s = s.withColumns({"n_settlements": F.row_number().over(w), "_hist": F.collect_list("days_to_cover").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_prior": F.avg("short_interest").over(w.rowsBetween(-6, -1))})
    s = s.withColumn("dtc_pct", F.when(F.size("_hist") >= 12, F.size(F.filter("_hist", lambda e: e < F.col("days_to_cover"))) / F.size("_hist") * 100))
    s = s.withColumn("si_change", F.when(F.col("n_settlements") >= 7, (ratio("short_interest", "_prior") - 1) * 100))
    s = s.withColumn("crowded", F.coalesce(F.col("dtc_pct") >= 75, F.lit(False))).withColumn("until", F.lead("settlement").over(w))
    s = s.drop("_hist", "_prior", "short_interest", "avg_daily_volume")
    # published intervals don't overlap, so each as_of meets one settlement
    available, gone = F.date_add("settlement", lag_days), F.date_add("until", lag_days)
    return as_of.join(s, "ticker").where((available <= F.col("as_of")) & (F.col("until").isNull() | (gone > F.col("as_of")))).drop("until")


def index_divergence(rs: DataFrame, n: int = 63, gap: float = 8.0) -> DataFrame:
    """On shared sessions: instrument and benchmark moved opposite ways over n sessions, by at least gap points."""
    own, bench = (ratio("close", lag("close", n)) - 1) * 100, (ratio("bench_close", lag("bench_close", n)) - 1) * 100
    d = rs.withColumns({"own_move": own, "bench_move": bench}).withColumn("move_gap", F.col("own_move") - F.col("bench_move"))
    return d.withColumn("diverging", F.when(F.col("move_gap").isNotNull(), (F.signum("own_move") * F.signum("bench_move") < 0) & (F.abs("move_gap") >= gap)))


def squeeze(frame: DataFrame) -> DataFrame:
    """0 to 3: crowded shorts, divergence from the index, and relative strength above its reading 21 back (22 readings at least)."""
    better = F.col("mansfield_rs") > lag("mansfield_rs", 21)
    return frame.withColumn("squeeze_score", (flag(F.col("crowded")) + flag(F.col("diverging")) + flag(better)).cast("int"))


def green_light(frame: DataFrame) -> DataFrame:
    """Three lights: relative strength positive and rising; price above a rising 50-session average; recent heavy up-volume."""
    f = frame.withColumns({"_s21": lag("sma_50", 21), "_m21": lag("mansfield_rs", 21), "_vz": F.max("volume_z").over(last_rows(5)), "_r1": ratio("close", lag("close")) - 1})
    f = f.withColumn("_rx", F.max("_r1").over(last_rows(5)))
    one = (F.col("mansfield_rs") > 0) & (F.col("mansfield_rs") > F.col("_m21"))
    two = (F.col("close") > F.col("sma_50")) & (F.col("sma_50") > F.col("_s21"))
    three = (F.col("_vz") >= 1) & (F.col("_rx") > 0)
    f = f.withColumns({"light_1": F.coalesce(one, F.lit(False)), "light_2": F.coalesce(two, F.lit(False)), "light_3": F.coalesce(three, F.lit(False))})
    return f.withColumn("lights", sum((F.col(f"light_{i}").cast("int") for i in (1, 2, 3)), F.lit(0))).drop("_s21", "_m21", "_vz", "_r1", "_rx")


def setups(bars: DataFrame, look: int = 5, touch: float = 0.02) -> DataFrame:
    """ticker, session, setup, direction, stop, confirmed: each kind's latest occurrence within a ticker's last look bars (60 bars at least).
    A breakout is confirmed by the next close above its high; on the last bar that isn't known yet."""
    b = bars.withColumns({"n_bars": position(), "_back": F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("session"))), "_av": mean("volume", 50, 20), "_range": F.col("high") - F.col("low"), "sma_50": mean("close", 50)})
    b = b.withColumns({"_big": F.col("_range") > 1.3 * mean("_range", 20, 10), "_slope": F.coalesce((ratio("sma_50", lag("sma_50", 21)) - 1) * 100, F.lit(0.0)), "_over": F.coalesce(lag("close") > lag("sma_50"), F.lit(False)), "_next": lead("close")})
    b = b.withColumns({"_red": lag("close", 2) < lag("open", 2), "_recovered": lag("close") > lag("open", 2), "_higher": F.col("close") > lag("close"), "_low2": lag("low", 2)})
    b = b.withColumn("_total", F.max("n_bars").over(Window.partitionBy("ticker")))
    low, close, sma, slope, over_ = (F.col(c) for c in ("low", "close", "sma_50", "_slope", "_over"))
    heavy, up_day = F.col("volume") > F.col("_av"), close > F.col("open")
    kinds = (
        ("ma_bounce", "long", (low <= sma * (1 + touch)) & (close > sma) & (slope > 0) & up_day & heavy & over_, F.least(low, sma) * 0.99),
        ("breakout", "long", ~over_ & (close > sma) & up_day & F.col("_big") & (slope > -0.5), sma * 0.99),
        ("breakdown", "exit/short", over_ & (close < sma) & ~up_day & heavy, sma * 1.01),
        ("reversal", "long", F.col("_red") & F.col("_recovered") & F.col("_higher") & heavy, F.col("_low2") * 0.99),
    )
    found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(n).alias("setup"), F.lit(way).alias("direction"), stop.alias("stop"))) for n, way, cond, stop in kinds]))
    b = b.withColumn("_found", found).where((F.col("_back") <= look) & (F.col("_total") >= 60) & (F.col("n_bars") > 50) & sma.isNotNull() & F.col("_av").isNotNull())
    b = b.select("ticker", "session", F.explode("_found").alias("s"), "high", "_next").select("ticker", "session", "s.*", F.when(F.col("s.setup") == "breakout", F.col("_next") > F.col("high")).alias("confirmed"))
    latest = F.row_number().over(Window.partitionBy("ticker", "setup").orderBy(F.desc("session")))
    return b.withColumn("_n", latest).where("_n = 1").drop("_n")


def sma_breakouts(bars: DataFrame, spans: tuple[int, ...] = (20, 50, 150), within: int = 120) -> DataFrame:
    """Closes that crossed an average in either direction within the last bars: gap to it, its slope (0 where unknown), volume against
    average, and whether the next bar held. An average needs five bars beyond its span, and a ticker 30."""
    b = bars.withColumns({"_i": position(), "_back": F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("session"))), "_av": mean("volume", 50, 10)})
    b = b.withColumns({f"_m{n}": mean("close", n) for n in spans} | {"_total": F.max("_i").over(Window.partitionBy("ticker"))})
    b = b.withColumns({f"_a{n}": F.coalesce(F.col("close") > F.col(f"_m{n}"), F.lit(False)) for n in spans})
    each = [F.struct(F.lit(n).alias("sma"), F.col(f"_m{n}").alias("level"), F.col(f"_a{n}").alias("above"), lag(f"_a{n}").alias("was"), lag(f"_m{n}", 21).alias("level_21"), lead(f"_a{n}").alias("after")) for n in spans]
    b = b.withColumn("_each", F.array(*each)).where(F.col("_back") <= within)
    b = b.select("ticker", "session", "close", "volume", "_av", "_i", "_total", F.explode("_each").alias("e")).where("e.above <> e.was and _i > e.sma and _total >= greatest(30, e.sma + 5)")
    heavy = F.nullif(ratio("volume", "_av"), F.lit(0.0))
    return b.select(
        "ticker", "session", "e.sma", F.when(F.col("e.above"), "up").otherwise("down").alias("direction"), ((F.col("close") / F.col("e.level") - 1) * 100).alias("gap_pct"), F.coalesce((ratio("e.level", "e.level_21") - 1) * 100, F.lit(0.0)).alias("slope_pct"),
        heavy.alias("volume_ratio"), F.coalesce(heavy >= 1.2, F.lit(False)).alias("volume_confirmed"), (F.col("e.after") == F.col("e.above")).alias("confirmed"),
    )


def stage_features(bars: DataFrame, n: int = 50) -> DataFrame:
    b = distribution_days(volume_trend(bars)).withColumns({"n_bars": position(), "sma_50": mean("close", n)})
    b = b.withColumns({"_side": F.signum(F.col("close") - F.col("sma_50")), "slope": F.coalesce((ratio("sma_50", lag("sma_50", 21)) - 1) * 100, F.lit(0.0))})
    b = b.withColumn("_cross", F.when(F.col("_side").isNotNull() & lag("_side").isNotNull(), flag(F.col("_side") != lag("_side"))))
    return b.withColumns({"above": F.coalesce(F.col("close") > F.col("sma_50"), F.lit(False)), "crossings": F.coalesce(total("_cross", 59), F.lit(0.0)), "vol_trend": F.coalesce("volume_trend", F.lit(0.0)), "dist": F.coalesce("dist_days", F.lit(0.0)), "acc": F.coalesce("acc_days", F.lit(0.0))}).drop("_side", "_cross")


def stage_label(f: dict[str, Column] | None = None) -> Column:
    """Stage 1 to 4 by the first rule that fits; 0 before 80 bars. Columns of stage_features()."""
    above, slope, crossings, v, dist, acc = (F.col(c) for c in ("above", "slope", "crossings", "vol_trend", "dist", "acc"))
    growing, shrinking = v > 15, v < -10
    ranging = (crossings >= 6) & (F.abs(slope) <= 0.75)
    selling = (dist >= 6) & (dist > acc)
    return (
        F.when(F.col("n_bars") < 80, 0)
        .when(~above & (slope < -0.75), 4)
        .when(above & (slope > 0.75), F.when(shrinking, 3).otherwise(2))
        .when(ranging, F.when(shrinking, 1).when(growing | (dist >= 5) | (dist > acc), 3).otherwise(1))
        .when(~above & (slope < -0.25), 4)
        .when(above & (slope < -0.25), 3)
        .when(~above & (slope > 0.25), F.when(selling, 3).otherwise(2))
        .when(above, F.when(selling, 3).otherwise(2))
        .when(selling, F.when(slope > 0, 3).otherwise(4))
        .otherwise(1)
    )


def stages(bars: DataFrame) -> DataFrame:
    return stage_features(bars).withColumn("stage", stage_label())


def durations(frame: DataFrame, value: str) -> DataFrame:
    """The last run of a value by ticker: value, days, the value before, and since when (null if there was none before)."""
    f = frame.withColumn("changed", new_run(value)).withColumn("_run", run_id())
    runs = f.groupBy("ticker", "_run").agg(F.first(value).alias("value"), F.count("*").alias("days"), F.min("session").alias("since"))
    w = Window.partitionBy("ticker").orderBy("_run")
    runs = runs.withColumns({"previous": F.lag("value").over(w), "_last": F.lead("_run").over(w).isNull()}).where("_last")
    return runs.select("ticker", "value", "days", "previous", F.when(F.col("previous").isNotNull(), F.col("since")).alias("since"))


def decimate(frame: DataFrame, value: str, keep: int = 120, points: int = 60) -> DataFrame:
    """The last keep readings, thinned to points evenly spaced ones that include first and last."""
    f = frame.where(F.col(value).isNotNull()).withColumn("_back", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("session")))).where(F.col("_back") <= keep)
    f = f.withColumns({"_i": position() - 1, "_n": F.count("*").over(Window.partitionBy("ticker"))})
    wanted = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (points - 1)).cast("int")))
    return f.where((F.col("_n") <= points) | F.array_contains(wanted, F.col("_i").cast("int"))).select("ticker", "session", value)


def series_trend(frame: DataFrame, value: str, horizon: int = 21, smooth: int = 5) -> DataFrame:
    """By ticker: the median of the last smooth readings less the median of those that ended horizon readings back; null for short series."""
    f = frame.where(F.col(value).isNotNull()).withColumn("_back", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("session"))))
    now, then = F.col("_back") <= smooth, (F.col("_back") > horizon) & (F.col("_back") <= horizon + smooth)
    g = f.groupBy("ticker").agg(F.percentile(F.when(now, F.col(value)), F.lit(0.5)).alias("now"), F.percentile(F.when(then, F.col(value)), F.lit(0.5)).alias("then"), F.count("*").alias("n"))
    return g.select("ticker", F.when(F.col("n") >= max(horizon + smooth, 40), F.col("now") - F.col("then")).alias("trend"))


def mansfield_cross_up(frame: DataFrame) -> DataFrame:
    """Relative strength above zero now, not above it 21 readings back; 23 readings at least."""
    f = frame.where("mansfield_rs is not null")
    return f.withColumn("cross_up", (position() >= 23) & (F.col("mansfield_rs") > 0) & F.coalesce(lag("mansfield_rs", 21) <= 0, F.lit(False)))


def z_last(frame: DataFrame, values: dict[str, str], n: int = 252, least: int = 40, spread: bool = False) -> DataFrame:
    """z-scores of each reading against the last n readings with it, clipped to 3; 0 where they don't vary. Rows without a reading have none.
    values: output by input. With spread, sd_<output> is the deviation itself. Each sliding aggregate is taken once and then reused."""
    for x, out in values.items():
        there = Window.partitionBy("ticker", F.col(x).isNotNull()).orderBy("session")
        w = there.rowsBetween(-(n - 1), 0)
        frame = frame.withColumns({f"n_{out}": F.row_number().over(there), "_m": F.avg(x).over(w), f"sd_{out}": F.stddev_pop(x).over(w)})
        frame = frame.withColumn("_z", (F.col(x) - F.col("_m")) / F.nullif(F.col(f"sd_{out}"), F.lit(0.0)))
        score = F.when(F.col(f"sd_{out}") > 0, clip(F.col("_z"), -3, 3)).otherwise(0.0)
        frame = frame.withColumn(out, F.when(F.col(x).isNotNull() & (F.col(f"n_{out}") >= least), score)).drop("_m", "_z")
    return frame if spread else frame.drop(*[f"{p}_{out}" for out in values.values() for p in ("n", "sd")])


__all__ = [n for n in dir() if n[0] != "_"] + ["roll"]


def sign_run(b: DataFrame, x: str) -> DataFrame:
    """ticker, positive, sessions: for how many of its last sessions x, where it is a number, has kept the sign it has now; zero counts as positive."""
    newest_first = Window.partitionBy("ticker").orderBy(F.desc("session"))
    v = b.where(F.col(x).isNotNull() & ~F.isnan(x)).select("ticker", "session", (F.col(x) >= 0).alias("positive"))
    v = v.withColumn("_now", F.first("positive").over(newest_first)).withColumn("_over", F.max(F.col("positive") != F.col("_now")).over(newest_first))
    return v.where("not _over").groupBy("ticker").agg(F.first("positive").alias("positive"), F.count("*").alias("sessions"))
