"""Ingestion and data quality: normalising bars, caches and provider chains as tables, integrity checks and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import flag, lag, median, ordered, ratio


def normalise_bars(raw: DataFrame, sequence: str = "seq") -> DataFrame:
    """One row for each ticker and session (the last by sequence), numbers parsed leniently, no row without a close, null volume as 0."""
    parsed = raw.withColumns({c: F.expr(f"try_cast({c} AS double)") for c in ("open", "high", "low", "close", "volume")})
    cols = ("open", "high", "low", "close", "volume")
    parsed = parsed.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})
    last = parsed.groupBy("ticker", "session").agg(F.max_by(F.struct(*cols), sequence).alias("b")).select("ticker", "session", "b.*")
    return last.where("close is not null").fillna(0.0, ["volume"])


def adjusted(raw: DataFrame) -> DataFrame:
    """Bars from parallel arrays (ticker, t, o, h, l, c, v, adj), prices scaled by adjusted over plain close, volume not; a missing factor counts as 1."""
    z = F.explode(F.arrays_zip("t", "o", "h", "l", "c", "v", "adj"))
    b = raw.select("ticker", z.alias("z")).select("ticker", F.to_date(F.timestamp_seconds("z.t")).alias("session"), *[F.col(f"z.{x}").cast("double").alias(x) for x in ("o", "h", "l", "c", "v", "adj")])
    k = F.coalesce(F.col("adj") / F.nullif("c", F.lit(0.0)), F.lit(1.0))
    return b.select("ticker", "session", (F.col("o") * k).alias("open"), (F.col("h") * k).alias("high"), (F.col("l") * k).alias("low"), (F.col("c") * k).alias("close"), F.col("v").alias("volume"))


def history_records(payloads: DataFrame) -> DataFrame:
    """Raw bars (ticker, session, open to volume as text, seq) from JSON in a column value, an array of records or an object whose
    "historical" holds it. Records without a date, and other payloads, give no rows; normalise_bars takes these."""
    record = "array<struct<date string, open string, high string, low string, close string, volume string>>"
    both = F.coalesce(F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", record)), F.from_json("value", f"historical {record}")["historical"])
    e = payloads.select("ticker", F.posexplode(both).alias("seq", "r"))
    return e.select("ticker", F.expr("try_cast(substr(r.date, 1, 10) AS date)").alias("session"), *[F.col(f"r.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")], "seq").where("session is not null")


def aggregate_records(payloads: DataFrame) -> DataFrame:
    """The same from payloads {"results": [{t, o, h, l, c, v}]}, t in milliseconds of UTC."""
    e = payloads.select("ticker", F.posexplode(F.from_json("value", "results array<struct<t bigint, o string, h string, l string, c string, v string>>")["results"]).alias("seq", "r"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("r.t") / 86_400_000).cast("int"))
    return e.select("ticker", day.alias("session"), *[F.col(f"r.{c[0]}").alias(c) for c in ("open", "high", "low", "close", "volume")], "seq").where("session is not null")


def usable_providers(order: list[str], keyless: set[str], keys: dict[str, str], required: str | None = None) -> list[str]:
    """Providers in order of preference that need no key or have one; a required one stands alone, and its missing key is an error."""
    have = lambda p: p in keyless or bool(keys.get(p))
    if required:
        if not have(required):
            raise ValueError(f"provider {required} is required, but has no key")
        return [required]
    return [p for p in order if have(p)]


def still_to_fetch(bars: DataFrame, done: DataFrame, today, last: int, skip: int = 0) -> DataFrame:
    """ticker, session: of each ticker's sessions before today, the last ones but for the newest skip, without those that are done. What is
    stopped half way goes on from there."""
    n = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("session")))
    w = bars.where(F.col("session") < today).select("ticker", "session", n.alias("_n")).where((F.col("_n") > skip) & (F.col("_n") <= skip + last)).drop("_n")
    return w.join(done.select("ticker", "session"), ["ticker", "session"], "left_anti")


def pick_source(cached: DataFrame, priority: dict[str, int], least_fetched: int = 100, least_cached: int = 250) -> DataFrame:
    """Of a ticker's candidate sources (ticker, provider, fetched boolean, rows), the first by priority that has enough rows; else the longest that there is."""
    order = F.coalesce(*[F.when(F.col("provider") == p, k) for p, k in priority.items()], F.lit(len(priority)))
    enough = F.when(F.col("fetched"), F.col("rows") > least_fetched).otherwise(F.col("rows") > least_cached)
    w = Window.partitionBy("ticker").orderBy(F.desc(enough.cast("int")), F.when(enough, order).otherwise(0), F.desc("rows"), "provider")
    return cached.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("ticker", "provider", "rows", F.when(enough, "ok").otherwise("stale").alias("state"))


def cache_is_valid(sources: DataFrame, asked_days: int, max_age_hours: float, now, provider: str | None = None) -> DataFrame:
    """Valid cache entries, from metadata alone (ticker, provider, days, rows, at): young enough, deep enough, of the provider."""
    young = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("at")) <= max_age_hours * 3600
    ok = young & (F.col("days") >= 0.95 * asked_days) & (F.col("rows") > 0)
    return sources.where(ok & (F.col("provider") == provider) if provider else ok)


def without_misses(wanted: DataFrame, misses: DataFrame, now, hours: float = 72) -> DataFrame:
    """What is worth fetching: not missed at this provider within the last hours."""
    fresh = misses.where((F.unix_timestamp(F.lit(now)) - F.unix_timestamp("at")) < hours * 3600)
    return wanted.join(fresh.select("ticker", "provider"), ["ticker", "provider"], "left_anti")


def constituents(holdings: DataFrame, static: DataFrame, historical: DataFrame, limit: int = 25, least: int = 8) -> DataFrame:
    """parent, members: the heaviest holdings with clean symbols, or the static list if there are too few; then historical members that aren't in it yet."""
    h = holdings.withColumn("symbol", F.regexp_replace(F.upper("symbol"), r"\.", "-")).withColumn("_n", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("weight"), "symbol"))).where(F.col("_n") <= limit)
    h = h.where(F.col("symbol").rlike("^[A-Z-]+$")).groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("_n", "symbol"))).alias("a")).select("parent", F.col("a.symbol").alias("live"))
    j = static.join(h, "parent", "left").join(historical, "parent", "left")
    live = F.when(F.size("live") >= least, F.col("live")).otherwise(F.col("members"))
    return j.select("parent", F.array_distinct(F.concat(live, F.coalesce("former", F.array().cast("array<string>")))).alias("members"))


def parse_macro_csv(lines: DataFrame, series: str) -> DataFrame:
    """Observations from CSV text in a column value: a date, then a number; '.' is missing; other lines don't count."""
    return lines.select(F.lit(series).alias("series_id"), F.expr("try_cast(trim(split(value, ',')[0]) AS date)").alias("obs_date"), F.expr("try_cast(trim(get(split(value, ','), 1)) AS double)").alias("value")).where("obs_date is not null and value is not null")


def parse_macro_json(payloads: DataFrame, series: str) -> DataFrame:
    """Observations from a JSON payload {"observations": [{"date", "value"}]} in a column value."""
    o = F.from_json("value", "observations array<struct<date string, value string>>")
    e = payloads.select(F.explode(o["observations"]).alias("o"))
    return e.select(F.lit(series).alias("series_id"), F.expr("try_cast(o.date AS date)").alias("obs_date"), F.expr("try_cast(o.value AS double)").alias("value")).where("obs_date is not null and value is not null")


def parse_cell(c: str = "cell"):
    """The number in a display cell (signs, currency, K M B, percent, dates, lights), or null."""
    t = F.regexp_replace(F.trim(c), "[−–]", "-")
    lights = F.length(F.regexp_replace(F.col(c), "[^●]", ""))
    number = F.regexp_extract(F.regexp_replace(t, "[,$+%σx ]", ""), r"^(-?[0-9]*\.?[0-9]+)[KMB]?$", 1)
    unit = F.when(t.rlike("K$"), 1e3).when(t.rlike("M$"), 1e6).when(t.rlike("B$"), 1e9).otherwise(1.0)
    date = F.regexp_replace(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})$", 1), "-", "")
    return F.when(date != "", date.cast("double")).when(F.col(c).rlike("^[●○]+$"), lights.cast("double")).when(number != "", number.cast("double") * unit)


def integrity(bars: DataFrame) -> DataFrame:
    """Counts of what is wrong with each ticker's bars. Volume rules run over its non-zero volumes: shifts of the 20-session median against
    the one 20 before (over 120 of them), and spikes beyond 30 times the trailing median (over 250). A shift is split-like if the day's
    price ratio is within a quarter of the inverse. Calendar gaps count from 61 bars on."""
    b = bars.withColumns({"_r": ratio("close", lag("close")), "_gap": F.date_diff("session", lag("session")), "_same": F.col("close") == lag("close")})
    there = Window.partitionBy("ticker", F.coalesce(F.col("volume") != 0, F.lit(False))).orderBy("session")
    middle = lambda n, least: F.when(F.count("volume").over(there.rowsBetween(1 - n, 0)) >= least, F.percentile("volume", F.lit(0.5)).over(there.rowsBetween(1 - n, 0)))
    b = b.withColumns({"_m20": middle(20, 20), "_m250": middle(250, 100), "_r_there": F.when(F.col("volume") != 0, ratio("close", F.lag("close").over(there)))})
    b = b.withColumn("_vr", F.when(F.col("volume") != 0, ratio("_m20", F.lag("_m20", 20).over(there))))
    shift = (F.col("_vr") > 2.5) | (F.col("_vr") < 0.4)
    inverse = 1 / F.nullif(F.col("_vr"), F.lit(0.0))
    split = shift & (F.col("_r_there") > 0) & (F.abs(F.col("_r_there") - inverse) < 0.25 * F.greatest("_r_there", inverse))
    n = lambda c, name: F.sum(flag(c)).alias(name)
    g = b.groupBy("ticker").agg(
        F.count("*").alias("bars"), n(F.col("volume") != 0, "_v"), n(F.col("high") < F.col("low"), "high_below_low"), n((F.col("close") < 0.999 * F.col("low")) | (F.col("close") > 1.001 * F.col("high")), "close_outside"),
        n(F.col("volume") <= 0, "no_volume"), n(split, "split_like"), n(shift, "volume_shifts"), n(F.col("volume") > 30 * F.col("_m250"), "volume_spikes"), n(F.abs(F.col("_r") - 1) > 0.35, "jumps"),
        n(F.col("_gap") > 10, "gaps"), n(F.col("_same"), "unchanged"),
    )
    enough = lambda c, k, of: F.when(F.col(of) > k, F.col(c)).otherwise(0.0).alias(c)
    # shifts without a split are told of beyond 20
    shifts = F.when((F.col("_v") > 120) & (F.col("split_like") == 0) & (F.col("volume_shifts") > 20), F.col("volume_shifts")).otherwise(0.0)
    return g.select("ticker", "bars", "high_below_low", "close_outside", "no_volume", enough("split_like", 120, "_v"), shifts.alias("volume_shifts"), enough("volume_spikes", 250, "_v"), "jumps", enough("gaps", 60, "bars"), (F.col("unchanged") > 0.10 * F.col("bars")).alias("stale"))


def compare_providers(a: DataFrame, b: DataFrame, least: int = 60) -> DataFrame:
    """By ticker, on shared sessions (60 at least): how far closes and volumes of two sources lie apart."""
    j = a.select("ticker", "session", F.col("close").alias("ca"), F.col("volume").alias("va")).join(b.select("ticker", "session", F.col("close").alias("cb"), F.col("volume").alias("vb")), ["ticker", "session"])
    j = j.withColumns({"_d": F.abs(F.col("ca") / F.nullif("cb", F.lit(0.0)) - 1) * 100, "_v": F.col("va") / F.nullif("vb", F.lit(0.0))})
    g = j.groupBy("ticker").agg(F.count("*").alias("shared"), F.percentile("_d", F.lit(0.5)).alias("median_dev"), F.max("_d").alias("max_dev"), F.sum(flag(F.col("_d") > 1)).alias("days_over_1"), F.percentile("_v", F.lit(0.5)).alias("volume_ratio"), F.sum(flag((F.col("_v") > 2) | (F.col("_v") < 0.5))).alias("days_over_2x"))
    return g.where(F.col("shared") >= least)


def provenance(sources: DataFrame) -> DataFrame:
    """Series by provider, and whether more than one provider is in use."""
    g = sources.groupBy("provider").agg(F.count("*").alias("series"), F.sum("rows").alias("rows"))
    return g.withColumn("mixed", F.count("*").over(Window.partitionBy(F.lit(1))) > 1)
