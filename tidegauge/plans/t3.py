"""Queries over trades, macro series, and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import average_rank, lag, ratio, tidy
from ..operators import flow as FL
from ..operators import indicators as I
from ..operators import quality as Q
from ..sources import views as V
from ..sources.views import with_sql
from .t1 import lg, over, ra, rd

QUERIES: dict = {}
ORACLES: dict = {}
#: Block thresholds that fit these trades' sizes.
BLOCKS = {"block_size": 9000, "block_notional": 500_000}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _show(df: DataFrame, *names: str, keep: tuple) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*keep, *[tidy(n).alias(n) if kinds[n] == "double" else F.col(n) for n in names])


DAILY = [
    "trades",
    ("d0", "SELECT *, size * price AS n, coalesce(sign(price - lag(price) OVER (PARTITION BY ticker, day ORDER BY ts, event_id)), 0) AS dir, exchange = 4 AS off, exchange = 4 AND trf_id IS NOT NULL AS dark, size >= 9000 OR size * price >= 500000 AS block FROM trades WHERE size > 0 AND price > 0"),
    ("d1", "SELECT ticker, day, sum(size) AS volume, count(*) AS trades, sum(n) AS notional, sum(CASE WHEN off THEN size ELSE 0 END) AS off_volume, sum(CASE WHEN dark THEN size ELSE 0 END) AS dark_volume, sum(block::INT)::BIGINT AS block_count, sum(CASE WHEN block THEN size ELSE 0 END) AS block_volume, sum(CASE WHEN block AND off THEN size ELSE 0 END) AS block_off, sum(CASE WHEN block AND dir > 0 THEN size ELSE 0 END) AS up, sum(CASE WHEN block AND dir < 0 THEN size ELSE 0 END) AS dn, max(size) AS largest_print, max(n) AS largest_notional FROM d0 GROUP BY ALL"),
    ("daily", "SELECT *, notional / nullif(volume, 0) AS vwap, off_volume / nullif(volume, 0) AS off_share, dark_volume / nullif(volume, 0) AS dark_share, block_volume / nullif(volume, 0) AS block_share, block_off / nullif(block_volume, 0) AS block_off_share, (up - dn) / nullif(up + dn, 0) AS block_direction, abs(dark_volume - off_volume) <= greatest(1, off_volume * 1e-6) AS dark_equals_off, trades >= 50 AS truncated FROM d1"),
]


def daily(s, d) -> DataFrame:
    return FL.session_flow(V.trades(s, d), **BLOCKS, page_cap=50)


_D = ("volume", "vwap", "off_share", "dark_share", "block_share", "block_off_share", "block_direction", "largest_print", "largest_notional")


@register("flow_daily", with_sql(*DAILY) + " SELECT ticker, day, trades, block_count, dark_equals_off, truncated, " + ", ".join(rd(c) for c in _D) + " FROM daily")
def flow_daily(s, d):
    return _show(daily(s, d), *_D, keep=("ticker", "day", "trades", "block_count", "dark_equals_off", "truncated"))


def _m(c: str) -> str:
    return f"max_by({c}, day) AS {c}_latest, avg({c}) AS {c}_mean, avg({c}) FILTER (back <= 3) - avg({c}) FILTER (back > 3) AS {c}_trend"


MULTI = [
    *DAILY,
    ("m0", "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day DESC) AS back FROM daily"),
    ("multi", f"SELECT ticker, count(*) AS sessions, max(largest_print) AS largest_print, max(largest_notional) AS largest_notional, max_by(block_count, day) AS block_count_latest, avg(block_count) AS block_count_mean, avg(notional) AS adv, sum(truncated::INT)::BIGINT AS truncated_days, bool_and(dark_equals_off) AS dark_equals_off, avg(block_direction) AS block_direction, max(day) AS day, {_m('off_share')}, {_m('dark_share')}, {_m('block_share')} FROM m0 WHERE back <= 20 GROUP BY ticker HAVING count(*) >= 3"),
]
_M = ("largest_print", "largest_notional", "block_count_mean", "adv", "block_direction", *[f"{c}_{k}" for c in ("off_share", "dark_share", "block_share") for k in ("latest", "mean", "trend")])


@register("flow_multi", with_sql(*MULTI) + " SELECT ticker, sessions, truncated_days, dark_equals_off, day, block_count_latest, " + ", ".join(rd(c) for c in _M) + " FROM multi")
def flow_multi(s, d):
    return _show(FL.multi_session(daily(s, d)), *_M, keep=("ticker", "sessions", "truncated_days", "dark_equals_off", "day", "block_count_latest"))


def _c(x: str, k: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(-1, least(1, {k} * {x})) END"


def _blend(parts) -> str:
    return "(" + " + ".join(f"coalesce({w} * ({p}), 0)" for w, p in parts) + ") / nullif(" + " + ".join(f"CASE WHEN ({p}) IS NOT NULL THEN {w} ELSE 0 END" for w, p in parts) + ", 0)"


_REST = [(0.25, _c("block_direction", 2)), (0.15, _c("block_share_trend", 20))]
_SCORE = f"CASE WHEN dark_equals_off THEN {_blend([(0.6, _c('off_share_trend', 25)), *_REST])} ELSE {_blend([(0.25, _c('off_share_trend', 25)), (0.35, _c('dark_share_trend', 30)), *_REST])} END"


@register("flow_score", with_sql(*MULTI) + f" SELECT ticker, {rd(_SCORE, 'flow_score')} FROM multi")
def flow_score(s, d):
    return FL.multi_session(daily(s, d)).select("ticker", tidy(FL.flow_score()).alias("flow_score"))


@register("block_buckets", with_sql(*MULTI, ("bk", "SELECT *, block_share_latest / nullif(block_share_mean, 0) AS surprise, block_count_latest / nullif(block_count_mean, 0) AS count_surprise FROM multi")) + f" SELECT ticker, {rd('surprise')}, {rd('count_surprise')}, array_to_string(list_filter([CASE WHEN block_share_latest >= 0.2 AND (surprise IS NULL OR surprise < 1.5) AND (block_direction IS NULL OR block_direction > -0.25) THEN 'Safe Bets' END, CASE WHEN surprise >= 1.5 OR count_surprise >= 2 THEN 'Most Unusual' END, CASE WHEN largest_notional >= 50e6 THEN 'Top Positions' END, CASE WHEN abs(block_direction) >= 0.3 AND block_share_latest >= 0.15 AND adv <= 2e8 THEN 'Longshots' END], lambda x: x IS NOT NULL), ',') AS buckets FROM bk")
def block_buckets(s, d):
    m = FL.block_buckets(FL.multi_session(daily(s, d)))
    return m.select("ticker", tidy("surprise").alias("surprise"), tidy("count_surprise").alias("count_surprise"), F.array_join("buckets", ",").alias("buckets"))


_P = ("off_share", "dark_share", "block_share", "block_direction")
PANEL = [*DAILY, ("pn", "SELECT *, " + ", ".join(f"avg({c}) OVER w AS prior_{c}" for c in _P) + ", count(*) OVER w AS prior_n FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")]


@register("flow_panel", with_sql(*PANEL) + " SELECT ticker, day, prior_n, " + ", ".join(rd(f"prior_{c}") for c in _P) + " FROM pn WHERE prior_n >= 5")
def flow_panel(s, d):
    return _show(FL.flow_panel(daily(s, d)), *[f"prior_{c}" for c in _P], keep=("ticker", "day", "prior_n"))


_AR = "rank() OVER (PARTITION BY day ORDER BY {x}) + (count(*) OVER (PARTITION BY day, {x}) - 1) / 2.0"


@register("flow_ic", with_sql(*PANEL, ("p0", "SELECT *, lead(vwap) OVER (PARTITION BY ticker ORDER BY day) / vwap - 1 AS fwd FROM pn"), ("p1", f"SELECT *, {_AR.format(x='prior_off_share')} AS rx, {_AR.format(x='fwd')} AS ry FROM p0 WHERE prior_n >= 5 AND fwd IS NOT NULL AND prior_off_share IS NOT NULL"), ("p2", "SELECT day, corr(rx, ry) AS ic FROM p1 GROUP BY day HAVING count(*) >= 5")) + f" SELECT {rd('avg(ic)', 'mean_ic')}, count(ic) AS days, {rd('avg(CASE WHEN round(ic, 9) > 0 THEN 1.0 ELSE 0 END)', 'share_positive')} FROM p2")
def flow_ic(s, d):
    """Rank correlation of prior off-exchange share with the next day's return of the average price."""
    from pyspark.sql import Window

    f = daily(s, d)
    f = FL.flow_panel(f.withColumn("fwd", F.lead("vwap").over(Window.partitionBy("ticker").orderBy("day")) / F.col("vwap") - 1)).where("fwd is not null and prior_off_share is not null")
    f = f.withColumns({"rx": average_rank("prior_off_share", "day"), "ry": average_rank("fwd", "day")})
    g = f.groupBy("day").agg(F.corr("rx", "ry").alias("ic"), F.count("*").alias("n")).where("n >= 5")
    return g.agg(tidy(F.avg("ic")).alias("mean_ic"), F.count("ic").alias("days"), tidy(F.avg(F.when(F.round("ic", 9) > 0, 1.0).otherwise(0.0))).alias("share_positive"))


@register("legacy_off_share", with_sql("trades", ("o0", "SELECT ticker, day, sum(CASE WHEN exchange = 4 THEN size ELSE 0 END) / sum(size) AS share FROM trades WHERE size > 0 GROUP BY ALL"), ("o1", "SELECT *, max(day) OVER (PARTITION BY ticker) AS last FROM o0")) + f" SELECT ticker, {rd('max(share) FILTER (day = last) - avg(share) FILTER (day < last)', 'off_change')} FROM o1 GROUP BY ticker")
def legacy_off_share(s, d):
    return FL.legacy_off_share(V.trades(s, d)).select("ticker", tidy("off_change").alias("off_change"))


MACRO = [
    "macro",
    ("e", "SELECT *, max(obs_date) OVER (PARTITION BY series_id) AS fin FROM macro WHERE value IS NOT NULL"),
    ("la", "SELECT series_id, count(*) AS n, max(obs_date) AS last_date, max_by(value, obs_date) AS last, max_by(value, obs_date) FILTER (obs_date <= fin - 91) AS prev FROM e GROUP BY series_id"),
    ("re", "SELECT *, count(*) OVER (PARTITION BY series_id) AS k, row_number() OVER (PARTITION BY series_id ORDER BY obs_date) AS i FROM e WHERE obs_date >= fin - 1092"),
    ("df", "SELECT a.series_id, avg(a.value - b.value) AS m, stddev_pop(a.value - b.value) AS sd, count(*) AS nd, max(a.k) AS look FROM re a JOIN re b ON a.series_id = b.series_id AND a.i = b.i + greatest(1, a.k * 13 // 156) GROUP BY ALL"),
    ("mt", "SELECT la.*, last - prev AS change, CASE WHEN n >= 10 AND look > 20 AND nd > 5 THEN (last - prev - m) / nullif(sd, 0) END AS z FROM la LEFT JOIN df USING (series_id)"),
]


@register("macro_trend", with_sql(*MACRO) + f" SELECT series_id, last_date, {rd('last', digits=2)}, {rd('change', digits=2)}, {rd('change / abs(nullif(prev, 0)) * 100', 'change_pct')}, {rd('z')} FROM mt")
def macro_trend(s, d):
    t = FL.macro_trend(V.macro(s, d))
    return t.select("series_id", "last_date", tidy("last", 2).alias("last"), tidy("change", 2).alias("change"), tidy("change_pct").alias("change_pct"), tidy("z").alias("z"))


#: Stand-ins for the four weighted series, with the same weights and directions.
LIQUIDITY = {"AFRICA": (0.40, 1), "AMERICA": (0.25, -1), "ASIA": (0.15, -1), "EUROPE": (0.20, -1)}
_LV = ", ".join(f"('{n}', {w}, {k})" for n, (w, k) in LIQUIDITY.items())


@register("liquidity", with_sql(*MACRO, ("w", f"SELECT * FROM (VALUES {_LV}) t(series_id, w, k)"), ("li", "SELECT sum(w * k * z) / sum(w) AS impulse, count(*) AS n_series FROM mt JOIN w USING (series_id) WHERE z IS NOT NULL")) + f" SELECT {rd('impulse')}, n_series, CASE WHEN impulse > 0.5 THEN 'EXPANDING' WHEN impulse > -0.5 THEN 'NEUTRAL' WHEN impulse IS NOT NULL THEN 'DRAINING' END AS regime FROM li")
def liquidity(s, d):
    return FL.liquidity(FL.macro_trend(V.macro(s, d)), LIQUIDITY).select(tidy("impulse").alias("impulse"), "n_series", "regime")


def _raw(s, d) -> DataFrame:
    l = V.read(s, d, "lineitem")
    return l.select(F.col("l_returnflag").alias("ticker"), F.col("l_shipdate").cast("date").alias("session"), *[F.col("l_extendedprice").cast("string").alias(c) for c in ("open", "high", "low")], F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice").cast("string")).otherwise("n/a").alias("close"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("string")).alias("volume"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"))


@register("normalise_bars", "WITH r AS (SELECT l_returnflag AS ticker, l_shipdate::DATE AS session, l_extendedprice AS p, CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS close, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS volume, row_number() OVER (PARTITION BY l_returnflag, l_shipdate::DATE ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS n FROM lineitem) SELECT ticker, session, p AS open, p AS high, p AS low, close, coalesce(volume, 0) AS volume FROM r WHERE n = 1 AND close IS NOT NULL")
def normalise_bars(s, d):
    return Q.normalise_bars(_raw(s, d))


@register("adjusted_bars", "SELECT o_orderpriority AS ticker, o_orderdate::DATE AS session, round(o_totalprice * 0.9, 4) + 0.0 AS close, o_custkey::DOUBLE AS volume FROM orders")
def adjusted_bars(s, d):
    o = V.read(s, d, "orders")
    arr = lambda c: F.array(c.cast("double") if not isinstance(c, str) else F.col(c))
    p = F.col("o_totalprice")
    raw = o.select(F.col("o_orderpriority").alias("ticker"), F.array(F.unix_seconds(F.col("o_orderdate").cast("date").cast("timestamp"))).alias("t"), arr(p).alias("o"), arr(p).alias("h"), arr(p).alias("l"), arr(p).alias("c"), arr(F.col("o_custkey")).alias("v"), arr(p * 0.9).alias("adj"))
    return Q.adjusted(raw).select("ticker", "session", tidy("close", 4).alias("close"), "volume")


@register("member_union", "WITH h AS (SELECT n_regionkey AS parent, n_name AS symbol, n_nationkey AS weight FROM nation), k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY weight DESC, symbol) AS i FROM h), l AS (SELECT parent, list(symbol ORDER BY i) AS live FROM k WHERE i <= 25 AND regexp_matches(symbol, '^[A-Z-]+$') GROUP BY parent) SELECT r_name AS parent, array_to_string(CASE WHEN len(live) >= 4 THEN live ELSE ['STATIC'] END, ',') || ',GONE' AS members FROM region LEFT JOIN l ON r_regionkey = parent")
def member_union(s, d):
    n, r = V.read(s, d, "nation"), V.read(s, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("parent"))
    h = n.join(r, "n_regionkey").select("parent", F.col("n_name").alias("symbol"), F.col("n_nationkey").alias("weight"))
    names = r.select("parent")
    m = Q.constituents(h, names.withColumn("members", F.array(F.lit("STATIC"))), names.withColumn("former", F.array(F.lit("GONE"))), least=4)
    return m.select("parent", F.array_join("members", ",").alias("members"))


@register("miss_antijoin", "SELECT c_custkey AS ticker FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate > TIMESTAMP '1998-07-01' - INTERVAL 720 HOUR)")
def miss_antijoin(s, d):
    want = V.read(s, d, "customer").select(F.col("c_custkey").alias("ticker"), F.lit("p").alias("provider"))
    miss = V.read(s, d, "orders").select(F.col("o_custkey").alias("ticker"), F.lit("p").alias("provider"), F.col("o_orderdate").cast("timestamp").alias("at"))
    now = F.to_timestamp(F.lit("1998-07-01 00:00:00"))
    return Q.without_misses(want, miss, now, 720).select("ticker")


@register("source_choice", "WITH c AS (SELECT o_custkey AS ticker, o_orderpriority AS provider, count(*) AS rows FROM orders GROUP BY ALL), o AS (SELECT *, rows > 3 AS ok, CASE provider WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS k FROM c) SELECT ticker, provider, rows, CASE WHEN ok THEN 'ok' ELSE 'stale' END AS state FROM o QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ok DESC, CASE WHEN ok THEN k ELSE 0 END, rows DESC, provider) = 1")
def source_choice(s, d):
    c = V.read(s, d, "orders").groupBy(F.col("o_custkey").alias("ticker"), F.col("o_orderpriority").alias("provider")).agg(F.count("*").alias("rows")).withColumn("fetched", F.lit(True))
    return Q.pick_source(c, {"1-URGENT": 0, "2-HIGH": 1}, least_fetched=3)


_IN = [
    "lots", "bars_t1",
    ("i0", f"SELECT *, close / nullif({lg('close')}, 0) AS r, session - {lg('session')} AS gap, close = {lg('close')} AS same FROM bars_t1"),
    ("i1", f"SELECT ticker, session, close / nullif({lg('close')}, 0) AS rt, {ra('median', 'volume', 20, 20)} AS m20, {ra('median', 'volume', 250, 100)} AS m250 FROM bars_t1 WHERE volume <> 0"),
    ("i2", f"SELECT *, m20 / nullif({lg('m20', 20)}, 0) AS vr FROM i1"),
    ("i3", "SELECT i0.*, vr, rt, m250, vr > 2.5 OR vr < 0.4 AS shift FROM i0 LEFT JOIN i2 USING (ticker, session)"),
]


def _n(cond: str, name: str) -> str:
    return f"sum(CASE WHEN {cond} THEN 1.0 ELSE 0 END)::DOUBLE AS {name}"


@register("integrity", with_sql(*_IN, ("i4", f"SELECT ticker, count(*) AS bars, count(*) FILTER (volume <> 0) AS v, {_n('high < low', 'high_below_low')}, {_n('close < 0.999 * low OR close > 1.001 * high', 'close_outside')}, {_n('volume <= 0', 'no_volume')}, {_n('shift AND rt > 0 AND abs(rt - 1 / vr) < 0.25 * greatest(rt, 1 / vr)', 'splits')}, {_n('shift', 'shifts')}, {_n('volume > 30 * m250', 'spikes')}, {_n('abs(r - 1) > 0.35', 'jumps')}, {_n('gap > 10', 'g')}, {_n('same', 'unchanged')} FROM i3 GROUP BY ticker")) + " SELECT ticker, bars, high_below_low, close_outside, no_volume, CASE WHEN v > 120 THEN splits ELSE 0 END AS split_like, CASE WHEN v > 120 AND splits = 0 AND shifts > 20 THEN shifts ELSE 0 END AS volume_shifts, CASE WHEN v > 250 THEN spikes ELSE 0 END AS volume_spikes, jumps, CASE WHEN bars > 60 THEN g ELSE 0 END AS gaps, unchanged > 0.10 * bars AS stale FROM i4")
def integrity(s, d):
    return Q.integrity(V.bars_t1(s, d))


@register("provider_compare", with_sql("lots", "bars_t1", ("b2", "SELECT ticker, session, avg(price) AS close, sum(CASE WHEN l_linenumber < 5 THEN quantity ELSE 0 END) AS volume FROM (SELECT p_type AS ticker, * FROM lots) GROUP BY ALL"), ("j", "SELECT ticker, abs(a.close / nullif(b.close, 0) - 1) * 100 AS d, a.volume / nullif(b.volume, 0) AS v FROM bars_t1 a JOIN b2 b USING (ticker, session)")) + f" SELECT ticker, count(*) AS shared, {rd('median(d)', 'median_dev')}, {rd('max(d)', 'max_dev')}, {_n('d > 1', 'days_over_1')}, {rd('median(v)', 'volume_ratio')}, {_n('v > 2 OR v < 0.5', 'days_over_2x')} FROM j GROUP BY ticker HAVING count(*) >= 60")
def provider_compare(s, d):
    other = V.ticks(s, d).groupBy(F.col("p_type").alias("ticker"), "session").agg(F.avg("price").alias("close"), F.sum(F.when(F.col("l_linenumber") < 5, F.col("quantity")).otherwise(0.0)).alias("volume"))
    return _show(Q.compare_providers(V.bars_t1(s, d), other), "median_dev", "max_dev", "days_over_1", "volume_ratio", "days_over_2x", keep=("ticker", "shared"))


@register("provenance", "WITH g AS (SELECT o_orderpriority AS provider, count(*) AS series, sum(o_custkey)::BIGINT AS rows FROM orders GROUP BY ALL) SELECT *, (SELECT count(*) FROM g) > 1 AS mixed FROM g")
def provenance(s, d):
    return Q.provenance(V.read(s, d, "orders").select(F.col("o_orderpriority").alias("provider"), F.col("o_custkey").alias("rows")))


@register("macro_csv", "SELECT 'S' AS series_id, o_orderdate::DATE AS obs_date, round(o_totalprice, 2) + 0.0 AS value FROM orders WHERE o_orderstatus <> 'P'")
def macro_csv(s, d):
    o = V.read(s, d, "orders")
    text = F.concat(F.date_format(F.col("o_orderdate"), "yyyy-MM-dd"), F.lit(","), F.when(F.col("o_orderstatus") == "P", ".").otherwise(F.col("o_totalprice").cast("string")))
    return Q.parse_macro_csv(o.select(text.alias("value")), "S").withColumn("value", tidy("value", 2))


@register("macro_json", "SELECT 'S' AS series_id, o_orderdate::DATE AS obs_date, round(o_totalprice, 2) + 0.0 AS value FROM orders WHERE o_orderstatus <> 'P'")
def macro_json(s, d):
    o = V.read(s, d, "orders")
    item = F.struct(F.date_format(F.col("o_orderdate"), "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderstatus") == "P", ".").otherwise(F.col("o_totalprice").cast("string")).alias("value"))
    text = F.to_json(F.struct(F.collect_list(item).alias("observations")))
    return Q.parse_macro_json(o.groupBy("o_custkey").agg(text.alias("value")), "S").withColumn("value", tidy("value", 2))


_RECORDS = "WITH r AS (SELECT o_custkey AS ticker, o_orderdate::DATE AS session, o_totalprice AS p, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS close, CASE WHEN o_orderpriority <> '2-HIGH' THEN o_orderkey END AS volume, row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderkey DESC) AS n FROM orders) SELECT ticker, session, p AS open, p AS high, p AS low, close, coalesce(volume, 0)::DOUBLE AS volume FROM r WHERE n = 1 AND close IS NOT NULL"


def _payloads(s, d, names, day):
    o = V.read(s, d, "orders")
    price, close, volume = F.col("o_totalprice"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")), F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_orderkey"))
    record = F.struct("o_orderkey", *[c.alias(n) for n, c in zip(names, (day, price, price, price, close, volume), strict=True)])
    return o.groupBy(F.col("o_custkey").alias("ticker")).agg(F.sort_array(F.collect_list(record)).alias("a"))


@register("history_json", _RECORDS)
def history_json(s, d):
    p = _payloads(s, d, ("date", "open", "high", "low", "close", "volume"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    value = F.when(F.col("ticker") % 2 == 0, F.to_json("a")).otherwise(F.to_json(F.struct(F.col("a").alias("historical"))))
    return Q.normalise_bars(Q.history_records(p.select("ticker", value.alias("value"))))


@register("aggregates_json", _RECORDS)
def aggregates_json(s, d):
    p = _payloads(s, d, ("t", "o", "h", "l", "c", "v"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000)
    return Q.normalise_bars(Q.aggregate_records(p.select("ticker", F.to_json(F.struct(F.col("a").alias("results"))).alias("value"))))


@register("still_to_fetch", with_sql("lots", "bars_t1", ("w", "SELECT ticker, session, row_number() OVER (PARTITION BY ticker ORDER BY session DESC) AS n FROM bars_t1 WHERE session < DATE '1997-01-01'")) + " SELECT ticker, session FROM w WHERE n > 63 AND n <= 189 AND NOT EXISTS (SELECT 1 FROM bars_t1 b WHERE b.ticker = w.ticker AND b.session = w.session AND b.volume > 30)")
def still_to_fetch(s, d):
    b = V.bars_t1(s, d)
    return Q.still_to_fetch(b, b.where("volume > 30"), F.lit("1997-01-01").cast("date"), 126, 63)


@register("off_exchange_venues", with_sql("trades") + " SELECT ticker, day, sum(size) AS volume, sum(CASE WHEN exchange IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 OR n_nationkey = 11) THEN size ELSE 0 END) AS off_volume FROM trades WHERE size > 0 AND price > 0 GROUP BY ALL")
def off_exchange_venues(s, d):
    n = V.read(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.when((F.col("n_regionkey") == 1) | (F.col("n_nationkey") == 11), "trf").otherwise("exchange").alias("type"))
    return FL.off_exchange_volume(V.trades(s, d), n)


@register("sign_run", with_sql("lots", "bars_t1", ("x", "SELECT ticker, session, close / nullif(lag(close, 21) OVER (PARTITION BY ticker ORDER BY session), 0) - 1 AS r FROM bars_t1"), ("y", "SELECT ticker, session, r >= 0 AS positive FROM x WHERE r IS NOT NULL"), ("z", "SELECT ticker, arg_max(positive, session) AS positive FROM y GROUP BY ticker")) + " SELECT z.ticker, z.positive, count(*) AS sessions FROM z JOIN y USING (ticker) WHERE NOT EXISTS (SELECT 1 FROM y o WHERE o.ticker = z.ticker AND o.positive <> z.positive AND o.session >= y.session) GROUP BY ALL")
def sign_run(s, d):
    return I.sign_run(V.bars_t1(s, d).withColumn("r", ratio("close", lag("close", 21)) - 1), "r")


@register("curve_note", with_sql("macro", ("l", "SELECT series_id, arg_max(value, obs_date) / 1e5 - 50 AS value FROM macro GROUP BY ALL")) + f" SELECT series_id, {rd('value', 'value')}, CASE WHEN value < 0 THEN 'inverted' WHEN value > 0.5 THEN 'steepening' ELSE 'flat' END AS note FROM l")
def curve_note(s, d):
    m = V.macro(s, d).groupBy("series_id").agg((F.max_by("value", "obs_date") / 1e5 - 50).alias("value"))
    return _show(m.withColumn("note", FL.curve_note()), "value", keep=("series_id", "note"))
