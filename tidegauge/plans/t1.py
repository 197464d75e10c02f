"""Queries over per-instrument indicators, with SQL that states the same by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rolling import tidy
from ..operators import indicators as I
from ..sources import views as V
from ..sources.views import with_sql

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def over(n: int, skip: int = 0, key: str = "ticker") -> str:
    end = f"{skip} PRECEDING" if skip else "CURRENT ROW"
    return f"OVER (PARTITION BY {key} ORDER BY session ROWS BETWEEN {n - 1 + skip} PRECEDING AND {end})"


def ra(f: str, x: str, n: int, least: int, skip: int = 0) -> str:
    return f"CASE WHEN count({x}) {over(n, skip)} >= {least} THEN {f}({x}) {over(n, skip)} END"


def zs(x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} >= {least} THEN ({x} - avg({x}) {over(n)}) / nullif(stddev_pop({x}) {over(n)}, 0) END"


def lg(x: str, k: int = 1, f: str = "lag") -> str:
    return f"{f}({x}, {k}) OVER (PARTITION BY ticker ORDER BY session)"


ROW = "row_number() OVER (PARTITION BY ticker ORDER BY session)"
BACK = "row_number() OVER (PARTITION BY ticker ORDER BY session DESC)"


def rd(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name or x}"


def shown(df: DataFrame, *names: str, keep: tuple = ("ticker", "session")) -> DataFrame:
    """These columns, doubles rounded, without the rows where all of them are null."""
    kinds = dict(df.dtypes)
    return df.where(" or ".join(f"{n} is not null" for n in names)).select(*keep, *[tidy(n).alias(n) if kinds[n] == "double" else F.col(n) for n in names])


# fragments that several oracles share: (name, SQL)
RS = ("rs0", "SELECT b.*, m.close AS bench_close, b.close / nullif(m.close, 0) AS q FROM bars_t1 b JOIN bars_bench m USING (session) WHERE b.close IS NOT NULL AND m.close IS NOT NULL")
RS1 = ("rs1", "SELECT *, q / first_value(q) OVER (PARTITION BY ticker ORDER BY session) * 100 AS rs FROM rs0")
MRS = ("mrs", f"SELECT *, (rs / nullif({ra('avg', 'rs', 200, 50)}, 0) - 1) * 100 AS mansfield_rs FROM rs1")
RS_ALL = [x for x in ("lots", "bars_t1", "bars_bench", RS, RS1, MRS)]
T1 = ("lots", "bars_t1")
R1 = ("r1", f"SELECT *, close / nullif({lg('close')}, 0) - 1 AS r, {lg('volume')} AS v1 FROM bars_t1")
VT = ("vt", "SELECT *, (" + ra("median", "nullif(volume, 0)", 20, 10) + ") / nullif(" + ra("median", "nullif(volume, 0)", 60, 30, 20) + ", 0) AS vt0 FROM bars_t1")
VT1 = ("vt1", "SELECT *, (vt0 - 1) * 100 AS volume_trend FROM vt")


def rs_frame(s: SparkSession, d: str) -> DataFrame:
    return I.relative_strength(V.bars_t1(s, d), V.bars_bench(s, d))


@register("mansfield_rs", with_sql(*RS_ALL) + f" SELECT ticker, session, {rd('mansfield_rs')}, rank() OVER (ORDER BY round(mansfield_rs, 6) DESC) AS place FROM (SELECT *, {BACK} AS n FROM mrs WHERE mansfield_rs IS NOT NULL) WHERE n = 1")
def mansfield_rs(s, d):
    m = I.mansfield(rs_frame(s, d)).where("mansfield_rs is not null")
    last = m.groupBy("ticker").agg(F.max("session").alias("session"), F.max_by("mansfield_rs", "session").alias("m"))
    # one row a ticker by now
    from pyspark.sql import Window

    return last.select("ticker", "session", tidy("m").alias("mansfield_rs")).withColumn("place", F.rank().over(Window.orderBy(F.desc("mansfield_rs"))))


@register("mansfield_series", with_sql(*RS_ALL) + f" SELECT ticker, session, {rd('rs')}, {rd('mansfield_rs')} FROM mrs")
def mansfield_series(s, d):
    return shown(I.mansfield(rs_frame(s, d)), "rs", "mansfield_rs")


RRG = [
    *RS_ALL,
    ("rr0", f"SELECT *, {ROW} AS n_bars, 100 * ({ra('avg', 'rs', 10, 10)}) / nullif({ra('avg', 'rs', 40, 40)}, 0) AS qq FROM rs1"),
    ("rr", f"SELECT *, CASE WHEN n_bars >= 60 THEN qq END AS rs_ratio_raw, CASE WHEN n_bars >= 60 THEN 100 * qq / nullif({ra('avg', 'qq', 10, 10)}, 0) END AS rs_mom_raw FROM rr0"),
]


@register("rrg_raw", with_sql(*RRG) + f" SELECT ticker, session, {rd('rs_ratio_raw')}, {rd('rs_mom_raw')} FROM rr WHERE rs_ratio_raw IS NOT NULL OR rs_mom_raw IS NOT NULL")
def rrg_raw(s, d):
    return shown(I.rrg_raw(rs_frame(s, d)), "rs_ratio_raw", "rs_mom_raw")


@register("cmf", with_sql(*T1, ("f", "SELECT *, coalesce(((close - low) - (high - close)) / nullif(high - low, 0) * volume, 0) AS mf FROM bars_t1")) + f" SELECT ticker, session, {rd(f'({ra("sum", "mf", 21, 7)}) / nullif({ra("sum", "volume", 21, 7)}, 0)', 'cmf')} FROM f QUALIFY cmf IS NOT NULL")
def cmf(s, d):
    return shown(I.money_flow(V.bars_t1(s, d)), "cmf")


VZ = ("vz", f"SELECT *, {zs('ln(1 + volume)', 60, 20)} AS volume_z, {zs('ln(1 + volume * close)', 60, 20)} AS dollar_volume_z FROM bars_t1")


@register("volume_z", with_sql(*T1, VZ) + f" SELECT ticker, session, {rd('volume_z')} FROM vz WHERE volume_z IS NOT NULL")
def volume_z(s, d):
    return shown(I.volume_z(V.bars_t1(s, d)), "volume_z")


@register("dollar_volume_z", with_sql(*T1, VZ) + f" SELECT ticker, session, {rd('dollar_volume_z')} FROM vz WHERE dollar_volume_z IS NOT NULL")
def dollar_volume_z(s, d):
    return shown(I.volume_z(V.bars_t1(s, d)), "dollar_volume_z")


AD = [("ad0", f"SELECT *, {ra('avg', 'volume', 50, 20)} AS av FROM r1"), ("ad1", "SELECT *, CASE WHEN r > 0.002 AND volume > av THEN 1 ELSE 0 END - CASE WHEN r < -0.002 AND volume > av THEN 1 ELSE 0 END AS s FROM ad0")]


@register("ad_balance", with_sql(*T1, R1, *AD) + f" SELECT ticker, session, {rd(f'({ra("sum", "s", 25, 8)}) / 25.0', 'ad_balance')} FROM ad1 QUALIFY ad_balance IS NOT NULL")
def ad_balance(s, d):
    return shown(I.ad_balance(V.bars_t1(s, d)), "ad_balance")


AB = [VZ, ("ab0", f"SELECT *, close / nullif({lg('close')}, 0) - 1 AS r FROM vz"), ("ab1", "SELECT *, ((close - low) / nullif(high - low, 0) - 0.5) * 2 * CASE WHEN volume_z > 0 THEN volume_z WHEN volume_z IS NOT NULL THEN 0 END / (1 + coalesce(abs(r) / 0.004, 0)) AS x FROM ab0")]


@register("absorption", with_sql(*T1, *AB) + f" SELECT ticker, session, {rd(ra('avg', 'x', 25, 8), 'absorption')} FROM ab1 QUALIFY absorption IS NOT NULL")
def absorption(s, d):
    return shown(I.absorption(V.bars_t1(s, d)), "absorption")


BI = [
    ("bi0", f"SELECT ticker, session, list_reverse_sort(list(volume) {over(25)}) AS l FROM bars_t1"),
    ("bi1", "SELECT ticker, session, CASE WHEN len(l) >= 12 THEN list_sum(l[1 : greatest(3, len(l) // 8)]) / nullif(list_sum(l), 0) - greatest(3, len(l) // 8)::DOUBLE / len(l) END AS block_intensity FROM bi0"),
]


@register("block_intensity", with_sql(*T1, *BI) + f" SELECT ticker, session, {rd('block_intensity')} FROM bi1 WHERE block_intensity IS NOT NULL")
def block_intensity(s, d):
    return shown(I.block_intensity(V.bars_t1(s, d)), "block_intensity")


@register("block_intensity_z", with_sql(*T1, *BI) + f" SELECT ticker, session, {rd(zs('block_intensity', 120, 30), 'block_intensity_z')} FROM bi1 QUALIFY block_intensity_z IS NOT NULL")
def block_intensity_z(s, d):
    return shown(I.block_intensity(V.bars_t1(s, d)), "block_intensity_z")


def _mom(long: int, skip: int) -> str:
    now = lg("close", skip) if skip else "close"
    then = lg("close", long + skip)
    return f"CASE WHEN {ROW} >= {long + skip + 2} AND {then} > 0 THEN ({now} / {then} - 1) * 100 END"


@register("momentum_12_1", with_sql(*T1) + f" SELECT ticker, session, {rd(_mom(252, 21), 'mom_12_1')} FROM bars_t1 QUALIFY mom_12_1 IS NOT NULL")
def momentum_12_1(s, d):
    return shown(I.momentum(V.bars_t1(s, d)), "mom_12_1")


@register("momentum_variants", with_sql(*T1) + f" SELECT ticker, session, {rd(_mom(252, 21), 'mom_12_1')}, {rd(_mom(126, 21), 'mom_6_1')}, {rd(_mom(63, 21), 'mom_3_1')}, {rd(_mom(252, 0), 'mom_12_0')} FROM bars_t1 QUALIFY mom_3_1 IS NOT NULL")
def momentum_variants(s, d):
    return shown(I.momentum_variants(V.bars_t1(s, d)), "mom_12_1", "mom_6_1", "mom_3_1", "mom_12_0")


@register("volume_trend", with_sql(*T1, VT, VT1) + f" SELECT ticker, session, {rd('volume_trend')} FROM vt1 WHERE volume_trend IS NOT NULL")
def volume_trend(s, d):
    return shown(I.volume_trend(V.bars_t1(s, d)), "volume_trend")


RG = [
    VT, VT1,
    ("g0", f"SELECT ticker, session, volume_trend AS x, {ROW} AS readings FROM vt1 WHERE volume_trend IS NOT NULL"),
    ("g1", f"SELECT *, stddev_pop(x) {over(252)} AS sd, avg(x) {over(252)} AS m, list(x) {over(252)} AS l, CASE WHEN x > 15 THEN 'expanding' WHEN x < -10 THEN 'contracting' ELSE 'flat' END AS regime, x - {lg('x', 21)} AS trend_slope FROM g0"),
    ("g2", f"SELECT *, CASE WHEN sd > 0 THEN (x - m) / sd ELSE 0 END AS trend_z, len(list_filter(l, lambda e: e < x)) * 100.0 / len(l) AS trend_pct, CASE WHEN regime IS NOT DISTINCT FROM {lg('regime')} AND {ROW} > 1 THEN 0 ELSE 1 END AS c FROM g1"),
    ("g3", "SELECT *, sum(c) OVER (PARTITION BY ticker ORDER BY session) AS g FROM g2"),
    ("g4", "SELECT *, row_number() OVER (PARTITION BY ticker, g ORDER BY session) AS run_days FROM g3"),
]


@register("volume_regime", with_sql(*T1, *RG) + f" SELECT ticker, session, {rd('trend_z')}, {rd('trend_pct')}, regime, run_days, run_days >= 20 AS sustained, {rd('trend_slope')}, CASE WHEN trend_slope > 5 THEN 'building' WHEN trend_slope < -5 THEN 'rolling over' WHEN trend_slope IS NOT NULL THEN 'steady' END AS direction, CASE WHEN abs(trend_z) >= 2.5 THEN 'extreme' WHEN abs(trend_z) >= 1.5 THEN 'strong' WHEN abs(trend_z) >= 0.75 THEN 'notable' ELSE 'unremarkable' END AS strength FROM g4 WHERE readings >= 30")
def volume_regime(s, d):
    return shown(I.volume_regime(V.bars_t1(s, d)), "trend_z", "trend_pct", "regime", "run_days", "sustained", "trend_slope", "direction", "strength")


DD = [R1, ("dd0", "SELECT *, CASE WHEN r < -0.002 AND volume > v1 THEN 1.0 ELSE 0 END AS dn, CASE WHEN r > 0.002 AND volume > v1 THEN 1.0 ELSE 0 END AS up FROM r1"), ("dd", f"SELECT *, {ra('sum', 'dn', 25, 8)} AS dist_days, {ra('sum', 'up', 25, 8)} AS acc_days FROM dd0")]


@register("dist_acc_days", with_sql(*T1, *DD) + f" SELECT ticker, session, {rd('dist_days')}, {rd('acc_days')} FROM dd WHERE dist_days IS NOT NULL")
def dist_acc_days(s, d):
    return shown(I.distribution_days(V.bars_t1(s, d)), "dist_days", "acc_days")


@register("vp_divergence", with_sql(*T1, VT, VT1, ("p", f"SELECT *, {ROW} AS n, (close / nullif({lg('close', 42)}, 0) - 1) * 100 AS price_move FROM vt1"), ("q", "SELECT *, CASE WHEN price_move > 3 AND volume_trend < -10 THEN 'bearish' WHEN price_move < -3 AND volume_trend < -10 THEN 'bullish' WHEN price_move > 3 AND volume_trend > 15 THEN 'confirmed_up' WHEN price_move < -3 AND volume_trend > 15 THEN 'confirmed_down' ELSE 'none' END AS divergence FROM p WHERE n >= 52 AND price_move IS NOT NULL AND volume_trend IS NOT NULL")) + " SELECT ticker, session, divergence, divergence IN ('bearish', 'bullish') AS depletion FROM q")
def vp_divergence(s, d):
    return shown(I.price_volume_divergence(V.bars_t1(s, d)), "divergence", "depletion")


@register("obv_slope", with_sql(*T1, ("o", f"SELECT *, coalesce(sign(close - {lg('close')}), 0) * volume AS s, {ROW} AS n FROM bars_t1")) + f" SELECT ticker, session, {rd(f'CASE WHEN n > 21 THEN ({ra("sum", "s", 21, 21)}) / nullif({ra("sum", "volume", 21, 5)}, 0) END', 'obv_slope')} FROM o QUALIFY obv_slope IS NOT NULL")
def obv_slope(s, d):
    return shown(I.obv_slope(V.bars_t1(s, d)), "obv_slope")


SMA = ("sma", "SELECT *, " + ", ".join(f"{ra('avg', 'close', n, n)} AS sma_{n}" for n in (20, 50, 150, 200)) + " FROM bars_t1")


@register("sma_flags", with_sql(*T1, SMA) + " SELECT ticker, session, " + ", ".join(f"{rd(f'sma_{n}')}, close > sma_{n} AS above_{n}" for n in (20, 50, 150, 200)) + " FROM sma WHERE sma_20 IS NOT NULL")
def sma_flags(s, d):
    return shown(I.moving_averages(V.bars_t1(s, d)), *[f"{p}_{n}" for n in (20, 50, 150, 200) for p in ("sma", "above")])


@register("returns_n", with_sql(*T1) + " SELECT ticker, session, " + ", ".join(rd(f"close / nullif({lg('close', n)}, 0) - 1", f"ret_{n}") for n in (1, 5, 21, 63)) + " FROM bars_t1 QUALIFY ret_1 IS NOT NULL")
def returns_n(s, d):
    return shown(I.returns(V.bars_t1(s, d)), "ret_1", "ret_5", "ret_21", "ret_63")


BREADTH = [
    "bars_const",
    ("bc0", f"SELECT *, {ra('avg', 'close', 50, 50)} AS sma, {ROW} AS n FROM bars_const"),
    ("bc1", "SELECT b.parent, b.session, count(DISTINCT e.ticker) AS names FROM (SELECT DISTINCT parent, session FROM bc0) b JOIN (SELECT parent, ticker, session FROM bc0 WHERE n = 55) e ON e.parent = b.parent AND e.session <= b.session GROUP BY ALL"),
    ("br", "SELECT parent, session, avg(CASE WHEN close > sma THEN 1.0 ELSE 0 END) * 100 AS breadth, count(*) AS n_names FROM bc0 JOIN bc1 USING (parent, session) WHERE n >= 55 AND sma IS NOT NULL AND names >= 8 GROUP BY ALL"),
]


@register("breadth", with_sql("lots", *BREADTH) + f" SELECT parent, session, {rd('breadth')}, n_names FROM br")
def breadth(s, d):
    return I.breadth(V.bars_const(s, d)).select("parent", "session", tidy("breadth").alias("breadth"), "n_names")


SI = [
    "short_int",
    ("si0", "SELECT *, short_interest / nullif(avg_daily_volume, 0) AS dtc, row_number() OVER w AS n, avg(short_interest) OVER (PARTITION BY ticker ORDER BY settlement ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS prior, lead(settlement) OVER w AS until FROM short_int WINDOW w AS (PARTITION BY ticker ORDER BY settlement)"),
    ("si1", "SELECT a.ticker, a.settlement, any_value(a.dtc) AS dtc, any_value(a.n) AS n, any_value(a.prior) AS prior, any_value(a.short_interest) AS si, any_value(a.until) AS until, count(b.dtc) AS k, count(*) FILTER (b.dtc < a.dtc) AS below FROM si0 a JOIN si0 b ON a.ticker = b.ticker AND b.settlement <= a.settlement GROUP BY ALL"),
]


@register("short_interest", with_sql(*SI, ("days", "SELECT DISTINCT o_orderpriority AS ticker, date_trunc('month', o_orderdate)::DATE AS as_of FROM orders")) + f" SELECT ticker, as_of, settlement, {rd('dtc', 'days_to_cover')}, {rd('CASE WHEN k >= 12 THEN below * 100.0 / k END', 'dtc_pct')}, {rd('CASE WHEN n >= 7 THEN (si / nullif(prior, 0) - 1) * 100 END', 'si_change')}, coalesce(CASE WHEN k >= 12 THEN below * 100.0 / k END >= 75, false) AS crowded FROM days JOIN si1 USING (ticker) WHERE settlement + 14 <= as_of AND (until IS NULL OR until + 14 > as_of)")
def short_interest(s, d):
    as_of = V.read(s, d, "orders").select(F.col("o_orderpriority").alias("ticker"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("as_of")).distinct()
    m = I.short_interest_metrics(V.short_interest(s, d), as_of)
    return m.select("ticker", "as_of", "settlement", *[tidy(c).alias(c) for c in ("days_to_cover", "dtc_pct", "si_change")], "crowded")


DV = ("dv", f"SELECT *, (close / nullif({lg('close', 63)}, 0) - 1) * 100 AS own_move, (bench_close / nullif({lg('bench_close', 63)}, 0) - 1) * 100 AS bench_move FROM mrs")


@register("divergence", with_sql(*RS_ALL, DV) + f" SELECT ticker, session, {rd('own_move')}, {rd('bench_move')}, {rd('own_move - bench_move', 'move_gap')}, sign(own_move) * sign(bench_move) < 0 AND abs(own_move - bench_move) >= 8 AS diverging FROM dv WHERE own_move IS NOT NULL")
def divergence(s, d):
    return shown(I.index_divergence(rs_frame(s, d)), "own_move", "bench_move", "move_gap", "diverging")


@register("squeeze", with_sql(*RS_ALL, DV, ("sq", f"SELECT *, {lg('mansfield_rs', 21)} AS m21, volume > 1.2 * ({ra('avg', 'volume', 60, 20)}) AS crowded FROM dv")) + " SELECT ticker, session, CASE WHEN crowded THEN 1 ELSE 0 END + CASE WHEN sign(own_move) * sign(bench_move) < 0 AND abs(own_move - bench_move) >= 8 THEN 1 ELSE 0 END + CASE WHEN mansfield_rs > m21 THEN 1 ELSE 0 END AS squeeze_score FROM sq")
def squeeze(s, d):
    """These tables have no short interest by type, so days of heavy volume stand for crowded ones."""
    f = I.mansfield(I.index_divergence(rs_frame(s, d)))
    f = f.withColumn("crowded", F.col("volume") > 1.2 * I.mean("volume", 60, 20))
    return shown(I.squeeze(f), "squeeze_score")


GL = [
    ("gl0", f"SELECT *, {ra('avg', 'close', 50, 50)} AS sma_50, {zs('ln(1 + volume)', 60, 20)} AS volume_z, close / nullif({lg('close')}, 0) - 1 AS r FROM mrs"),
    ("gl1", f"SELECT *, {lg('sma_50', 21)} AS s21, {lg('mansfield_rs', 21)} AS m21, max(volume_z) {over(5)} AS vz, max(r) {over(5)} AS rx FROM gl0"),
    ("gl2", "SELECT ticker, session, coalesce(mansfield_rs > 0 AND mansfield_rs > m21, false) AS light_1, coalesce(close > sma_50 AND sma_50 > s21, false) AS light_2, coalesce(vz >= 1 AND rx > 0, false) AS light_3 FROM gl1"),
]


@register("green_light", with_sql(*RS_ALL, *GL) + " SELECT *, light_1::INT + light_2::INT + light_3::INT AS lights FROM gl2")
def green_light(s, d):
    return shown(I.green_light(I.volume_z(I.moving_averages(I.mansfield(rs_frame(s, d)), (50,)))), "light_1", "light_2", "light_3", "lights")


SU = [
    ("u0", f"SELECT *, {ROW} AS n, {BACK} AS back, count(*) OVER (PARTITION BY ticker) AS total, {ra('avg', 'volume', 50, 20)} AS av, {ra('avg', 'high - low', 20, 10)} AS ar, {ra('avg', 'close', 50, 50)} AS sma, {lg('close', 1)} AS c1, {lg('close', 2)} AS c2, {lg('open', 2)} AS o2, {lg('low', 2)} AS l2, {lg('close', 1, 'lead')} AS nx FROM bars_t1"),
    ("u1", f"SELECT *, coalesce((sma / nullif({lg('sma', 21)}, 0) - 1) * 100, 0) AS slope, coalesce(c1 > {lg('sma', 1)}, false) AS prev_above, high - low > 1.3 * ar AS big, volume > av AS heavy, close > open AS up_day FROM u0"),
    ("u2", "SELECT * FROM u1 WHERE total >= 60 AND back <= 5 AND n > 50 AND sma IS NOT NULL AND av IS NOT NULL"),
    ("u3", "SELECT ticker, session, 'ma_bounce' AS setup, 'long' AS direction, least(low, sma) * 0.99 AS stop, NULL::BOOLEAN AS confirmed FROM u2 WHERE low <= sma * 1.02 AND close > sma AND slope > 0 AND up_day AND heavy AND prev_above UNION ALL SELECT ticker, session, 'breakout', 'long', sma * 0.99, nx > high FROM u2 WHERE NOT prev_above AND close > sma AND up_day AND big AND slope > -0.5 UNION ALL SELECT ticker, session, 'breakdown', 'exit/short', sma * 1.01, NULL FROM u2 WHERE prev_above AND close < sma AND NOT up_day AND heavy UNION ALL SELECT ticker, session, 'reversal', 'long', l2 * 0.99, NULL FROM u2 WHERE c2 < o2 AND c1 > o2 AND close > c1 AND heavy"),
]


@register("setups", with_sql(*T1, *SU) + f" SELECT ticker, session, setup, direction, {rd('stop')}, confirmed FROM u3 QUALIFY row_number() OVER (PARTITION BY ticker, setup ORDER BY session DESC) = 1")
def setups(s, d):
    return I.setups(V.bars_t1(s, d)).select("ticker", "session", "setup", "direction", tidy("stop").alias("stop"), "confirmed")


BO = [
    ("k0", "SELECT *, " + ", ".join(f"{ra('avg', 'close', n, n)} AS m{n}" for n in (20, 50, 150)) + f", {ra('avg', 'volume', 50, 10)} AS av, {ROW} AS i, {BACK} AS back, count(*) OVER (PARTITION BY ticker) AS total FROM bars_t1"),
    ("k1", " UNION ALL ".join(f"SELECT ticker, session, close, nullif(volume / nullif(av, 0), 0) AS vr, i, back, total, {n} AS sma, m{n} AS level, {lg(f'm{n}', 21)} AS l21, coalesce(close > m{n}, false) AS above FROM k0" for n in (20, 50, 150))),
    ("k2", "SELECT *, lag(above) OVER w AS was, lead(above) OVER w AS nxt FROM k1 WINDOW w AS (PARTITION BY ticker, sma ORDER BY session)"),
]


@register("sma_breakouts", with_sql(*T1, *BO) + f" SELECT ticker, session, sma, CASE WHEN above THEN 'up' ELSE 'down' END AS direction, {rd('(close / level - 1) * 100', 'gap_pct')}, {rd('coalesce((level / nullif(l21, 0) - 1) * 100, 0)', 'slope_pct')}, {rd('vr', 'volume_ratio')}, coalesce(vr >= 1.2, false) AS volume_confirmed, nxt = above AS confirmed FROM k2 WHERE back <= 120 AND above <> was AND i > sma AND total >= greatest(30, sma + 5)")
def sma_breakouts(s, d):
    b = I.sma_breakouts(V.bars_t1(s, d))
    return b.select("ticker", "session", "sma", "direction", *[tidy(c).alias(c) for c in ("gap_pct", "slope_pct", "volume_ratio")], "volume_confirmed", "confirmed")


STAGE = [
    VT, VT1, R1, *DD[1:],
    ("st0", f"SELECT b.*, {ROW} AS n_bars, {ra('avg', 'close', 50, 50)} AS sma, v.volume_trend, d.dist_days, d.acc_days FROM bars_t1 b JOIN vt1 v USING (ticker, session) JOIN dd d USING (ticker, session)".replace("PARTITION BY ticker ORDER BY session", "PARTITION BY b.ticker ORDER BY b.session").replace("count(close)", "count(b.close)").replace("avg(close)", "avg(b.close)")),
    ("st1", f"SELECT *, sign(close - sma) AS side, coalesce((sma / nullif({lg('sma', 21)}, 0) - 1) * 100, 0) AS slope FROM st0"),
    ("st2", f"SELECT *, CASE WHEN side IS NOT NULL AND {lg('side')} IS NOT NULL THEN CASE WHEN side <> {lg('side')} THEN 1.0 ELSE 0 END END AS cr FROM st1"),
    ("st3", f"SELECT *, coalesce({ra('sum', 'cr', 59, 59)}, 0) AS crossings, coalesce(close > sma, false) AS above, coalesce(volume_trend, 0) AS v, coalesce(dist_days, 0) AS dist, coalesce(acc_days, 0) AS acc FROM st2"),
    ("st", "SELECT *, CASE WHEN n_bars < 80 THEN 0 WHEN NOT above AND slope < -0.75 THEN 4 WHEN above AND slope > 0.75 THEN CASE WHEN v < -10 THEN 3 ELSE 2 END WHEN crossings >= 6 AND abs(slope) <= 0.75 THEN CASE WHEN v < -10 THEN 1 WHEN v > 15 OR dist >= 5 THEN 3 WHEN dist > acc THEN 3 ELSE 1 END WHEN NOT above AND slope < -0.25 THEN 4 WHEN above AND slope < -0.25 THEN 3 WHEN NOT above AND slope > 0.25 THEN CASE WHEN dist >= 6 AND dist > acc THEN 3 ELSE 2 END WHEN above THEN CASE WHEN dist >= 6 AND dist > acc THEN 3 ELSE 2 END WHEN dist >= 6 AND dist > acc THEN CASE WHEN slope > 0 THEN 3 ELSE 4 END ELSE 1 END AS stage FROM st3"),
]


@register("stage", with_sql(*T1, *STAGE) + f" SELECT ticker, session, stage, {rd('slope')}, {rd('crossings')} FROM st")
def stage(s, d):
    return shown(I.stages(V.bars_t1(s, d)), "stage", "slope", "crossings")


def runs_sql(value: str, frm: str) -> list:
    return [
        ("q0", f"SELECT ticker, session, {value} AS value, CASE WHEN {ROW} > 1 AND {value} IS NOT DISTINCT FROM {lg(value)} THEN 0 ELSE 1 END AS c FROM {frm}"),
        ("q1", "SELECT *, sum(c) OVER (PARTITION BY ticker ORDER BY session) AS g FROM q0"),
        ("q2", "SELECT ticker, g, any_value(value) AS value, count(*) AS days, min(session) AS since FROM q1 GROUP BY ticker, g"),
        ("q3", "SELECT *, lag(value) OVER w AS previous, lead(g) OVER w AS more FROM q2 WINDOW w AS (PARTITION BY ticker ORDER BY g)"),
    ]


RUNS = " SELECT ticker, value, days, previous, CASE WHEN previous IS NOT NULL THEN since END AS since FROM q3 WHERE more IS NULL"


@register("stage_duration", with_sql(*T1, *STAGE, *runs_sql("stage", "st")) + RUNS)
def stage_duration(s, d):
    return I.durations(I.stages(V.bars_t1(s, d)), "stage")


@register("stage_history", with_sql(*T1, *STAGE) + f" SELECT ticker, session, stage FROM st QUALIFY {BACK} <= 260")
def stage_history(s, d):
    from pyspark.sql import Window

    f = I.stages(V.bars_t1(s, d)).withColumn("_back", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("session"))))
    return f.where("_back <= 260").select("ticker", "session", "stage")


@register("spark_decimate", with_sql(*RS_ALL, ("z0", f"SELECT ticker, session, mansfield_rs, {BACK} AS back FROM mrs WHERE mansfield_rs IS NOT NULL"), ("z1", f"SELECT *, {ROW} - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM z0 WHERE back <= 120")) + f" SELECT ticker, session, {rd('mansfield_rs')} FROM z1 WHERE n <= 60 OR list_contains(list_transform(range(60), lambda k: round_even(k * (n - 1) / 59.0, 0)::INT), i)")
def spark_decimate(s, d):
    return shown(I.decimate(I.mansfield(rs_frame(s, d)), "mansfield_rs"), "mansfield_rs")


@register("series_trend", with_sql(*RS_ALL, ("y0", f"SELECT ticker, mansfield_rs AS x, {BACK} AS back, count(*) OVER (PARTITION BY ticker) AS n FROM mrs WHERE mansfield_rs IS NOT NULL")) + f" SELECT ticker, {rd('CASE WHEN any_value(n) >= 40 THEN median(x) FILTER (back <= 5) - median(x) FILTER (back > 21 AND back <= 26) END', 'trend')} FROM y0 GROUP BY ticker")
def series_trend(s, d):
    return I.series_trend(I.mansfield(rs_frame(s, d)), "mansfield_rs").select("ticker", tidy("trend").alias("trend"))


@register("mansfield_cross", with_sql(*RS_ALL, ("x0", f"SELECT ticker, session, mansfield_rs AS m, {ROW} AS n, {lg('mansfield_rs', 21)} AS m21 FROM mrs WHERE mansfield_rs IS NOT NULL")) + " SELECT ticker, session, n >= 23 AND m > 0 AND coalesce(m21 <= 0, false) AS cross_up FROM x0")
def mansfield_cross(s, d):
    return I.mansfield_cross_up(I.mansfield(rs_frame(s, d))).select("ticker", "session", "cross_up")
