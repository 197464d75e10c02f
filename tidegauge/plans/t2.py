"""Queries over peers and scores: both tiers, each ticker against the others of its tier on the same session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rolling import tidy
from ..operators import cross_section as X
from ..operators import flow as FL
from ..operators import indicators as I
from ..sources import views as V
from ..sources.views import with_sql
from .t1 import BREADTH, RS, RS1, STAGE, lg, over, ra, rd, runs_sql, zs
from .t1 import RUNS as _RUNS

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _all(f: tuple[str, str]) -> tuple[str, str]:
    return f[0], f[1].replace("bars_t1", "bars_all")


PEER = "OVER (PARTITION BY tier, session)"


def pz(x: str, sd: str = "stddev_pop") -> str:
    return f"({x} - avg({x}) {PEER}) / nullif({sd}({x}) {PEER}, 0)"


def norm(x: str) -> str:
    own = zs(x, 252, 63)
    return f"100 + CASE WHEN count({x}) {PEER} >= 3 THEN greatest(-4, least(4, nullif({pz(x)}, NULL))) ELSE greatest(-4, least(4, {own})) END"


def guarded(x: str) -> str:
    """greatest() and least() skip nulls in DuckDB as well, so the null is put back."""
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(-4, least(4, {x})) END"


def xz(x: str) -> str:
    return f"100 + CASE WHEN count({x}) {PEER} >= 3 THEN {guarded(pz(x))} ELSE {guarded(zs(x, 252, 63))} END"


FRAME = [
    "lots", "bars_t1", "bars_t2", "bars_all", "bars_bench", _all(RS), RS1,
    ("a0", f"SELECT *, (rs / nullif({ra('avg', 'rs', 200, 50)}, 0) - 1) * 100 AS mansfield_rs, row_number() OVER (PARTITION BY ticker ORDER BY session) AS n_bars, 100 * ({ra('avg', 'rs', 10, 10)}) / nullif({ra('avg', 'rs', 40, 40)}, 0) AS qq, {lg('close')} AS c1, close / nullif({lg('close', 21)}, 0) - 1 AS ret_21, {zs('ln(1 + volume)', 60, 20)} AS volume_z, coalesce(((close - low) - (high - close)) / nullif(high - low, 0) * volume, 0) AS mf, {ra('avg', 'volume', 50, 20)} AS av, list_reverse_sort(list(volume) {over(25)}) AS l, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY session) >= 275 AND {lg('close', 273)} > 0 THEN ({lg('close', 21)} / {lg('close', 273)} - 1) * 100 END AS mom_12_1, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY session) >= 149 AND {lg('close', 147)} > 0 THEN ({lg('close', 21)} / {lg('close', 147)} - 1) * 100 END AS mom_6_1 FROM rs1"),
    ("a1", f"SELECT *, CASE WHEN n_bars >= 60 THEN qq END AS rs_ratio_raw, CASE WHEN n_bars >= 60 THEN 100 * qq / nullif({ra('avg', 'qq', 10, 10)}, 0) END AS rs_mom_raw, ({ra('sum', 'mf', 21, 7)}) / nullif({ra('sum', 'volume', 21, 7)}, 0) AS cmf, CASE WHEN close / c1 - 1 > 0.002 AND volume > av THEN 1.0 ELSE 0 END - CASE WHEN close / c1 - 1 < -0.002 AND volume > av THEN 1.0 ELSE 0 END AS ads, ((close - low) / nullif(high - low, 0) - 0.5) * 2 * CASE WHEN volume_z > 0 THEN volume_z WHEN volume_z IS NOT NULL THEN 0 END / (1 + coalesce(abs(close / c1 - 1) / 0.004, 0)) AS abx, CASE WHEN len(l) >= 12 THEN list_sum(l[1 : greatest(3, len(l) // 8)]) / nullif(list_sum(l), 0) - greatest(3, len(l) // 8)::DOUBLE / len(l) END AS block_intensity FROM a0"),
    ("a2", f"SELECT * EXCLUDE (l), ({ra('sum', 'ads', 25, 8)}) / 25.0 AS ad_balance, {ra('avg', 'abx', 25, 8)} AS absorption, {zs('block_intensity', 120, 30)} AS block_intensity_z, {xz('rs_ratio_raw')} AS rs_ratio, {xz('rs_mom_raw')} AS rs_mom FROM a1"),
    *BREADTH,
    ("a3", "SELECT a2.*, br.breadth, CASE WHEN rs_ratio IS NULL OR rs_mom IS NULL THEN 'Unknown' WHEN rs_ratio >= 100 AND rs_mom >= 100 THEN 'Leading' WHEN rs_ratio < 100 AND rs_mom >= 100 THEN 'Improving' WHEN rs_ratio >= 100 THEN 'Weakening' ELSE 'Lagging' END AS quadrant FROM a2 LEFT JOIN br ON a2.ticker = br.parent AND a2.session = br.session"),
]
_COMP = {"mansfield": "mansfield_rs", "rs_mom": "rs_mom", "breadth": "breadth", "cmf": "cmf", "absorption": "absorption"}


def _zl(c: str, x: str) -> tuple[str, str]:
    w = f"OVER (PARTITION BY ticker, ({x} IS NOT NULL) ORDER BY session ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) {w} >= 40 THEN CASE WHEN stddev_pop({x}) {w} > 0 THEN greatest(-3, least(3, ({x} - avg({x}) {w}) / stddev_pop({x}) {w})) ELSE 0 END END AS z0_{c}", f"CASE WHEN {x} IS NOT NULL THEN stddev_pop({x}) {w} END AS sd_{c}"


def _blend(parts: list[tuple[float, str]]) -> str:
    return "(" + " + ".join(f"coalesce({w} * ({p}), 0)" for w, p in parts) + ") / nullif(" + " + ".join(f"CASE WHEN ({p}) IS NOT NULL THEN {w} ELSE 0 END" for w, p in parts) + ", 0)"


_W = X.CSRI_WEIGHTS
_C = "OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SCORES = [
    *FRAME,
    ("s0", "SELECT *, " + ", ".join(", ".join(_zl(c, x)) for c, x in _COMP.items()) + " FROM a3"),
    ("s1", "SELECT *, " + ", ".join(f"CASE WHEN {x} IS NOT NULL AND row_number() OVER (PARTITION BY ticker, ({x} IS NOT NULL) ORDER BY session) > 60 THEN lag(z0_{c}, 21) OVER (PARTITION BY ticker, ({x} IS NOT NULL) ORDER BY session) END AS b0_{c}" for c, x in _COMP.items()) + f", {_blend([(0.40, 'tanh(z0_absorption / 1.5)'), (0.35, 'CASE WHEN ad_balance IS NOT NULL THEN greatest(-1, least(1, 2.5 * ad_balance)) END'), (0.25, 'tanh(block_intensity_z / 2)')])} AS inst FROM s0"),
    ("s2", "SELECT *, " + ", ".join(f"last_value(z0_{c} IGNORE NULLS) {_C} AS z_{c}, last_value(b0_{c} IGNORE NULLS) {_C} AS b_{c}" for c in _COMP) + f", 2 * last_value(inst IGNORE NULLS) {_C} AS z_inst FROM s1"),
    ("s3", "SELECT *, " + _blend([(w, f"z_{c}") for c, w in _W.items()]) + " AS csri, " + _blend([(w, f"b_{'absorption' if c == 'inst' else c}") for c, w in _W.items()]) + " AS csri_prev, " + _blend([(w, f"CASE WHEN sd_{k} > 0 THEN z0_{k} END") for c, w in _W.items() for k in ["absorption" if c == "inst" else c]]) + f" AS csri_hist, CASE WHEN inst IS NOT NULL THEN (rank() OVER (PARTITION BY tier, session ORDER BY inst NULLS LAST) - 1) * 100.0 / count(inst) {PEER} END AS inst_pct FROM s2"),
    ("s4", "SELECT *, csri - csri_prev AS csri_delta, CASE WHEN coalesce(mansfield_rs > 0 AND coalesce(breadth >= 60, true) AND cmf >= 0.05 AND quadrant IN ('Leading', 'Improving'), false) THEN 'CONFIRMED_BREAKOUT' WHEN coalesce(mansfield_rs <= 0 AND rs_mom >= 100 AND coalesce(breadth >= 45, true) AND inst >= -0.10 AND (inst_pct IS NULL OR inst_pct >= 60), false) THEN 'STEALTH_ACCUMULATION' WHEN coalesce(mansfield_rs > 0 AND rs_mom < 100 AND cmf <= 0, false) THEN 'DISTRIBUTION' WHEN coalesce(mansfield_rs <= 0 AND rs_mom < 100 AND coalesce(breadth <= 40, true), false) THEN 'CAPITAL_FLIGHT' ELSE 'NEUTRAL' END AS phase FROM s3"),
]
_LAST = "row_number() OVER (PARTITION BY ticker ORDER BY session DESC) = 1"


def frame(s: SparkSession, d: str) -> DataFrame:
    b = I.breadth(V.bars_const(s, d)).select(F.col("parent").alias("ticker"), "session", "breadth")
    return X.score_frame(V.bars_all(s, d), V.bars_bench(s, d), b)


def crossed(f: DataFrame) -> DataFrame:
    """f with cross_up: relative strength above zero now, and not above it 21 rows back; 23 readings at least."""
    n = F.count("mansfield_rs").over(I.ordered().rowsBetween(Window.unboundedPreceding, 0))
    return f.withColumn("cross_up", F.coalesce((n >= 23) & (F.col("mansfield_rs") > 0) & (I.lag("mansfield_rs", 21) <= 0), F.lit(False)))


def _show(df: DataFrame, *names: str, keep: tuple = ("ticker", "session")) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*keep, *[tidy(n).alias(n) if kinds[n] == "double" else F.col(n) for n in names])


def _rrg(s, d):
    f = I.rrg_raw(I.relative_strength(V.bars_all(s, d), V.bars_bench(s, d)))
    f = X.rrg_normalise(f, {"rs_ratio_raw": "rs_ratio", "rs_mom_raw": "rs_mom"})
    return f.withColumn("quadrant", X.quadrant())


@register("rrg_norm", with_sql(*FRAME) + f" SELECT ticker, session, {rd('rs_ratio')}, {rd('rs_mom')}, quadrant FROM a3")
def rrg_norm(s, d):
    return _show(_rrg(s, d), "rs_ratio", "rs_mom", "quadrant")


@register("quadrant_duration", with_sql(*FRAME, *runs_sql("quadrant", "a3")) + _RUNS)
def quadrant_duration(s, d):
    return I.durations(_rrg(s, d), "quadrant")


_TZ = "CASE WHEN {x} IS NOT NULL THEN CASE WHEN stddev_pop({x}) OVER (PARTITION BY tier) > 0 THEN ({x} - avg({x}) OVER (PARTITION BY tier)) / stddev_pop({x}) OVER (PARTITION BY tier) ELSE 0 END END"


@register("vms", with_sql(*FRAME, ("l0", f"SELECT * FROM a3 QUALIFY {_LAST}"), ("l1", f"SELECT *, {_TZ.format(x='mom_12_1')} AS za, {_TZ.format(x='rs_mom')} AS zb FROM l0"), ("l2", f"SELECT *, {_blend([(0.5, 'za'), (0.5, 'zb')])} AS vms FROM l1")) + f" SELECT ticker, tier, {rd('vms')}, CASE WHEN vms IS NOT NULL THEN row_number() OVER (PARTITION BY tier ORDER BY vms DESC NULLS LAST, ticker) END AS vms_rank, count(vms) OVER (PARTITION BY tier) AS tier_size FROM l2")
def vms(s, d):
    f = I.momentum(_rrg(s, d))
    return _show(X.vms(X.latest(f)), "vms", "vms_rank", "tier_size", keep=("ticker", "tier"))


@register("vms_history", with_sql(*FRAME, ("h0", f"SELECT *, count(mom_12_1) {PEER} AS na, count(rs_mom) {PEER} AS nb FROM a3"), ("h1", f"SELECT ticker, tier, session, 0.5 * {pz('mom_12_1')} + 0.5 * {pz('rs_mom')} AS v FROM h0 WHERE na >= 3 AND nb >= 3")) + f" SELECT ticker, session, {rd('v', 'vms_hist')} FROM h1 WHERE tier IN (SELECT tier FROM h1 GROUP BY tier HAVING count(DISTINCT session) >= 30)")
def vms_history(s, d):
    return _show(X.vms_history(I.momentum(_rrg(s, d))), "vms_hist")


@register("inst_flow", with_sql(*SCORES) + f" SELECT ticker, session, {rd('inst')}, {rd('inst_pct')} FROM s4 WHERE inst IS NOT NULL")
def inst_flow(s, d):
    return _show(frame(s, d).where("inst is not null"), "inst", "inst_pct")


@register("csri", with_sql(*SCORES) + f" SELECT ticker, session, {rd('csri')}, {rd('z_mansfield')}, {rd('z_rs_mom')}, {rd('z_breadth')}, {rd('z_cmf')}, {rd('z_inst')} FROM s4 WHERE csri IS NOT NULL")
def csri(s, d):
    return _show(frame(s, d).where("csri is not null"), "csri", "z_mansfield", "z_rs_mom", "z_breadth", "z_cmf", "z_inst")


@register("csri_delta", with_sql(*SCORES) + f" SELECT ticker, session, {rd('csri_delta')} FROM s4 WHERE csri_delta IS NOT NULL")
def csri_delta(s, d):
    return _show(frame(s, d).where("csri_delta is not null"), "csri_delta")


@register("csri_history", with_sql(*SCORES) + f" SELECT ticker, session, {rd('csri_hist')} FROM s4 WHERE csri_hist IS NOT NULL")
def csri_history(s, d):
    return _show(frame(s, d).where("csri_hist is not null"), "csri_hist")


@register("phase", with_sql(*SCORES) + " SELECT ticker, session, phase FROM s4")
def phase(s, d):
    return frame(s, d).select("ticker", "session", "phase")


@register("phase_strict", with_sql(*SCORES) + " SELECT ticker, session, CASE WHEN coalesce(mansfield_rs > 0 AND coalesce(breadth >= 60, false) AND cmf >= 0.05 AND quadrant IN ('Leading', 'Improving'), false) THEN 'CONFIRMED_BREAKOUT' WHEN coalesce(mansfield_rs <= 0 AND rs_mom >= 100 AND coalesce(breadth >= 45, false) AND inst >= -0.10 AND (inst_pct IS NULL OR inst_pct >= 60), false) THEN 'STEALTH_ACCUMULATION' WHEN coalesce(mansfield_rs > 0 AND rs_mom < 100 AND cmf <= 0, false) THEN 'DISTRIBUTION' WHEN coalesce(mansfield_rs <= 0 AND rs_mom < 100 AND coalesce(breadth <= 40, false), false) THEN 'CAPITAL_FLIGHT' ELSE 'NEUTRAL' END AS phase FROM s4")
def phase_strict(s, d):
    return frame(s, d).withColumn("phase", X.phase(strict=True)).select("ticker", "session", "phase")


_STAGES = [_all(x) for x in STAGE]


def flow_columns(s: SparkSession, d: str) -> DataFrame:
    """What the four kinds of flow look at, by ticker and session; tickers without trades have no rows."""
    from .t3 import daily

    return FL.trailing(daily(s, d)).withColumnRenamed("day", "session")


@register("flags", with_sql(*SCORES, *_STAGES, ("f0", f"SELECT *, coalesce({ra('count', 'mansfield_rs', 100000, 0)} >= 23 AND mansfield_rs > 0 AND {lg('mansfield_rs', 21)} <= 0, false) AS cross_up FROM s4"), ("f1", "SELECT f0.*, st.stage FROM f0 JOIN st USING (ticker, session)")) + " SELECT ticker, session, array_to_string(list_filter([CASE WHEN cross_up THEN 'mansfield_cross' END, CASE WHEN volume_z >= 2 THEN 'unusual_volume' END, CASE WHEN block_intensity_z >= 2 THEN 'block_activity' END, CASE WHEN csri_delta >= 0.75 THEN 'csri_surge' END, CASE WHEN csri_delta <= -0.75 THEN 'csri_slump' END, CASE WHEN absorption > 0.25 AND coalesce(ret_21, 0) * 100 < 3 THEN 'absorption' END, CASE WHEN stage = 4 THEN 'stage4' END], lambda x: x IS NOT NULL), ',') AS kinds FROM f1")
def flags(s, d):
    """The SQL leaves out the four kinds of flow: in these tables no ticker has both bars and trades."""
    f = I.stages(crossed(frame(s, d))).join(flow_columns(s, d), ["ticker", "session"], "left")
    return f.select("ticker", "session", F.array_join(X.flags(), ",").alias("kinds"))


@register("inst_pct", with_sql(*SCORES) + f" SELECT ticker, tier, session, {rd('inst_pct')} FROM s4 WHERE inst_pct IS NOT NULL QUALIFY {_LAST}")
def inst_pct(s, d):
    return _show(X.latest(frame(s, d), "inst_pct"), "inst_pct", keep=("ticker", "tier", "session"))


@register("tier_rank", with_sql(*SCORES, ("t0", f"SELECT * FROM s4 QUALIFY {_LAST}"), ("t1", "SELECT *, row_number() OVER (PARTITION BY tier ORDER BY csri DESC, ticker) AS rank, count(*) OVER (PARTITION BY tier) AS n FROM t0 WHERE csri IS NOT NULL")) + f" SELECT ticker, tier, {rd('csri')}, rank, {rd('100.0 * (n - rank + 1) / n', 'percentile')} FROM t1")
def tier_rank(s, d):
    return _show(X.tier_rank(X.latest(frame(s, d))), "csri", "rank", "percentile", keep=("ticker", "tier"))


VMS_SQL = [*FRAME, ("l0", f"SELECT * FROM a3 QUALIFY {_LAST}"), ("l1", f"SELECT *, {_TZ.format(x='mom_12_1')} AS za, {_TZ.format(x='rs_mom')} AS zb FROM l0"), ("l2", f"SELECT *, {_blend([(0.5, 'za'), (0.5, 'zb')])} AS vms FROM l1")]


@register("rotation", with_sql(*VMS_SQL, ("t1", "SELECT * FROM l2 WHERE tier = 1 AND vms IS NOT NULL"), ("up", "SELECT *, 'gaining' AS side FROM t1 WHERE vms > 0 ORDER BY vms DESC, ticker LIMIT 4"), ("dn", "SELECT *, 'losing' AS side FROM t1 WHERE vms < 0 ORDER BY vms, ticker DESC LIMIT 4")) + f" SELECT ticker, side, {rd('vms')}, abs(vms) >= 0.5 AS material, (SELECT count(*) FROM t1) AS n_total, (SELECT count(*) FROM t1 WHERE abs(vms) >= 0.5) AS n_material FROM (FROM up UNION ALL FROM dn) WHERE (SELECT count(*) FROM t1) >= 4")
def rotation(s, d):
    return _show(X.rotation(X.vms(X.latest(I.momentum(_rrg(s, d))))), "vms", "material", "n_total", "n_material", keep=("ticker", "side"))


_B = [
    "lots", "bars_bench",
    ("g0", "SELECT *, CASE WHEN count(close) OVER a >= 50 THEN avg(close) OVER a END AS s50, CASE WHEN count(close) OVER b >= 200 THEN avg(close) OVER b END AS s200 FROM bars_bench WINDOW a AS (ORDER BY session ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), b AS (ORDER BY session ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)"),
    ("g1", "SELECT *, (s200 / lag(s200, 41) OVER (ORDER BY session) - 1) * 100 AS slope_200 FROM g0"),
]


@register("regime", with_sql(*_B) + f" SELECT session, {rd('slope_200')}, CASE WHEN close > s200 AND close > s50 AND slope_200 > 0 THEN 'RISK-ON' WHEN close > s200 AND NOT close > s50 THEN 'PULLBACK' WHEN NOT close > s200 AND slope_200 > 0 THEN 'CAUTION' ELSE 'RISK-OFF' END AS regime FROM g1 WHERE slope_200 IS NOT NULL")
def regime(s, d):
    return X.market_regime(V.bars_bench(s, d)).where("regime is not null").select("session", tidy("slope_200").alias("slope_200"), "regime")


_CYC, _DEF = "'ECONOMY ANODIZED', 'PROMO BRUSHED', 'ECONOMY', 'PROMO', 'LARGE'", "'STANDARD', 'SMALL', 'MEDIUM'"


@register("regime_tilt", with_sql(*SCORES, ("t0", f"SELECT * FROM s4 QUALIFY {_LAST}"), ("t1", f"SELECT avg(csri) FILTER (ticker IN ({_CYC})) - avg(csri) FILTER (ticker IN ({_DEF})) AS tilt FROM t0")) + f" SELECT {rd('tilt')}, CASE WHEN tilt > 0.15 THEN 'offensive' WHEN tilt < -0.15 THEN 'defensive' ELSE 'balanced' END AS stance FROM t1")
def regime_tilt(s, d):
    names = lambda x: [n.strip().strip("'") for n in x.split(",")]
    return X.tilt(X.latest(frame(s, d)), names(_CYC), names(_DEF)).select(tidy("tilt").alias("tilt"), "stance")


@register("momentum_z", with_sql(*FRAME) + f" SELECT ticker, session, {rd(pz('mom_12_1', 'stddev_samp'), 'mom_z')} FROM a3 QUALIFY mom_z IS NOT NULL")
def momentum_z(s, d):
    f = I.momentum(V.bars_all(s, d).join(V.bars_bench(s, d).select("session"), "session")).withColumn("mom_z", X.peer_z("mom_12_1", ddof=1))
    return _show(f.where("mom_z is not null"), "mom_z")
