"""Queries over the walk-forward panel: tier 2, a rebalance every 20 sessions of the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rolling import flag, tidy
from ..operators import cross_section as X
from ..operators import indicators as I
from ..operators import panel as P
from ..operators import resampling as R
from ..sources import views as V
from ..sources.shared import table
from ..sources.views import with_sql
from ..streaming import alerts as A
from .t1 import rd
from .t2 import SCORES, crossed, flow_columns
from .t2 import frame as score_frame

QUERIES: dict = {}
ORACLES: dict = {}
BEST, WORST = "DISTRIBUTION", "CAPITAL_FLIGHT"  # the two phases with most observations here
Z = ("z_mansfield", "z_rs_mom", "z_breadth", "z_cmf", "z_inst")


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _show(df: DataFrame, *names: str, keep: tuple = (), digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*keep, *[tidy(n, digits).alias(n) if kinds[n] == "double" else F.col(n) for n in names])


_PHASE = dict(x for x in SCORES if not isinstance(x, str))["s4"]
_PHASE = _PHASE[_PHASE.index("CASE WHEN coalesce(mansfield_rs") : _PHASE.index(" FROM s3")]
OBS = [
    *SCORES,
    ("bf", "SELECT session, row_number() OVER w - 1 AS i, count(*) OVER () AS n, " + ", ".join(f"lead(close, {h}) OVER w / nullif(close, 0) AS b{h}" for h in P.HORIZONS) + " FROM bars_bench WINDOW w AS (ORDER BY session)"),
    ("rb", "SELECT session AS date, " + ", ".join(f"b{h}" for h in P.HORIZONS) + " FROM bf WHERE i >= 260 AND (i - 260) % 20 = 0 AND i < n - 64"),
    ("of", "SELECT *, " + ", ".join(f"lead(close, {h}) OVER w / nullif(close, 0) AS o{h}" for h in P.HORIZONS) + " FROM s4 WINDOW w AS (PARTITION BY ticker ORDER BY session)"),
    ("ob", "SELECT g.date, o.* EXCLUDE (session, phase, inst_pct), " + ", ".join(f"(o.o{h} - g.b{h}) * 100 AS fwd_{h}" for h in P.HORIZONS) + " FROM (SELECT t.ticker AS name, rb.* FROM (SELECT DISTINCT ticker FROM s4) t CROSS JOIN rb) g ASOF JOIN of o ON g.name = o.ticker AND g.date >= o.session WHERE o.n_bars >= 260"),
    ("og", "SELECT *, CASE WHEN inst IS NOT NULL THEN (rank() OVER (PARTITION BY tier, date ORDER BY inst NULLS LAST) - 1) * 100.0 / count(inst) OVER (PARTITION BY tier, date) END AS inst_pct FROM ob QUALIFY count(*) OVER (PARTITION BY date) >= 5"),
    ("obs", f"SELECT *, {_PHASE} FROM og WHERE coalesce({', '.join(f'fwd_{h}' for h in P.HORIZONS)}) IS NOT NULL"),
]
EPS = [
    *OBS,
    ("e0", "SELECT *, CASE WHEN row_number() OVER w > 1 AND phase IS NOT DISTINCT FROM lag(phase) OVER w THEN 0 ELSE 1 END AS c FROM obs WINDOW w AS (PARTITION BY ticker ORDER BY date)"),
    ("e1", "SELECT *, sum(c) OVER (PARTITION BY ticker ORDER BY date) AS g FROM e0"),
    ("eps", "SELECT ticker, first(tier ORDER BY date) AS tier, first(phase ORDER BY date) AS phase, " + ", ".join(f"first({c} ORDER BY date) AS {c}" for c in ("csri", "fwd_5", "fwd_21", "fwd_63")) + ", min(date) AS start, max(date) AS fin, count(*) AS length_obs FROM e1 GROUP BY ticker, g"),
]


def obs(s: SparkSession, d: str) -> DataFrame:
    """Peers' percentiles and phases are those of the rows that stand for a date."""
    o = P.observations(score_frame(s, d), V.bars_bench(s, d)).withColumn("inst_pct", X.strictly_below("inst", Window.partitionBy("tier", "date")))
    return P.with_returns(o.withColumn("phase", X.phase()))


def eps(s: SparkSession, d: str) -> DataFrame:
    return P.episodes(obs(s, d))


@register("fwd_returns", with_sql("lots", "bars_t1", "bars_bench", ("b", "SELECT session, " + ", ".join(f"lead(close, {h}) OVER (ORDER BY session) / nullif(close, 0) AS b{h}" for h in P.HORIZONS) + " FROM bars_bench"), ("o", "SELECT *, " + ", ".join(f"lead(close, {h}) OVER (PARTITION BY ticker ORDER BY session) / nullif(close, 0) AS o{h}" for h in P.HORIZONS) + " FROM bars_t1")) + " SELECT ticker, session, " + ", ".join(rd(f"(o{h} - b{h}) * 100", f"fwd_{h}") for h in P.HORIZONS) + " FROM o JOIN b USING (session)")
def fwd_returns(s, d):
    return _show(P.forward_returns(V.bars_t1(s, d), V.bars_bench(s, d)), *[f"fwd_{h}" for h in P.HORIZONS], keep=("ticker", "session"))


_OC = ("csri", *[f"fwd_{h}" for h in P.HORIZONS], *Z, "mom_12_1", "mom_6_1")


@register("panel", with_sql(*OBS) + " SELECT date, ticker, tier, phase, " + ", ".join(rd(c) for c in _OC) + " FROM obs")
def panel(s, d):
    return _show(obs(s, d), *_OC, keep=("date", "ticker", "tier", "phase"))


@register("episodes", with_sql(*EPS) + f" SELECT ticker, tier, phase, start, fin AS end, length_obs, {rd('csri')}, {rd('fwd_21')} FROM eps")
def episodes(s, d):
    return _show(eps(s, d), "csri", "fwd_21", keep=("ticker", "tier", "phase", "start", "end", "length_obs"))


_SUM = "count({x}) AS n, round(avg({x}), 6) + 0.0 AS mean, round(median({x}), 6) + 0.0 AS median, round(stddev_samp({x}), 6) + 0.0 AS sd, round(avg(CASE WHEN {x} > 0 THEN 1.0 WHEN {x} IS NOT NULL THEN 0 END) * 100, 6) + 0.0 AS hit"


@register("phase_table", with_sql(*EPS) + f" SELECT phase, {_SUM.format(x='fwd_21')} FROM eps GROUP BY phase")
def phase_table(s, d):
    return _show(P.phase_table(eps(s, d)), "n", "mean", "median", "sd", "hit", keep=("phase",))


def _ranks(x: str, y: str, frm: str, keys: str = "date") -> str:
    a = lambda v: f"rank() OVER (PARTITION BY {keys} ORDER BY {v}) + (count(*) OVER (PARTITION BY {keys}, {v}) - 1) / 2.0"
    return f"SELECT *, {a(x)} AS rx, {a(y)} AS ry FROM {frm} WHERE {x} IS NOT NULL AND {y} IS NOT NULL"


def _ic(x: str, frm: str = "obs") -> tuple:
    return (f"i_{x}", _ranks(x, "fwd_21", frm)), (f"ic_{x}", f"SELECT date, corr(rx, ry) AS ic, count(*) AS n FROM i_{x} GROUP BY date HAVING count(*) >= 6 AND count(DISTINCT {x}) >= 3 AND count(DISTINCT fwd_21) >= 3")


@register("ic_by_date", with_sql(*OBS, *_ic("csri")) + f" SELECT date, {rd('ic')}, n FROM ic_csri")
def ic_by_date(s, d):
    return _show(P.ic_by_date(obs(s, d), "csri"), "ic", "n", keep=("date",))


_ICS = "round(avg(ic), 6) + 0.0 AS mean_ic, count(*) AS dates, round(avg(CASE WHEN round(ic, 9) > 0 THEN 1.0 ELSE 0 END) * 100, 6) + 0.0 AS positive, round(avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0), 6) + 0.0 AS t_stat"


@register("momentum_vs_csri", with_sql(*OBS, *_ic("csri"), *_ic("mom_12_1")) + f" SELECT 'csri' AS model, {_ICS} FROM ic_csri WHERE ic IS NOT NULL UNION ALL SELECT 'mom_12_1', {_ICS} FROM ic_mom_12_1 WHERE ic IS NOT NULL")
def momentum_vs_csri(s, d):
    o = obs(s, d)
    both = [P.ic_summary(P.ic_by_date(o, x)).withColumn("model", F.lit(x)) for x in ("csri", "mom_12_1")]
    return _show(both[0].unionByName(both[1]), "mean_ic", "dates", "positive", "t_stat", keep=("model",))


#: Columns and weights of the models under study; z12 and z6 are momentum's z-scores among a date's names.
MODELS = {
    "csri": {"csri": 1.0}, "equal": dict.fromkeys(Z, 0.2), "mom_12_1": {"z12": 1.0}, "mom_6_1": {"z6": 1.0}, "rs_mom": {"z_rs_mom": 1.0}, "mansfield": {"z_mansfield": 1.0},
    "mom_12_1+rs_mom": {"z12": 0.5, "z_rs_mom": 0.5}, "mom_12_1+mansfield": {"z12": 0.5, "z_mansfield": 0.5},
}


def _weighed(weights: dict[str, float]) -> str:
    return "(" + " + ".join(f"coalesce({w} * {c}, 0)" for c, w in weights.items()) + ") / nullif(" + " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0 END" for c, w in weights.items()) + ", 0)"


def _zd(x: str) -> str:
    return f"({x} - avg({x}) OVER (PARTITION BY date)) / nullif(stddev_samp({x}) OVER (PARTITION BY date), 0)"


LONG = [
    *OBS,
    ("mz", f"SELECT *, {_zd('mom_12_1')} AS z12, {_zd('mom_6_1')} AS z6, row_number() OVER (ORDER BY date, ticker) AS gr, count(*) OVER () AS gn FROM obs"),
    ("mq", "SELECT *, greatest(1, ceil((gr - 1) * 4 / (gn - 1)))::INT AS quarter FROM mz"),
    ("ms", "SELECT date, ticker, quarter, " + ", ".join(f"fwd_{h}" for h in P.HORIZONS) + ", unnest([" + ", ".join(f"{{'model': '{m}', 'score': {_weighed(w)}}}" for m, w in MODELS.items()) + "]) AS u FROM mq"),
    ("ml", " UNION ALL ".join(f"SELECT date, ticker, quarter, u.model AS model, u.score AS score, {h} AS horizon, fwd_{h} AS fwd FROM ms WHERE u.score IS NOT NULL AND fwd_{h} IS NOT NULL" for h in P.HORIZONS)),
    ("mr", _ranks("score", "fwd", "ml", "model, horizon, date")),
    ("mi", "SELECT model, horizon, date, corr(rx, ry) AS ic FROM mr GROUP BY ALL HAVING count(*) >= 6 AND count(DISTINCT score) >= 3 AND corr(rx, ry) IS NOT NULL"),
]


def models(o: DataFrame) -> DataFrame:
    return o.withColumns({"z12": P.date_zscore("mom_12_1"), "z6": P.date_zscore("mom_6_1")})


@register("ic_by_model", with_sql(*LONG) + f" SELECT model, horizon, {_ICS} FROM mi GROUP BY ALL")
def ic_by_model(s, d):
    return _show(P.ic_of_models(models(obs(s, d)), {m: P.weighted_score(w) for m, w in MODELS.items()}), "mean_ic", "dates", "positive", "t_stat", keep=("model", "horizon"))


_STUDY = [
    *LONG,
    ("t0", "SELECT date AS cut FROM (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM obs)) WHERE i = floor(n * (1 - 0.3)) + 1"),
    ("t1", "SELECT model, " + ", ".join(f"avg(ic) FILTER (horizon = {h}) AS ic_{h}" for h in P.HORIZONS) + ", avg(ic) FILTER (horizon = 21 AND date < cut) AS ic_train, avg(ic) FILTER (horizon = 21 AND date >= cut) AS ic_holdout FROM mi, t0 GROUP BY model"),
    ("t2", _ranks("score", "fwd", "(SELECT * FROM ml WHERE horizon = 21)", "model, quarter, date")),
    ("t3", "SELECT model, quarter, date, corr(rx, ry) AS ic FROM t2 GROUP BY ALL HAVING count(*) >= 6 AND count(DISTINCT score) >= 3 AND corr(rx, ry) IS NOT NULL"),
    ("t4", "SELECT model, " + ", ".join(f"avg(ic) FILTER (quarter = {k}) AS ic_q{k}" for k in (1, 2, 3, 4)) + " FROM t3 GROUP BY model"),
    ("c0", "SELECT * FROM ml WHERE horizon = 21"),
    ("c1", "SELECT model, greatest(1, floor(median(k) / 5)) AS side FROM (SELECT model, date, count(*) AS k FROM c0 GROUP BY ALL) GROUP BY model HAVING sum(k) >= 200"),
    ("c2", "SELECT *, row_number() OVER (PARTITION BY model, date ORDER BY score DESC, ticker) <= side AS best, row_number() OVER (PARTITION BY model, date ORDER BY score, ticker DESC) <= side AS worst FROM c0 JOIN c1 USING (model)"),
    ("c3", "SELECT model, date, list(ticker ORDER BY ticker) FILTER (best OR worst) AS names, (avg(fwd) FILTER (best) - avg(fwd) FILTER (worst)) / 2 AS gross FROM c2 GROUP BY ALL"),
    ("c4", "SELECT *, lag(names) OVER (PARTITION BY model ORDER BY date) AS b FROM c3 QUALIFY count(*) OVER (PARTITION BY model) >= 10"),
    ("c5", "SELECT *, CASE WHEN b IS NULL THEN 1.0::DOUBLE ELSE (len(list_filter(names, lambda x: NOT list_contains(b, x))) + len(list_filter(b, lambda x: NOT list_contains(names, x))))::DOUBLE / (len(names) + len(list_filter(b, lambda x: NOT list_contains(names, x)))) END AS churn FROM c4"),
    ("cb", "SELECT *, gross - churn * 5 / 100 AS net FROM c5"),
    ("c6", "SELECT model, count(*) AS rebalances, avg(net) * 252 / 21 AS net_ann, avg(net) * 252 / 21 / nullif(stddev_samp(net) * sqrt(252.0 / 20), 0) AS sharpe FROM cb GROUP BY model"),
    ("m1", "SELECT *, " + " AND ".join(f"coalesce(round(ic_q{k}, 3) > 0, false)" for k in (1, 2, 3, 4)) + " AS sign_stable, " + " + ".join(f"coalesce(round(ic_{h}, 4) > 0, false)::INT" for h in P.HORIZONS) + " AS positive, " + " + ".join(f"(ic_{h} IS NOT NULL)::INT" for h in P.HORIZONS) + " AS there FROM t1 LEFT JOIN t4 USING (model) LEFT JOIN c6 USING (model)"),
    ("m2", "SELECT *, coalesce(round(ic_holdout, 4) > (SELECT round(ic_holdout, 4) FROM m1 WHERE model = 'csri'), false) AS c1, sign_stable AS c2, coalesce(round(ic_holdout, 4) > (SELECT round(ic_holdout, 4) FROM m1 WHERE model = 'equal'), false) AS c3, coalesce(round(sharpe, 3) > 0.30, false) AS c4, positive > there / 2 AS c5 FROM m1"),
]
_MS = (*[f"ic_{h}" for h in P.HORIZONS], "ic_train", "ic_holdout", "ic_q1", "ic_q2", "ic_q3", "ic_q4", "sharpe", "net_ann")


@register("model_study", with_sql(*_STUDY) + " SELECT model, " + ", ".join(rd(c) for c in _MS) + ", sign_stable, positive, c1, c2, c3, c4, c5, c1 AND c2 AND c3 AND c4 AND c5 AND model NOT IN ('csri', 'equal') AS adopt FROM m2")
def model_study(s, d):
    m = P.model_study(models(obs(s, d)), {m: P.weighted_score(w) for m, w in MODELS.items()}, "csri", "equal")
    return _show(m, *_MS, "sign_stable", "positive", "c1", "c2", "c3", "c4", "c5", "adopt", keep=("model",))


_CS = (*Z, "csri")


@register("component_spread", with_sql(*OBS, ("cl", " UNION ALL ".join(f"SELECT date, '{z}' AS component, {z} AS x, fwd_21 AS y FROM obs WHERE {z} IS NOT NULL AND fwd_21 IS NOT NULL" for z in _CS)), ("ce", "SELECT component, date, quantile_cont(x, 1 / 3) AS lo, quantile_cont(x, 2 / 3) AS hi, count(*) AS k FROM cl GROUP BY ALL"), ("cs", "SELECT component, date, any_value(k) AS k, CASE WHEN any_value(k) >= 6 THEN avg(y) FILTER (x >= hi) - avg(y) FILTER (x <= lo) END AS sp FROM cl JOIN ce USING (component, date) GROUP BY ALL"), ("ct", "SELECT component, sum(k)::BIGINT AS n, count(sp) AS dates, avg(sp) AS m, avg(CASE WHEN sp > 0 THEN 1.0 WHEN sp IS NOT NULL THEN 0 END) AS p FROM cs GROUP BY component")) + f" SELECT component, n, dates, {rd('CASE WHEN n >= 200 AND dates >= 20 THEN m END', 'spread')}, {rd('CASE WHEN n >= 200 AND dates >= 20 THEN p END', 'share_positive')} FROM ct")
def component_spread(s, d):
    return _show(P.component_spread(obs(s, d), _CS), "n", "dates", "spread", "share_positive", keep=("component",))


@register("phase_test")
def phase_test(s, d):
    """phase_table's means with bootstrap interval and p-value, in blocks of episodes that outlast a horizon."""
    return R.bootstrap_mean(eps(s, d).withColumn("x", F.col("fwd_21")), "phase", order=("start", "ticker"), block=R.block_for(21, P.STEP))


@register("component_test")
def component_test(s, d):
    """component_spread's means over dates with bootstrap interval and p-value."""
    return R.bootstrap_mean(P.component_days(obs(s, d), _CS).withColumn("x", F.col("spread")), "component", reps=3000)


@register("bucket_test")
def bucket_test(s, d):
    """csri_buckets' means with bootstrap interval and p-value."""
    return R.bootstrap_mean(P.bucketed(obs(s, d)).withColumn("x", F.col("fwd_21")), "bucket", order=("date", "ticker"), reps=2000)


@register("transitions", with_sql(*EPS, ("tr", "SELECT phase AS from_phase, lead(phase) OVER (PARTITION BY ticker ORDER BY start) AS to_phase FROM eps")) + f" SELECT from_phase, to_phase, count(*) AS n, {rd('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY from_phase)', 'pct')} FROM tr WHERE to_phase IS NOT NULL GROUP BY from_phase, to_phase")
def transitions(s, d):
    return _show(P.transitions(eps(s, d)), "n", "pct", keep=("from_phase", "to_phase"))


def _bucket(k: int) -> str:
    return "1 + " + " + ".join(f"CASE WHEN csri > quantile_cont(csri, {i}::DOUBLE / {k}) OVER (PARTITION BY date) THEN 1 ELSE 0 END" for i in range(1, k))


@register("csri_buckets", with_sql(*OBS, ("cb0", "SELECT date, csri, fwd_21 FROM obs WHERE csri IS NOT NULL AND fwd_21 IS NOT NULL"), ("cb1", "SELECT CASE WHEN median(n) >= 20 THEN 5 WHEN median(n) >= 9 THEN 3 ELSE 2 END AS n_buckets FROM (SELECT count(*) AS n FROM cb0 GROUP BY date) HAVING sum(n) >= 300"), ("cb2", f"SELECT *, CASE n_buckets WHEN 5 THEN {_bucket(5)} WHEN 3 THEN {_bucket(3)} ELSE {_bucket(2)} END AS bucket FROM cb0, cb1 WHERE (SELECT count(DISTINCT k.csri) FROM cb0 k WHERE k.date = cb0.date) >= n_buckets")) + f" SELECT bucket, n_buckets, {_SUM.format(x='fwd_21')} FROM cb2 GROUP BY ALL")
def csri_buckets(s, d):
    return _show(P.score_buckets(obs(s, d)), "n", "mean", "median", "sd", "hit", keep=("bucket", "n_buckets"))


@register("subperiods", with_sql(*EPS, ("sp", "SELECT *, row_number() OVER (ORDER BY start, ticker) AS r, count(*) OVER () AS n FROM eps WHERE fwd_21 IS NOT NULL"), ("sq", "SELECT *, greatest(1, ceil((r - 1) * CASE WHEN n < 80 THEN greatest(2, n // 40) ELSE 4 END / (n - 1)))::INT AS period FROM sp"), ("sr", f"SELECT period, min(start) AS f, max(start) AS t, count(*) AS episodes, count(*) FILTER (phase = '{BEST}') AS na, count(*) FILTER (phase = '{WORST}') AS nb, avg(fwd_21) FILTER (phase = '{BEST}') AS ma, avg(fwd_21) FILTER (phase = '{WORST}') AS mb FROM sq GROUP BY period"), ("ss", "SELECT *, CASE WHEN na >= 5 THEN ma END AS mean_a, CASE WHEN nb >= 5 THEN mb END AS mean_b FROM sr")) + f" SELECT period, f AS \"from\", t AS \"to\", episodes, na, nb, {rd('mean_a')}, {rd('mean_b')}, {rd('mean_a - mean_b', 'spread')} FROM ss")
def subperiods(s, d):
    return _show(P.subperiods(eps(s, d), BEST, WORST), "mean_a", "mean_b", "spread", keep=("period", "from", "to", "episodes", "na", "nb"))


@register("held_onset", with_sql(*EPS) + f" SELECT phase, held_n, {rd('held_mean')}, onset_n, {rd('onset_mean')} FROM (SELECT phase, count(fwd_21) AS held_n, avg(fwd_21) AS held_mean FROM obs GROUP BY phase) FULL JOIN (SELECT phase, count(fwd_21) AS onset_n, avg(fwd_21) AS onset_mean FROM eps GROUP BY phase) USING (phase)")
def held_onset(s, d):
    o = obs(s, d)
    return _show(P.held_and_onset(o, P.episodes(o)), "held_n", "held_mean", "onset_n", "onset_mean", keep=("phase",))


BOOK = [
    *OBS,
    ("p0", "SELECT date, ticker, csri, fwd_21, count(*) OVER (PARTITION BY date) AS m, row_number() OVER (PARTITION BY date ORDER BY csri DESC, ticker) AS hi, row_number() OVER (PARTITION BY date ORDER BY csri, ticker DESC) AS lo FROM obs WHERE csri IS NOT NULL AND fwd_21 IS NOT NULL"),
    ("p1", "SELECT greatest(1, CASE WHEN median(m) >= 20 THEN median(m) // 5 ELSE median(m) // 3 END)::INT AS side FROM (SELECT date, count(*) AS m FROM p0 GROUP BY date) HAVING sum(m) >= 200"),
    ("p2", "SELECT date, dense_rank() OVER (ORDER BY date) AS i, ticker, fwd_21 AS y, CASE WHEN hi <= least(side, m) THEN 1.0::DOUBLE / least(side, m) ELSE 0 END - CASE WHEN lo <= least(side, m) THEN 1.0::DOUBLE / least(side, m) ELSE 0 END AS w FROM p0, p1 WHERE hi <= least(side, m) OR lo <= least(side, m)"),
    ("p3", "SELECT coalesce(a.i, b.i + 1) AS i, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS t FROM p2 a FULL JOIN p2 b ON a.i = b.i + 1 AND a.ticker = b.ticker GROUP BY ALL"),
    ("p4", "SELECT date, sum(w * y) / 2 AS gross, CASE WHEN i = 1 THEN 2.0 ELSE any_value(t) END::DOUBLE AS turnover FROM p2 JOIN p3 USING (i) GROUP BY date, i"),
    ("pf", "SELECT *, gross - turnover * 5 / 100 AS net FROM p4 WHERE (SELECT count(*) FROM p4) >= 10"),
]


@register("portfolio", with_sql(*BOOK) + f" SELECT date, {rd('gross')}, {rd('turnover')}, {rd('net')} FROM pf")
def portfolio(s, d):
    return _show(P.portfolio(obs(s, d)), "gross", "turnover", "net", keep=("date",))


_PERF = ("mean", "sd", "gross_annualised", "net_annualised", "volatility", "sharpe", "hit", "turnover", "cost_drag", "max_drawdown")


@register("performance", with_sql(*BOOK, ("pe", "SELECT *, exp(sum(ln(nullif(abs(1 + net / 100), 0))) OVER (ORDER BY date)) * (1 - 2 * (sum(CASE WHEN 1 + net / 100 < 0 THEN 1 ELSE 0 END) OVER (ORDER BY date) % 2)) AS e FROM pf"), ("pd", "SELECT *, e / max(e) OVER (ORDER BY date) - 1 AS dd FROM pe"), ("pg", "SELECT count(net) AS periods, avg(net) AS mean, stddev_samp(net) AS sd, avg(gross) * 12 AS gross_annualised, avg(net) * 12 AS net_annualised, stddev_samp(net) * sqrt(12) AS volatility, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END) * 100 AS hit, avg(turnover) AS turnover, min(dd) * 100 AS max_drawdown, avg(gross) * 12 - avg(net) * 12 AS cost_drag, avg(net) * 12 / nullif(stddev_samp(net) * sqrt(12), 0) AS sharpe FROM pd")) + " SELECT periods, " + ", ".join(rd(c) for c in _PERF) + ", net_annualised > 0 AS survives_costs FROM pg")
def performance(s, d):
    return _show(P.performance(P.portfolio(obs(s, d))), "periods", *_PERF, "survives_costs")


@register("costed_portfolio", with_sql(*[x for x in _STUDY if isinstance(x, str) or x[0] not in ("t0", "t1", "t2", "t3", "t4", "m1", "m2", "c6")]) + f" SELECT date, {rd('gross')}, {rd('churn')}, {rd('net')} FROM cb WHERE model = 'csri'")
def costed_portfolio(s, d):
    return _show(P.costed_portfolio(obs(s, d)), "gross", "churn", "net", keep=("date",))


_ORDER = {"CONFIRMED_BREAKOUT": 0, "STEALTH_ACCUMULATION": 1, "NEUTRAL": 2, "DISTRIBUTION": 3, "CAPITAL_FLIGHT": 4}


@register("monotonicity", with_sql(*EPS, ("mo", "SELECT phase, avg(fwd_21) AS mean, count(fwd_21) AS n FROM eps GROUP BY phase HAVING count(fwd_21) >= 8"), ("mn", "SELECT rank() OVER (ORDER BY mean) AS b, rank() OVER (ORDER BY CASE phase " + " ".join(f"WHEN '{p}' THEN {-k}" for p, k in _ORDER.items()) + " END) AS a FROM mo")) + f" SELECT CASE WHEN count(*) >= 3 THEN {rd('corr(a, b)').removesuffix(' AS corr(a, b)')} END AS rho, count(*) AS phases FROM mn")
def monotonicity(s, d):
    return _show(P.monotonicity(eps(s, d), _ORDER), "rho", "phases")


@register("bh_adjust", with_sql(*EPS, ("t0", "SELECT ticker, round(abs(avg(CASE WHEN fwd_21 > 0 THEN 1.0 ELSE 0 END) - 0.5), 6) AS p FROM eps GROUP BY ticker"), ("t1", "SELECT *, row_number() OVER (ORDER BY p, ticker) AS k, count(*) OVER () AS m FROM t0"), ("t2", "SELECT *, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS q FROM t1")) + f" SELECT ticker, {rd('p')}, {rd('least(1, q)', 'q')} FROM t2")
def bh_adjust(s, d):
    t = eps(s, d).groupBy("ticker").agg(F.round(F.abs(F.avg(flag(F.col("fwd_21") > 0)) - 0.5), 6).alias("p"))
    return _show(P.bh_adjust(t), "p", "q", keep=("ticker",))


_Q = ", ".join(f"round(quantile_cont(fwd_21, {v / 100}), 6) + 0.0 AS p{v}" for v in (1, 5, 25, 50, 75, 95, 99))


@register("describe", with_sql(*OBS, ("de", "SELECT phase, fwd_21, avg(fwd_21) OVER (PARTITION BY phase) AS m FROM obs WHERE fwd_21 IS NOT NULL")) + f" SELECT phase, count(*) AS n, {rd('avg(fwd_21)', 'mean')}, {rd('stddev_samp(fwd_21)', 'sd')}, {rd('avg((fwd_21 - m) ** 3) / nullif(avg((fwd_21 - m) ** 2) ** 1.5, 0)', 'skew', 4)}, {rd('avg((fwd_21 - m) ** 4) / nullif(avg((fwd_21 - m) ** 2) ** 2, 0) - 3', 'excess_kurtosis', 4)}, {rd('min(fwd_21)', 'low')}, {rd('max(fwd_21)', 'high')}, {_Q} FROM de GROUP BY phase")
def describe(s, d):
    t = P.describe(obs(s, d), "phase", value="fwd_21")
    nan = lambda c: F.when(~F.isnan(c), F.col(c))
    t = t.withColumns({c: tidy(nan(c), 4) for c in ("skew", "excess_kurtosis")})
    return _show(t, "n", "mean", "sd", "skew", "excess_kurtosis", "low", "high", "p1", "p5", "p25", "p50", "p75", "p95", "p99", keep=("phase",))


TWO = [
    *OBS,
    ("g0", f"SELECT phase, fwd_21 AS x, rank() OVER (ORDER BY fwd_21) + (count(*) OVER (PARTITION BY fwd_21) - 1) / 2.0 AS r FROM obs WHERE phase IN ('{BEST}', '{WORST}') AND fwd_21 IS NOT NULL"),
    ("g1", f"SELECT sum(CASE WHEN phase = '{BEST}' THEN 1.0 ELSE 0 END)::DOUBLE AS na, sum(CASE WHEN phase = '{WORST}' THEN 1.0 ELSE 0 END)::DOUBLE AS nb, avg(x) FILTER (phase = '{BEST}') AS ma, avg(x) FILTER (phase = '{WORST}') AS mb, var_samp(x) FILTER (phase = '{BEST}') AS va, var_samp(x) FILTER (phase = '{WORST}') AS vb, sum(r) FILTER (phase = '{BEST}') AS ra, (SELECT sum(t * t * t - t) FROM (SELECT count(*) AS t FROM g0 GROUP BY x)) AS ts FROM g0"),
    ("g2", "SELECT *, na + nb AS n, (ma - mb) / nullif(sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 0) AS d, ra - na * (na + 1) / 2 AS u FROM g1"),
]


@register("effect_size", with_sql(*TWO) + f" SELECT na, nb, {rd('ma')}, {rd('mb')}, {rd('d', 'cohen_d')}, {rd('d * (1 - 3 / (4 * n - 9))', 'hedges_g')}, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude FROM g2")
def effect_size(s, d):
    return _show(P.two_groups(obs(s, d), "phase", BEST, WORST, "fwd_21"), "na", "nb", "ma", "mb", "cohen_d", "hedges_g", "magnitude")


@register("mann_whitney", with_sql(*TWO) + f" SELECT na, nb, {rd('u')}, {rd('u / (na * nb)', 'auc')}, {rd('(u - na * nb / 2) / nullif(sqrt(na * nb / 12 * ((n + 1) - ts / (n * (n - 1)))), 0)', 'z')} FROM g2")
def mann_whitney(s, d):
    return _show(P.two_groups(obs(s, d), "phase", BEST, WORST, "fwd_21"), "na", "nb", "u", "auc", "z")


@register("outlier_influence", with_sql(*OBS, ("o0", "SELECT phase, fwd_21 AS x, row_number() OVER (PARTITION BY phase ORDER BY fwd_21) AS r, count(*) OVER (PARTITION BY phase) AS n FROM obs WHERE fwd_21 IS NOT NULL"), ("o1", "SELECT *, greatest(1, floor(n * 0.05)) AS k FROM o0"), ("o2", "SELECT *, r > k AND r <= n - k AS inside, min(x) FILTER (r > k AND r <= n - k) OVER (PARTITION BY phase) AS lo, max(x) FILTER (r > k AND r <= n - k) OVER (PARTITION BY phase) AS hi FROM o1"), ("o3", "SELECT phase, count(*) AS n, avg(x) AS mean, avg(x) FILTER (inside) AS trimmed_mean, avg(least(greatest(x, lo), hi)) AS winsorised_mean, (sum(x) - max_by(x, abs(x))) / nullif(count(*) - 1, 0) AS without_extreme, stddev_samp(x) / sqrt(count(*)) AS se FROM o2 GROUP BY phase")) + f" SELECT phase, n, {rd('mean')}, {rd('trimmed_mean')}, {rd('winsorised_mean')}, {rd('without_extreme')}, {rd('se')}, abs(mean - trimmed_mean) > se AS outlier_driven FROM o3")
def outlier_influence(s, d):
    return _show(P.trimmed(obs(s, d), "phase", value="fwd_21"), "n", "mean", "trimmed_mean", "winsorised_mean", "without_extreme", "se", "outlier_driven", keep=("phase",))


@register("segment_stability", with_sql(*OBS, ("s_0", f"SELECT phase, fwd_21 AS y, least(4, (row_number() OVER (ORDER BY date, ticker) - 1) * 4 // count(*) OVER () + 1) AS block FROM obs WHERE phase IN ('{BEST}', '{WORST}') AND fwd_21 IS NOT NULL"), ("s_1", f"SELECT block, avg(y) FILTER (phase = '{BEST}') - avg(y) FILTER (phase = '{WORST}') AS spread FROM s_0 GROUP BY block HAVING count(*) FILTER (phase = '{BEST}') >= 15 AND count(*) FILTER (phase = '{WORST}') >= 15"), ("s_2", f"SELECT avg(y) FILTER (phase = '{BEST}') - avg(y) FILTER (phase = '{WORST}') AS overall FROM s_0"), ("s_3", "SELECT overall, count(*) AS blocks, avg(CASE WHEN sign(spread) = sign(overall) THEN 1.0 ELSE 0 END) AS agreement FROM s_1, s_2 GROUP BY overall")) + f" SELECT {rd('overall')}, blocks, {rd('agreement')}, CASE WHEN agreement >= 0.8 THEN 'STABLE' WHEN agreement >= 0.5 THEN 'MIXED' ELSE 'UNSTABLE' END AS verdict FROM s_3")
def segment_stability(s, d):
    return _show(P.segment_stability(obs(s, d), BEST, WORST), "overall", "blocks", "agreement", "verdict")


def _red_sql() -> str:
    """One SELECT a check over the panel (obs), its episodes (eps) and the phases (rp)."""
    one = lambda name, value, raised: f"SELECT '{name}' AS \"check\", ({value})::DOUBLE AS value, {raised} AS raised"
    out = [one("empty", "count(*)", "count(*) = 0") + " FROM obs"]
    case = " ".join(f"WHEN '{p}' THEN {k}" for k, p in enumerate(P.IN_ORDER))
    for h in (21, 63):
        out.append(one(f"missing fwd_{h}", f"avg(CASE WHEN fwd_{h} IS NULL THEN 1.0 ELSE 0 END)", f"avg(CASE WHEN fwd_{h} IS NULL THEN 1.0 ELSE 0 END) > 0.02") + " FROM obs")
        out.append(one(f"hit rate at boundary {h}", f"count(*) FILTER (c{h} >= 10 AND h{h} IN (0, 1))", f"count(*) FILTER (c{h} >= 10 AND h{h} IN (0, 1)) > 0") + " FROM rp")
        out.append(one(f"identical means {h}", f"count(DISTINCT round(m{h}, 6))", f"count(m{h}) >= 3 AND count(DISTINCT round(m{h}, 6)) = 1") + " FROM rp")
        gaps = f"(SELECT m{h} - lag(m{h}) OVER (ORDER BY CASE phase {case} END) AS g FROM rp WHERE m{h} IS NOT NULL)"
        even = "stddev_pop(g) / (abs(avg(g)) + 1e-9)"
        out.append(one(f"too clean {h}", f"CASE WHEN count(g) >= 3 THEN {even} END", f"coalesce(count(g) >= 3 AND max(g) < 0 AND {even} < 0.10, false)") + f" FROM {gaps}")
    out += [one(f"constant {z}", f"stddev_samp({z})", f"coalesce(count({z}) > 50 AND stddev_samp({z}) < 1e-6, false)") + " FROM obs" for z in sorted(Z)]
    out.append(one("concentration", "max(n) / sum(n)", "max(n) / sum(n) > 0.85") + " FROM rp")
    out.append(one("few phases", "count(*)", "count(*) BETWEEN 1 AND 2") + " FROM rp")
    out.append(one("duplicates", "sum(n - 1)", "sum(n - 1) > 0") + " FROM (SELECT count(*) AS n FROM obs GROUP BY date, ticker)")
    out.append(one("episodes of one observation", "median(length_obs)", "median(length_obs) <= 1") + " FROM eps")
    return " UNION ALL ".join(out)


@register("red_flags", with_sql(*EPS, ("rp", "SELECT phase, count(*) AS n, " + ", ".join(f"count(fwd_{h}) AS c{h}, avg(fwd_{h}) AS m{h}, avg(CASE WHEN fwd_{h} > 0 THEN 1.0 WHEN fwd_{h} IS NOT NULL THEN 0 END) AS h{h}" for h in (21, 63)) + " FROM eps GROUP BY phase"), ("rc", _red_sql())) + ' SELECT "check", round(value, 6) + 0.0 AS value, raised FROM rc')
def red_flags(s, d):
    o = obs(s, d).select("date", "ticker", "tier", "phase", "csri", *[f"fwd_{h}" for h in P.HORIZONS], *Z)
    return _show(P.red_flags(o, P.episodes(o)), "value", "raised", keep=("check",))


@register("ols_check", with_sql(*OBS) + f" SELECT {rd(f'''avg(fwd_21) FILTER (phase = '{BEST}') - avg(fwd_21) FILTER (phase = '{WORST}')''', 'difference')}, {rd(f'''regr_slope(fwd_21, CASE WHEN phase = '{BEST}' THEN 1.0 ELSE 0 END)''', 'slope')}, count(*) AS n FROM obs WHERE phase IN ('{BEST}', '{WORST}') AND fwd_21 IS NOT NULL")
def ols_check(s, d):
    return _show(P.ols_check(obs(s, d), BEST, WORST), "difference", "slope", "n")


@register("concordance", with_sql(*OBS, ("k0", "SELECT date, ticker, csri AS x, fwd_21 AS y FROM obs WHERE csri IS NOT NULL AND fwd_21 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY date) >= 3")) + f" SELECT count(*) AS pairs, {rd('avg(CASE WHEN sign(a.x - b.x) = sign(a.y - b.y) THEN 1.0 ELSE 0 END) * 100', 'concordant')} FROM k0 a JOIN k0 b ON a.date = b.date AND a.ticker < b.ticker AND a.x <> b.x AND a.y <> b.y")
def concordance(s, d):
    return _show(P.concordance(obs(s, d)), "pairs", "concordant")


@register("embargo_split", with_sql(*OBS, ("ed", "SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM obs)"), ("ec", "SELECT date AS cut FROM ed WHERE i = floor(n * 0.7) + 1")) + " SELECT CASE WHEN date >= cut THEN 'test' WHEN date < cut - 31 THEN 'train' ELSE 'embargo' END AS part, count(*) AS n FROM obs, ec GROUP BY ALL")
def embargo_split(s, d):
    return P.embargo_split(obs(s, d)).groupBy("part").agg(F.count("*").alias("n"))


@register("bootstrap_mean")
def bootstrap_mean(s, d):
    return R.bootstrap_mean(obs(s, d).withColumn("x", F.col("fwd_21")), "phase", order=("date", "ticker"))


@register("spread_test")
def spread_test(s, d):
    return R.spread_test(eps(s, d), BEST, WORST)


@register("perm_null")
def perm_null(s, d):
    return R.permutation_null(obs(s, d), BEST, WORST)


@register("fit_weights")
def fit_weights(s, d):
    return R.fit_weights(obs(s, d), Z)


@register("power_analysis")
def power_analysis(s, d):
    """Power of the spread at its observed size, from one row of aggregates."""
    r = P.two_groups(obs(s, d), "phase", BEST, WORST, "fwd_21").first()
    sd = abs((r["ma"] - r["mb"]) / r["cohen_d"]) if r and r["cohen_d"] else 0.0
    p = R.power_analysis(int(r["na"]) if r else 0, int(r["nb"]) if r else 0, sd, r["ma"] - r["mb"] if r and r["ma"] is not None and r["mb"] is not None else 0.0)
    return s.createDataFrame([Row(se=p["se"], mde=p["mde"], power=p["power"], needed=p["needed"])], "se double, mde double, power double, needed long")


@register("evaluate")
def evaluate(s, d):
    """The verdict over the whole panel, one row: what the tests found, the checks passed, and what speaks against it."""
    kept = table(obs(s, d), "panel")
    v = R.evaluate(kept, table(P.episodes(kept), "episodes"))
    names = ("verdict", "confidence", "passed", "failed", "spread_verdict", "permutation_p", "rho", "csri_ic", "momentum_ic", "cohen_d", "power", "stability", "net_mean", "episodes", "dates")
    row = Row(**{n: v.get(n) for n in names}, kills=", ".join(v["kills"]), underpowered=", ".join(v["underpowered"]), **{n: ", ".join(v[n]) for n in ("red_flags", "signals", "blocking", "caveats")})
    kinds = "verdict string, confidence string, passed int, failed int, spread_verdict string, permutation_p double, rho double, csri_ic double, momentum_ic double, cohen_d double, power double, stability string, net_mean double, episodes long, dates long, kills string, underpowered string, red_flags string, signals string, blocking string, caveats string"
    return s.createDataFrame([row], kinds)


@register("alerts")
def alerts(s, d):
    """Flow columns are null for tickers without trades."""
    f = I.stages(crossed(score_frame(s, d))).join(flow_columns(s, d), ["ticker", "session"], "left")
    return A.alerts(f.withColumn("flags", X.flags()))


@register("busday_count", "SELECT o_orderkey, (SELECT count(*) FROM range(o_orderdate::DATE, o_orderdate::DATE + (o_custkey % 60)::INT, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6)::BIGINT AS days FROM orders")
def busday_count(s, d):
    o = V.read(s, d, "orders").withColumn("a", F.col("o_orderdate").cast("date")).withColumn("b", F.date_add("a", (F.col("o_custkey") % 60).cast("int")))
    return o.select("o_orderkey", A.weekdays_between(F.col("a"), F.col("b")).cast("long").alias("days"))


