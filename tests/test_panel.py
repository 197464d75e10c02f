"""Statistics on panels with known answers, scores' rules, and the registry."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidegauge.operators import cross_section as X
from tidegauge.operators import panel as P
from tidegauge.operators import resampling as R

PHASES = ("CONFIRMED_BREAKOUT", "CAPITAL_FLIGHT", "NEUTRAL")
OBS = "date date, ticker string, tier int, phase string, csri double, fwd_5 double, fwd_21 double, fwd_63 double, z_a double, z_b double"


def panel(spark, dates=50, names=6, seed=1, shift=0.0):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(dates):
        for j in range(names):
            phase = PHASES[(i + j) % 3]
            y = float(r.normal()) + (shift if phase == PHASES[0] else 0)
            rows.append((date(2020, 1, 6) + timedelta(weeks=i), f"T{j}", 1, phase, float(r.normal()), y, y, y, float(r.normal()), float(r.normal()) if r.random() > 0.4 else None))
    return spark.createDataFrame(rows, OBS)


def values(spark, a, b):
    rows = [("a", float(x)) for x in a] + [("b", float(x)) for x in b]
    return spark.createDataFrame(rows, "g string, x double")


def test_effect_of_one_deviation(spark):
    r = np.random.default_rng(3)
    e = P.two_groups(values(spark, r.normal(1, 1, 400), r.normal(0, 1, 400)), "g", "a", "b").first()
    assert e["cohen_d"] == pytest.approx(1.0, abs=0.15) and e["auc"] == pytest.approx(0.76, abs=0.05) and e["z"] > 8 and e["magnitude"] == "large"


def test_rank_test_against_all_pairs(spark):
    a, b = [1, 2, 2, 5], [2, 3, 1]
    e = P.two_groups(values(spark, a, b), "g", "a", "b").first()
    assert e["u"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_outliers(spark):
    r = np.random.default_rng(5)
    base = [float(x) for x in r.normal(0, 1, 60)]
    rows = [("plain", x) for x in base] + [("spiked", x) for x in [*base, 60.0, 55.0, 70.0]]
    got = {x["g"]: x["outlier_driven"] for x in P.trimmed(spark.createDataFrame(rows, "g string, x double"), "g").collect()}
    assert got == {"plain": False, "spiked": True}


def raised(o, e=None):
    return [r["check"] for r in P.red_flags(o, P.episodes(o) if e is None else e).collect() if r["raised"]]


def test_red_flags(spark):
    """A clean panel has none but short episodes (phases rotate at every date here); each fault raises its own."""
    o = panel(spark)
    short = "episodes of one observation"
    assert raised(o) == [short]
    assert raised(o.union(o.limit(5)), P.episodes(o)) == ["duplicates", short]
    one = raised(o.withColumn("phase", F.lit("NEUTRAL")))
    assert "concentration" in one and "few phases" in one and short not in one
    assert "constant z_a" in raised(o.withColumn("z_a", F.lit(1.0)))
    assert "missing fwd_63" in raised(o.withColumn("fwd_63", F.when(F.col("ticker") != "T0", F.col("fwd_63"))))
    assert "hit rate at boundary 21" in raised(o.withColumn("fwd_21", F.abs("fwd_21") + 0.1))
    assert "identical means 21" in raised(o.withColumn("fwd_21", F.lit(1.0)))
    steps = F.element_at(F.create_map(*[x for k, p in enumerate(("CONFIRMED_BREAKOUT", "NEUTRAL", "CAPITAL_FLIGHT")) for x in (F.lit(p), F.lit(3.0 - k))]), F.col("phase"))
    four = o.withColumn("fwd_21", F.when((F.col("ticker") == "T5"), 0.0).otherwise(steps)).withColumn("phase", F.when(F.col("ticker") == "T5", "DISTRIBUTION").otherwise(F.col("phase")))
    assert "too clean 21" not in raised(four)
    even = four.withColumn("fwd_21", F.element_at(F.create_map(*[x for k, p in enumerate(P.IN_ORDER) if p != "STEALTH_ACCUMULATION" for x in (F.lit(p), F.lit(float(-k if k else -1.0)))]), F.col("phase")))
    assert "too clean 21" in raised(even)
    assert raised(o.limit(0)) == ["empty"]


@pytest.mark.parametrize(("names", "buckets"), [(29, 5), (11, 3), (5, 2)])
def test_buckets_follow_the_cross_section(spark, names, buckets):
    assert P.score_buckets(panel(spark, 60, names)).count() == buckets
    assert P.score_buckets(panel(spark, 2, names)).count() == 0


def test_episodes_and_transitions(spark):
    rows = [(date(2020, 1, 6) + timedelta(weeks=i), "A", 1, p, float(i), 0.0, float(i), 0.0, 0.0, 0.0) for i, p in enumerate("xxyyyx")]
    e = P.episodes(spark.createDataFrame(rows, OBS))
    got = [(r["phase"], r["length_obs"], r["csri"]) for r in e.orderBy("start").collect()]
    assert got == [("x", 2, 0.0), ("y", 3, 2.0), ("x", 1, 5.0)]
    assert {(r["from_phase"], r["to_phase"]): r["pct"] for r in P.transitions(e).collect()} == {("x", "y"): 100.0, ("y", "x"): 100.0}


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    got = [r["q"] for r in P.bh_adjust(spark.createDataFrame([(x,) for x in p], "p double")).orderBy("p").collect()]
    assert got == pytest.approx([0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5])


def book(spark, dates=40, names=6, flip=True):
    rows = [(date(2020, 1, 6) + timedelta(weeks=i), f"T{j}", 1, "x", float(-j if flip and i % 2 else j), 0.0, float(j), 0.0, 0.0, 0.0) for i in range(dates) for j in range(names)]
    return spark.createDataFrame(rows, OBS)


def test_portfolio(spark):
    """Two of six names a side: a book that reverses trades four times its side, one that stands trades nothing; a half of each spread counts."""
    got = P.portfolio(book(spark)).orderBy("date").collect()
    assert [r["turnover"] for r in got] == pytest.approx([2.0] + [4.0] * 39) and [r["gross"] for r in got] == pytest.approx([2.0, -2.0] * 20)
    assert [r["net"] for r in got[:2]] == pytest.approx([2.0 - 0.1, -2.0 - 0.2])
    still = P.portfolio(book(spark, flip=False))
    assert [r["turnover"] for r in still.orderBy("date").collect()] == pytest.approx([2.0] + [0.0] * 39)
    assert P.portfolio(book(spark, 30)).count() == 0 and P.portfolio(book(spark, 9, 40)).count() == 0  # too few rows, too few dates
    p = P.performance(still).first()
    assert p["max_drawdown"] == pytest.approx(0.0) and p["net_annualised"] == pytest.approx(12 * (2.0 - 0.1 / 40)) and p["hit"] == 100 and p["survives_costs"]
    fall = spark.createDataFrame([(date(2020, 1, 1), -10.0, -10.0, 1.0), (date(2020, 2, 1), 5.0, 5.0, 1.0), (date(2020, 3, 1), -50.0, -50.0, 1.0)], "date date, gross double, net double, turnover double")
    assert P.performance(fall).first()["max_drawdown"] == pytest.approx(-50.0)  # from the highest point so far, not from the start


def test_costed_portfolio(spark):
    got = P.costed_portfolio(book(spark)).orderBy("date").collect()
    assert [r["churn"] for r in got] == [1.0] + [0.0] * 39  # the same two names change sides
    assert [r["gross"] for r in got[:2]] == pytest.approx([2.5, -2.5]) and got[0]["net"] == pytest.approx(2.5 - 0.05)
    s = P.book_summary(P.costed_portfolio(book(spark, flip=False))).first()
    assert s["rebalances"] == 40 and s["net_ann"] == pytest.approx(12 * (2.5 - 0.05 / 40))


def test_subperiods_shrink_with_the_sample(spark):
    e = P.episodes(panel(spark, 60, 8))
    assert P.subperiods(e).count() == 4 and P.subperiods(e.orderBy("start", "ticker").limit(60)).count() == 2
    r = P.subperiods(e).orderBy("period").first()
    assert r["episodes"] in (120, 121) and r["spread"] == pytest.approx(r["mean_a"] - r["mean_b"])


def test_observations_take_the_last_bar_up_to_the_date(spark):
    """T1 has no bar on the rebalance date: its last one stands for it, with its own sessions ahead."""
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(20)]
    bench = spark.createDataFrame([(d, 100.0) for d in days], "session date, close double")
    rows = [(f"T{j}", d, float(100 + i * (j + 1)), i + 1) for j in range(3) for i, d in enumerate(days) if not (j == 1 and i == 10)]
    bars = spark.createDataFrame(rows, "ticker string, session date, close double, n_bars int")
    o = P.observations(bars, bench, step=5, warmup=5, horizons=(2,), least_bars=1, least_names=1)
    got = {(r["ticker"], r["date"]): r["fwd_2"] for r in o.collect()}
    assert {d for _, d in got} == {days[5], days[10], days[15]} and len(got) == 9
    assert got["T0", days[10]] == pytest.approx((112 / 110 - 1) * 100) and got["T1", days[10]] == pytest.approx((124 / 118 - 1) * 100)


def test_study_of_models(spark):
    """A score that is the return wins on every count; noise doesn't."""
    o = panel(spark, 60, 10).withColumns({"fwd_10": F.col("fwd_21"), "fwd_42": F.col("fwd_21")})
    got = {r["model"]: r for r in P.model_study(o, {"base": F.col("z_a"), "even": F.col("csri"), "oracle": F.col("fwd_21")}, "base", "even").collect()}
    w = got["oracle"]
    assert w["adopt"] and w["ic_holdout"] == pytest.approx(1.0) and w["positive"] == 5 and w["sign_stable"] and not got["base"]["adopt"] and not got["base"]["sign_stable"]


def test_missing_parts_leave_their_weight_to_the_others(spark):
    f = spark.createDataFrame([(1.0, None), (1.0, 3.0), (None, None)], "a double, b double")
    assert [r[0] for r in f.select(P.weighted_score({"a": 0.25, "b": 0.75})).collect()] == [1.0, 2.5, None]


def test_bootstrap_is_repeatable_and_calibrated(spark):
    o = panel(spark, 60, 6).withColumn("x", F.col("fwd_21"))
    a, b = (sorted(map(tuple, R.bootstrap_mean(o.repartition(n), "phase", order=("date", "ticker"), reps=200).collect())) for n in (1, 7))
    assert [r[:2] for r in a] == [r[:2] for r in b] and all(x[2:] == pytest.approx(y[2:]) for x, y in zip(a, b, strict=True))
    assert all(r[3] < r[2] < r[4] for r in a)


def test_spread_and_permutation(spark):
    strong, none = panel(spark, 60, 6, shift=2.0), panel(spark, 60, 6)
    s = R.spread_test(P.episodes(strong), PHASES[0], PHASES[1], reps=200).first()
    assert s["verdict"] == "POSITIVE" and s["p"] < 0.05
    assert R.permutation_null(strong, PHASES[0], PHASES[1], reps=100).first()["p"] < 0.05
    assert R.permutation_null(none, PHASES[0], PHASES[1], reps=100).first()["p"] > 0.05


def test_weights_and_evaluation(spark):
    o = panel(spark, 60, 8, shift=2.0).withColumn("z_a", F.col("fwd_21")).withColumn("mom_12_1", F.col("z_b"))
    best = R.fit_weights(o, ("z_a", "z_b"), draws=20).where("place = 1").first()
    assert best["w_z_a"] > 0.5 and best["test"] > 0.5
    v = R.evaluate(o, P.episodes(o))
    # the spread is there, but 60 dates are too few to conclude anything
    assert (v["spread_verdict"], v["verdict"], v["dates"]) == ("POSITIVE", "UNDERPOWERED", 60) and not v["kills"]


def test_shuffles_of_phases_need_no_join(spark):
    """A join of all replicates with each other is planned by the panel's size, and so broadcast through the driver."""
    o = panel(spark, 20, 6)
    df = R.permutation_null(o, PHASES[0], PHASES[1], reps=50)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    y = {p: [r["fwd_21"] for r in o.where(F.col("phase") == p).collect()] for p in PHASES}
    got = df.first()
    assert got["spread"] == pytest.approx(np.mean(y[PHASES[0]]) - np.mean(y[PHASES[1]])) and 0 < got["p"] <= 1
    shifted = R.permutation_null(panel(spark, 20, 6, shift=3.0), PHASES[0], PHASES[1], reps=50).first()
    assert shifted["spread"] == pytest.approx(got["spread"] + 3) and shifted["p"] == 0


CLEAN = {"verdict": "PASS", "kills": [], "signals": [], "red_flags": {}, "outlier_driven": False, "skew": 0.1, "excess_kurtosis": 0.0, "stability": "STABLE"}


@pytest.mark.parametrize(
    ("facts", "level", "blocking", "caveats"),
    [
        ({}, "Ready to share", [], []),
        ({"stability": None, "outlier_driven": None, "skew": float("nan"), "excess_kurtosis": None}, "Ready to share", [], []),
        ({"red_flags": {"concentration": "medium"}, "skew": -1.0}, "Share with noted caveats", [], ["concentration", "median rather than mean"]),
        ({"excess_kurtosis": 3.0}, "Share with noted caveats", [], ["median rather than mean"]),
        ({"stability": "MIXED"}, "Share with noted caveats", [], ["spread holds in about half of segments"]),
        ({"verdict": "UNDERPOWERED", "signals": ["few accumulations"]}, "Share with noted caveats", [], ["sample is underpowered", "few accumulations"]),
        ({"verdict": "KILL", "kills": ["spread is inverted"]}, "Share with noted caveats", [], ["spread is inverted"]),
        ({"red_flags": {"duplicates": "high"}}, "Needs revision", ["duplicates"], []),
        ({"outlier_driven": True}, "Needs revision", ["outliers drive the mean"], []),
        ({"stability": "UNSTABLE"}, "Needs revision", ["spread reverses across segments"], []),
    ],
)
def test_confidence(facts, level, blocking, caveats):
    assert R.confidence(CLEAN | facts) == {"confidence": level, "blocking": blocking, "caveats": caveats}


def test_outliers_block_a_finding(spark):
    """Eight of 160 breakouts at 60 move the mean by more than its error. Without them nothing blocks."""
    o = panel(spark, 60, 8, shift=2.0).withColumns({"mom_12_1": F.col("z_b"), "z_b": F.col("z_a")})  # no component dominates
    plain = R.evaluate(o, P.episodes(o))
    assert plain["outlier_driven"] is False and plain["blocking"] == [] and plain["confidence"] == "Share with noted caveats"
    assert plain["caveats"] == ["episodes of one observation", "sample is underpowered", *plain["signals"]] and plain["signals"] == ["no accumulation"] and plain["checks"]["accumulation"] is None
    o = o.withColumn("fwd_21", F.when((F.col("phase") == PHASES[0]) & (F.col("ticker") == "T0") & (F.col("date") < date(2020, 6, 18)), 60.0).otherwise(F.col("fwd_21")))
    assert o.where("fwd_21 = 60").count() == 8
    v = R.evaluate(o, P.episodes(o))
    assert v["outlier_driven"] is True and "outliers are material" in v["signals"] and "outliers drive the mean" in v["blocking"] and v["confidence"] == "Needs revision"
    assert "median rather than mean" in v["caveats"] and v["ways_agree"] is True


def test_evaluation_of_each_signal_at_its_horizon(spark):
    """Accumulation is judged 63 sessions ahead; power is that against the spread asked for, at the two phases' deviation."""
    o = panel(spark, 60, 8).withColumn("mom_12_1", F.col("z_b")).withColumn("phase", F.when(F.col("phase") == "NEUTRAL", "STEALTH_ACCUMULATION").otherwise(F.col("phase")))
    o = o.withColumn("fwd_63", F.when(F.col("phase") == "STEALTH_ACCUMULATION", F.abs("fwd_63") + 2).otherwise(F.col("fwd_63")))
    v = R.evaluate(o, P.episodes(o))
    assert v["checks"]["accumulation"] is True and v["accumulation_n"] == 160 and v["signals"] == []
    y = {p: np.array([r["fwd_21"] for r in o.where(F.col("phase") == p).collect()]) for p in PHASES[:2]}
    assert v["power"] == pytest.approx(R.power_analysis(160, 160, np.sqrt((y[PHASES[0]].var(ddof=1) + y[PHASES[1]].var(ddof=1)) / 2), 0.5)["power"])
    # with momentum on a few rows only there is nothing to compare it with
    few = o.withColumn("mom_12_1", F.when(F.col("date") < date(2020, 2, 1), F.col("csri")))
    assert R.evaluate(few, P.episodes(few))["checks"]["beats_momentum"] is None


def test_stability_of_onsets(spark):
    """Four blocks of 120 episodes: none turned, one, and three that one of 20 times the size outweighs."""
    o = panel(spark, 60, 8, shift=4.0)
    turned = lambda weeks, rest=1: P.episodes(o.withColumn("fwd_21", F.col("fwd_21") * F.when(F.col("date") < date(2020, 1, 6) + timedelta(weeks=weeks), -1).otherwise(rest)))
    got = [tuple(P.onset_stability(turned(*w), PHASES[0], PHASES[1]).first())[1:] for w in ((0,), (15,), (45, 20))]
    assert got == [(4, 4, "STABLE"), (4, 3, "MIXED"), (4, 1, "UNSTABLE")]
    assert P.onset_stability(turned(0).orderBy("start", "ticker").limit(60), PHASES[0], PHASES[1]).first()["verdict"] is None
    assert P.onset_stability(turned(0).where("false"), PHASES[0], PHASES[1]).first()["verdict"] is None


def test_severity_of_red_flags(spark):
    o = panel(spark)
    bad = o.union(o.limit(5)).withColumns({"z_a": F.lit(1.0), "z_b": 1 + F.col("z_a") * 1e-9})
    got = {r["check"]: r["severity"] for r in P.red_flags(bad, P.episodes(o)).where("raised").collect()}
    assert got == {"constant z_a": "high", "constant z_b": "medium", "duplicates": "high", "episodes of one observation": "medium"}


@pytest.mark.parametrize("missing", [PHASES[0], PHASES[1]])
def test_evaluation_without_one_of_the_phases(spark, missing):
    o = panel(spark, 12, 6).where(F.col("phase") != missing).withColumn("mom_12_1", F.col("z_b"))
    v = R.evaluate(o, P.episodes(o))
    assert (v["spread_verdict"], v["verdict"], v["permutation_p"], v["cohen_d"], v["power"]) == ("UNDERPOWERED", "UNDERPOWERED", None, None, None)


def test_resampling_of_nothing(spark):
    e = P.episodes(panel(spark, 12, 6)).where("false")
    assert tuple(R.spread_test(e, PHASES[0], PHASES[1], reps=20).first()) == (0, 0, None, None, None, None, "UNDERPOWERED")


def test_resampling_queries_run_the_full_number(monkeypatch):
    import inspect
    from unittest.mock import MagicMock

    from tidegauge.plans import t4

    monkeypatch.setattr(t4, "obs", MagicMock())
    monkeypatch.setattr(t4, "eps", MagicMock())
    for query, name, by, full in ((t4.bootstrap_mean, "bootstrap_mean", "reps", 5000), (t4.spread_test, "spread_test", "reps", 4000), (t4.perm_null, "permutation_null", "reps", 1000), (t4.fit_weights, "fit_weights", "draws", 4000)):
        signature, calls = inspect.signature(getattr(R, name)), []
        monkeypatch.setattr(R, name, lambda *a, calls=calls, **k: calls.append((a, k)))
        query(None, None)
        bound = signature.bind(*calls[0][0], **calls[0][1])
        bound.apply_defaults()
        assert bound.arguments[by] == signature.parameters[by].default == full


def test_power():
    p = R.power_analysis(64, 64, 1.0, 0.5)
    assert p["power"] == pytest.approx(0.807, abs=0.01) and p["needed"] == 63
    assert R.power_analysis(1, 5, 1.0, 0.5)["power"] is None


def test_verdicts():
    assert R.verdict({})["verdict"] == "UNDERPOWERED"
    assert R.verdict({"spread_verdict": "INVERTED"})["verdict"] == "KILL"
    assert R.verdict({"spread_verdict": "NO_EDGE", "power": 0.9})["verdict"] == "KILL"


def test_verdict_leaves_out_what_could_not_be_tested():
    enough = {"episodes": 500, "dates": 200}
    v = R.verdict(enough | {"flight_mean": -1.0, "in_order": True, "spread": 1.0, "spread_verdict": "POSITIVE", "permutation_p": 0.01, "dominance": 0.5})
    assert (v["verdict"], v["passed"], v["failed"], v["underpowered"]) == ("PASS", 5, 0, []) and v["checks"]["beats_momentum"] is None
    v = R.verdict(enough | {"spread_verdict": "NO_EDGE", "power": 0.4, "csri_ic": 0.0, "momentum_ic": 0.1})
    assert v["verdict"] == "UNDERPOWERED" and v["underpowered"] == ["spread", "momentum", "power"]
    assert R.verdict(enough | {"breakout_n": 0})["underpowered"] == []


@pytest.mark.parametrize(("row", "lenient", "strict"), [((1.0, 101.0, 0.1, 0.0, 50.0, None, "Leading"), "CONFIRMED_BREAKOUT", "NEUTRAL"), ((1.0, 99.0, -0.1, 0.0, 50.0, 70.0, "Weakening"), "DISTRIBUTION", "DISTRIBUTION"), ((-1.0, 101.0, 0.0, 0.0, 60.0, 45.0, "Improving"), "STEALTH_ACCUMULATION", "STEALTH_ACCUMULATION"), ((-1.0, 99.0, 0.0, 0.0, 60.0, 40.0, "Lagging"), "CAPITAL_FLIGHT", "CAPITAL_FLIGHT"), ((None, None, None, None, None, None, "Unknown"), "NEUTRAL", "NEUTRAL")])
def test_phase_rules(spark, row, lenient, strict):
    f = spark.createDataFrame([row], "mansfield_rs double, rs_mom double, cmf double, inst double, inst_pct double, breadth double, quadrant string")
    assert f.select(X.phase().alias("a"), X.phase(True).alias("b")).first() == (lenient, strict)


def test_momentum_score_is_centred_and_ranked(spark):
    f = spark.createDataFrame([(f"T{i}", 1, float(i), float(i * i) if i else None) for i in range(6)], "ticker string, tier int, mom_12_1 double, rs_mom double")
    got = X.vms(f).orderBy("vms_rank").collect()
    assert [r["ticker"] for r in got][0] == "T5" and [r["vms_rank"] for r in got] == [1, 2, 3, 4, 5, 6]
    assert abs(sum(r["vms"] for r in X.vms(f.where("rs_mom is not null")).collect())) < 1e-9


def test_registry_is_consistent():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90
