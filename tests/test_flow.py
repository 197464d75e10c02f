"""Order flow on twelve trades that can be added up by hand, alerts, streaming twins, and parsing."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import flow as FL
from tidegauge.operators import indicators as I
from tidegauge.operators import quality as Q
from tidegauge.streaming import alerts as A
from tidegauge.streaming import flow as SF

#: (exchange, size, price, trf_id)
TRADES = [
    (11, 100, 100, None), (11, 200, 101, None), (4, 1000, 101, None), (4, 15000, 102, 2), (4, 20000, 100, 2), (11, 2500, 102, None),
    (12, 300, 102, None), (4, 500, 102, 1), (11, 11000, 101, None), (11, 0, 101, None), (11, 100, 0, None), (4, 400, 101, 3),
]
SCHEMA = "ticker string, day date, ts timestamp, event_id long, exchange int, size double, price double, trf_id int"


def trades(spark, days=1):
    d0 = date(2024, 3, 1)
    rows = [("X", d0 + timedelta(days=k), datetime(2024, 3, 1) + timedelta(days=k, seconds=i), 100 * k + i, e, float(s), float(p), t) for k in range(days) for i, (e, s, p, t) in enumerate(TRADES)]
    return spark.createDataFrame(rows, SCHEMA)


def test_session_flow(spark):
    r = FL.session_flow(trades(spark), page_cap=12).first()
    assert (r["volume"], r["trades"], r["off_volume"], r["dark_volume"]) == (51000, 10, 36900, 35900)
    assert (r["block_count"], r["block_volume"], r["largest_print"], r["largest_notional"]) == (4, 48500, 20000, 2_000_000)
    assert r["off_share"] == pytest.approx(0.72353, abs=1e-5) and r["dark_share"] == pytest.approx(0.70392, abs=1e-5)
    assert r["block_share"] == pytest.approx(0.95098, abs=1e-5) and r["block_off_share"] == pytest.approx(35000 / 48500)
    assert (r["up_volume"], r["down_volume"]) == (17500, 31000) and r["block_direction"] == pytest.approx(-0.2784, abs=1e-4)
    assert not r["truncated"] and FL.session_flow(trades(spark), page_cap=10).first()["truncated"]


def test_multi_session(spark):
    same = FL.multi_session(FL.session_flow(trades(spark, 7))).first()
    assert same["sessions"] == 7 and same["off_share_trend"] == pytest.approx(0, abs=1e-12)
    assert FL.multi_session(FL.session_flow(trades(spark, 3))).first()["off_share_trend"] is None
    assert FL.multi_session(FL.session_flow(trades(spark, 2))).count() == 0


@pytest.mark.parametrize(("off", "dark", "way", "block", "same", "check"), [(0.025, 0.03, 0.4, 0.02, False, lambda x: x > 0.4), (-0.025, -0.03, -0.4, -0.02, False, lambda x: x < -0.4), (None, None, None, None, False, lambda x: x is None), (0.0, 0.0, None, 0.0, True, lambda x: x == 0)])
def test_flow_score(spark, off, dark, way, block, same, check):
    f = spark.createDataFrame([(off, dark, way, block, same)], "off_share_trend double, dark_share_trend double, block_direction double, block_share_trend double, dark_equals_off boolean")
    assert check(f.select(FL.flow_score().alias("s")).first()["s"])


def test_flow_panel_leaves_out_the_day_itself(spark):
    d = FL.session_flow(trades(spark, 7)).withColumn("off_share", F.dayofmonth("day").cast("double"))
    got = {r["day"].day: r["prior_off_share"] for r in FL.flow_panel(d, 5).collect()}
    assert got == {6: 3.0, 7: 4.0}


def row(d, phase="NEUTRAL", stage=1, quadrant="Leading", flags=()):
    return {"session": d, "phase": phase, "stage": stage, "quadrant": quadrant, "flags": list(flags)}


D = date(2024, 1, 1)


def test_alerts_fire_once():
    s, out = A.step(None, row(D, flags=["stage4"]))
    assert out == []  # a first row only seeds
    s, out = A.step(s, row(D, flags=["stage4"]))
    assert out == []
    s, out = A.step(s, row(A.next_weekday(D, 1), "CAPITAL_FLIGHT", flags=["stage4", "x"]))
    assert [(o["kind"], o["severity"]) for o in out] == [("phase", "high"), ("flag", "normal")]
    s, _ = A.step(s, row(A.next_weekday(D, 2), "NEUTRAL"))
    s, out = A.step(s, row(A.next_weekday(D, 10), "CAPITAL_FLIGHT", flags=["x"]))
    assert [o["kind"] for o in out] == ["flag"]  # the phase is still cooling down, the flag isn't
    s, _ = A.step(s, row(A.next_weekday(D, 11), "NEUTRAL"))
    s, out = A.step(s, row(A.next_weekday(D, 30), "CAPITAL_FLIGHT"))
    assert [o["kind"] for o in out] == ["phase"]
    s, out = A.step(s, row(A.next_weekday(D, 31), None, 0, "Unknown"))
    assert out == [] and s["phase"] is None


def test_broken_state_seeds_anew():
    assert A.load_state("{") is None and A.load_state('{"version": 99}') is None and A.load_state(None) is None


def test_weekdays(spark):
    days = [D + timedelta(days=k) for k in range(20)]
    f = spark.createDataFrame([(a, b) for a in days[:7] for b in days if b >= a], "a date, b date")
    for r in f.withColumn("n", A.weekdays_between(F.col("a"), F.col("b"))).collect():
        assert r["n"] == A.weekdays(r["a"], r["b"]) == sum((r["a"] + timedelta(days=k)).weekday() < 5 for k in range((r["b"] - r["a"]).days))


HISTORY = [(t, A.next_weekday(D, k), p, k % 3, q, ["x"] * (k % 2)) for t in "AB" for k, (p, q) in enumerate([("NEUTRAL", "Leading"), ("DISTRIBUTION", "Leading"), ("NEUTRAL", "Lagging"), ("CAPITAL_FLIGHT", "Lagging"), ("NEUTRAL", "Leading")])]
H = "ticker string, session date, phase string, stage int, quadrant string, flags array<string>"


def test_streamed_alerts_equal_the_batch(spark, tmp_path):
    f = spark.createDataFrame(HISTORY, H)
    want = sorted(map(tuple, A.alerts(f).collect()))
    for k in range(5):  # a batch for each session
        f.where(F.col("session") == A.next_weekday(D, k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(H).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = A.stream_alerts(s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sorted(map(tuple, spark.read.schema(A.SCHEMA).parquet(str(tmp_path / "out")).collect())) == want and want


def test_streamed_days_are_written_once(spark, tmp_path):
    trades(spark, 3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for k in (1, 2):
        SF.write_once(SF.daily_volume(s, "0 seconds"), str(tmp_path / "out"), str(tmp_path / f"c{k}")).awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len({r["day"] for r in got}) == len(got) >= 2 and {r["volume"] for r in got} == {51000.0}


def test_streamed_tick_direction(spark, tmp_path):
    trades(spark).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = SF.tick_direction(s).writeStream.format("memory").queryName("ticks").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = [r["dir"] for r in spark.table("ticks").orderBy("event_id").collect()]
    assert got == [0, 1, 0, 1, -1, 1, 0, 0, -1, 0]


def test_macro_parsers_agree(spark):
    csv = spark.createDataFrame([("DATE,WALCL",), ("2024-01-03,7000000",), ("2024-01-10,.",), ("2024-01-17,7010000",), ("2024-01-24,7020000",)], "value string")
    js = spark.createDataFrame([('{"observations":[{"date":"2024-01-03","value":"7000000"},{"date":"2024-01-10","value":"."},{"date":"2024-01-17","value":"7010000"},{"date":"2024-01-24","value":"7020000"}]}',), ("junk",)], "value string")
    a, b = (sorted(map(tuple, f.collect())) for f in (Q.parse_macro_csv(csv, "S"), Q.parse_macro_json(js, "S")))
    assert a == b and len(a) == 3 and a[-1][2] == 7_020_000


def test_cells(spark):
    want = {"+0.46%": 0.46, "−0.169%": -0.169, "$150M": 1.5e8, "$1.5B": 1.5e9, "820K": 8.2e5, "2,512": 2512, "1.14x": 1.14, "+1.5σ": 1.5, "2026-07-24": 20260724, "●●○": 2, "–": None, "": None, "text": None}
    f = spark.createDataFrame([(k,) for k in want], "cell string")
    for r in f.withColumn("n", Q.parse_cell()).collect():
        assert r["n"] == (pytest.approx(want[r["cell"]]) if want[r["cell"]] is not None else None), r["cell"]


def test_normalise_bars(spark):
    raw = spark.createDataFrame([("A", D, "1", "x", "1", "2", None, 1), ("A", D, "1", "2", "1", "3", "7", 2), ("B", D, "1", "1", "1", "nan", "1", 1), ("C", D, "1", "bad", "1", "4", None, 1)], "ticker string, session date, open string, high string, low string, close string, volume string, seq int")
    got = {r["ticker"]: r for r in Q.normalise_bars(raw).collect()}
    assert set(got) == {"A", "C"} and (got["A"]["close"], got["A"]["volume"]) == (3.0, 7.0) and (got["C"]["high"], got["C"]["volume"]) == (None, 0.0)


def test_alerts_query_sees_crossings_and_flow(spark, monkeypatch):
    from tidegauge.plans import t3, t4

    days = [D + timedelta(days=i) for i in range(40)]
    rows = [("A", x, -1.0 if i < 30 else 1.0, None, None, None, None, None, None, "NEUTRAL", "Leading") for i, x in enumerate(days)]
    bars = spark.createDataFrame(rows, "ticker string, session date, mansfield_rs double, volume_z double, block_intensity_z double, csri_delta double, absorption double, ret_21 double, sma_50 double, phase string, quadrant string")
    trades = spark.createDataFrame([("A", x, 0.1 if i < 35 else 0.5, 0.1 if i < 35 else 0.5, 0.5, 3e7, 10.0) for i, x in enumerate(days)], "ticker string, day date, dark_share double, off_share double, block_direction double, largest_notional double, largest_print double")
    monkeypatch.setattr(t4, "score_frame", lambda s, d: bars)
    monkeypatch.setattr(t3, "daily", lambda s, d: trades)
    monkeypatch.setattr(t4.I, "stages", lambda f: f.withColumn("stage", F.lit(1)))
    fired = {r["value"]: r["session"] for r in t4.alerts(spark, None).collect()}
    assert fired == {"mansfield_cross": days[30], "dark_pool": days[35], "off_exchange": days[35], "block_direction": days[2], "large_print": days[2]}


def test_all_kinds_of_flags_fire(spark):
    from tidegauge.operators import cross_section as X

    row = {"cross_up": True, "volume_z": 2.0, "block_intensity_z": 2.0, "csri_delta": 0.75, "absorption": 0.3, "ret_21": 0.02, "dark_trend": -0.02, "off_trend": 0.03, "block_direction": -0.2, "largest_notional": 25e6, "stage": 4}
    kinds = {"cross_up": "boolean", "stage": "int"}
    f = spark.createDataFrame([tuple(row.values()), tuple((row | {"csri_delta": -0.75}).values()), (False, *[None] * 9, 2)], ", ".join(f"{n} {kinds.get(n, 'double')}" for n in row))
    a, b, c = ([*r["k"]] for r in f.select(X.flags().alias("k")).collect())
    assert sorted({*a, *b}) == sorted(["mansfield_cross", "unusual_volume", "block_activity", "csri_surge", "csri_slump", "absorption", "dark_pool", "off_exchange", "block_direction", "large_print", "stage4"]) and c == []


def test_block_tags_go_by_dollars_and_counts(spark):
    names = "block_share_latest double, block_share_mean double, block_count_latest double, block_count_mean double, block_direction double, largest_notional double, adv double"
    rows = [(0.3, 0.3, 5.0, 5.0, 0.0, 1e6, 1e9), (0.1, 0.1, 10.0, 5.0, 0.0, 1e6, 1e9), (0.1, 0.1, 5.0, 5.0, 0.0, 5e7, 1e9), (0.16, 0.16, 5.0, 5.0, 0.4, 1e6, 1e8), (0.16, 0.16, 5.0, 5.0, 0.4, 1e6, 3e8)]
    got = [r["buckets"] for r in FL.block_buckets(spark.createDataFrame(rows, names)).collect()]
    assert got == [["Safe Bets"], ["Most Unusual"], ["Top Positions"], ["Longshots"], []]


def test_history_and_aggregate_payloads(spark):
    array = '[{"date":"2024-01-02","open":1,"high":2,"low":1,"close":"1.5","volume":null},{"date":"2024-01-02","open":1,"high":2,"low":1,"close":1.75,"volume":7},{"open":3,"close":3}]'
    rows = [("a", array), ("b", '{"historical":[{"date":"2024-01-03","close":2.5}],"symbol":"B"}'), ("c", "not json"), ("d", None), ("e", "[]"), ("f", '{"historical":[{"date":"2024-01-03","close":"x"}]}')]
    got = Q.normalise_bars(Q.history_records(spark.createDataFrame(rows, "ticker string, value string"))).select("ticker", F.col("session").cast("string"), "open", "close", "volume")
    assert sorted(map(tuple, got.collect())) == [("a", "2024-01-02", 1.0, 1.75, 7.0), ("b", "2024-01-03", None, 2.5, 0.0)]
    rows = [("a", '{"results":[{"t":1704153600000,"o":1,"h":2,"l":1,"c":1.5,"v":9},{"t":1704239999999,"o":1,"h":2,"l":1,"c":1.25,"v":8}]}'), ("b", '{"status":"ERROR"}'), ("c", None)]
    got = Q.normalise_bars(Q.aggregate_records(spark.createDataFrame(rows, "ticker string, value string"))).select("ticker", F.col("session").cast("string"), "close", "volume")
    assert sorted(map(tuple, got.collect())) == [("a", "2024-01-02", 1.25, 8.0)]


def test_usable_providers():
    order, free = ["paid", "other", "free"], {"free"}
    assert Q.usable_providers(order, free, {"paid": "", "other": "k"}) == ["other", "free"]
    assert Q.usable_providers(order, free, {}, "free") == ["free"]
    with pytest.raises(ValueError):
        Q.usable_providers(order, free, {}, "paid")


def test_still_to_fetch_goes_on_where_it_stopped(spark):
    bars = spark.createDataFrame([("a", f"2024-01-{k:02d}") for k in range(1, 11)], "ticker string, session string").withColumn("session", F.col("session").cast("date"))
    today, done = F.lit("2024-01-10").cast("date"), bars.limit(0)
    days = lambda df: sorted(x["session"].day for x in df.collect())
    assert days(Q.still_to_fetch(bars, done, today, 3)) == [7, 8, 9] and days(Q.still_to_fetch(bars, done, today, 3, 2)) == [5, 6, 7]
    assert days(Q.still_to_fetch(bars, bars.where("session = date '2024-01-08'"), today, 3)) == [7, 9]


def test_venues_of_off_exchange_trades(spark):
    trades = spark.createDataFrame([("a", 1, 4, 10.0, 1.0), ("a", 1, 11, 5.0, 1.0), ("a", 1, 62, 3.0, 1.0), ("a", 1, 62, 0.0, 1.0)], "ticker string, day int, exchange int, size double, price double")
    off = lambda rows: FL.off_exchange_volume(trades, spark.createDataFrame(rows, "id long, type string")).first()["off_volume"]
    assert off([(62, "trf"), (4, "TRF"), (11, "exchange"), (None, "TRF"), (62, "TRF")]) == 13.0
    assert off([(11, "exchange")]) == off([]) == 10.0


def test_sign_run(spark):
    nan = float("nan")
    rows = [("up", k, x) for k, x in enumerate([1.0, -1.0, 0.0, None, 2.0, nan])] + [("down", k, x) for k, x in enumerate([-1.0, -2.0])] + [("none", 0, nan)]
    got = I.sign_run(spark.createDataFrame(rows, "ticker string, session int, x double"), "x")
    assert sorted(map(tuple, got.collect())) == [("down", False, 2), ("up", True, 2)]


def test_write_once_fails_on_what_it_cannot_read(spark, tmp_path):
    """A table that is there but can't be read must not count as none."""
    out = tmp_path / "out"
    out.mkdir()
    (out / "part-0.parquet").write_bytes(b"no parquet")
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1)], "ticker string, day int").write.parquet(str(source))
    stream = spark.readStream.schema("ticker string, day int").parquet(str(source))
    with pytest.raises(Exception, match="(?i)parquet"):
        SF.write_once(stream, str(out), str(tmp_path / "c")).awaitTermination(120)
