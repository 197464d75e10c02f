"""Indicators on bars whose answers are known by construction, and properties that hold for any bars."""

from __future__ import annotations

import math
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import indicators as I

N = 300


def sessions(n: int) -> list[date]:
    out, d = [], date(2023, 1, 2)
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(days=1)
    return out


def bars(spark, closes, volumes, ticker="A"):
    days = sessions(len(closes))
    rows = []
    for i, (c, v) in enumerate(zip(closes, volumes, strict=True)):
        o = closes[i - 1] if i else c
        rows.append((ticker, days[i], float(o), max(o, c) * 1.01, min(o, c) * 0.99, float(c), float(v)))
    return spark.createDataFrame(rows, "ticker string, session date, open double, high double, low double, close double, volume double")


def last(df, *cols):
    return df.orderBy(F.desc("session")).select(*cols).first()


@pytest.mark.parametrize(("tail", "low", "high"), [((20, 1e6), -6, 6), ((20, 2e6), 25, 1e9), ((20, 4e5), -1e9, -20)])
def test_volume_trend(spark, tail, low, high):
    v = [1e6] * (N - tail[0]) + [tail[1]] * tail[0]
    assert low <= last(I.volume_trend(bars(spark, [100.0] * N, v)), "volume_trend")[0] <= high


def test_one_spike_does_not_move_the_trend(spark):
    v = [1e6] * N
    v[-3] = 2e7
    assert abs(last(I.volume_trend(bars(spark, [100.0] * N, v)), "volume_trend")[0]) < 10


def test_expansion_is_a_regime_and_lasts(spark):
    v = [1e6 * (1 + 0.01 * (i % 7)) for i in range(N - 40)] + [2.2e6] * 40
    r = last(I.volume_regime(bars(spark, [100.0] * N, v)), "regime", "run_days", "sustained")
    assert r["regime"] == "expanding" and r["run_days"] >= 20 and r["sustained"]


def test_distribution_outweighs_accumulation(spark):
    c = [100.0]
    for i in range(59):
        c.append(c[-1] * (1.01 if i % 2 else 0.99))
    v = [1.2e6 if i and c[i] < c[i - 1] else 0.9e6 for i in range(60)]
    r = last(I.distribution_days(bars(spark, c, v)), "dist_days", "acc_days")
    assert r[0] > 5 and r[0] > r[1]


@pytest.mark.parametrize(("gain", "volume", "kind"), [(0.15, 4e5, "bearish"), (-0.15, 4e5, "bullish"), (0.15, 2e6, "confirmed_up")])
def test_divergence(spark, gain, volume, kind):
    c = [100.0] * (N - 60) + [100 * (1 + gain * (i + 1) / 60) for i in range(60)]
    v = [1e6] * (N - 20) + [volume] * 20
    r = last(I.price_volume_divergence(bars(spark, c, v)), "divergence", "depletion")
    assert r[0] == kind and r[1] == (kind in ("bearish", "bullish"))


def test_stages(spark):
    up = [100 + 50 * i / (N - 1) for i in range(N)]
    rising = [8e5 + 1.2e6 * i / (N - 1) for i in range(N)]
    assert last(I.stages(bars(spark, up, rising)), "stage")[0] == 2
    assert last(I.stages(bars(spark, up[::-1], [1e6] * N)), "stage")[0] == 4
    assert last(I.stages(bars(spark, up[:40], rising[:40])), "stage")[0] == 0


def test_gates(spark):
    """Momentum needs 275 bars; Mansfield strength 50."""
    c = [100.0 + i for i in range(N)]
    m = I.momentum(bars(spark, c, [1e6] * N)).orderBy("session").toPandas()
    assert m.mom_12_1.isna()[:274].all() and m.mom_12_1.notna()[274:].all()
    assert m.mom_12_1[274] == pytest.approx((c[253] / c[1] - 1) * 100)
    b = bars(spark, c, [1e6] * N)
    r = I.mansfield(I.relative_strength(b, b.drop("ticker"))).orderBy("session").toPandas()
    assert r.mansfield_rs.isna()[:49].all() and (r.mansfield_rs[49:].abs() < 1e-9).all()


def test_flat_bars_add_nothing_to_money_flow(spark):
    d = sessions(30)
    f = spark.createDataFrame([("A", x, 1.0, 1.0, 1.0, 1.0, 5.0) for x in d], "ticker string, session date, open double, high double, low double, close double, volume double")
    assert last(I.money_flow(f), "cmf")[0] == 0.0
    assert last(I.money_flow(f.withColumn("volume", F.lit(0.0))), "cmf")[0] is None


def test_earlier_rows_do_not_change(spark):
    """No indicator looks ahead: 60 more bars leave the rows before them as they were."""
    c = [100 + 10 * math.sin(i / 9) + i / 20 for i in range(N)]
    v = [1e6 * (1.5 + math.sin(i / 5)) for i in range(N)]

    def run(n):
        b = bars(spark, c[:n], v[:n])
        f = I.stages(I.block_intensity(I.absorption(I.ad_balance(I.money_flow(I.obv_slope(I.returns(b)))))))
        return f.toPandas().sort_values("session").reset_index(drop=True)

    short, long = run(N - 60), run(N)
    pd.testing.assert_frame_equal(short, long.head(len(short)), check_dtype=False)


def test_durations(spark):
    d = sessions(6)
    f = spark.createDataFrame([("A", d[i], x) for i, x in enumerate("aabbba")] + [("B", d[i], "c") for i in range(3)], "ticker string, session date, v string")
    got = {r["ticker"]: r for r in I.durations(f, "v").collect()}
    assert (got["A"]["value"], got["A"]["days"], got["A"]["previous"], got["A"]["since"]) == ("a", 1, "b", d[5])
    assert (got["B"]["days"], got["B"]["previous"], got["B"]["since"]) == (3, None, None)


def test_series_trend_uses_disjoint_windows(spark):
    def trend(values):
        d = sessions(len(values)) if values else []
        f = spark.createDataFrame([("A", x, float(y)) for x, y in zip(d, values, strict=True)], "ticker string, session date, x double")
        r = I.series_trend(f, "x").first()
        return r["trend"] if r else None

    assert trend([10] * 180 + [20] * 20) == 10
    assert trend([10] * 150 + [20] * 50) == 0
    assert trend([1] * 30) is None


def test_short_interest_waits_for_publication(spark):
    d = date(2024, 1, 31)
    s = spark.createDataFrame([("A", d, 100.0, 10.0), ("A", d + timedelta(days=15), 200.0, 10.0)], "ticker string, settlement date, short_interest double, avg_daily_volume double")
    as_of = spark.createDataFrame([("A", d + timedelta(days=k)) for k in (13, 14, 28, 29)], "ticker string, as_of date")
    got = {r["as_of"]: r["days_to_cover"] for r in I.short_interest_metrics(s, as_of).collect()}
    assert got == {d + timedelta(days=14): 10.0, d + timedelta(days=28): 10.0, d + timedelta(days=29): 20.0}


def shaped(spark, closes, opens=None, volume=None, ticker="A"):
    """Bars a tenth wide around open and close."""
    opens = opens or [closes[0], *closes[:-1]]
    rows = [(ticker, date(2020, 1, 1) + timedelta(days=i), float(o), float(max(o, c) + 0.05), float(min(o, c) - 0.05), float(c), float((volume or {}).get(i, 1000))) for i, (o, c) in enumerate(zip(opens, closes, strict=True))]
    return spark.createDataFrame(rows, "ticker string, session date, open double, high double, low double, close double, volume double")


def found(bars):
    return {r["setup"]: (r["direction"], r["confirmed"]) for r in I.setups(bars).collect()}


def test_setups(spark):
    """Each kind on the last bars of 80; the same bars without its volume, or on 59 bars, show none."""
    rising = [100 + i / 10 for i in range(79)]
    bounce = [*rising, 106.0]
    opens = [100.0, *rising[:-1], 105.4]
    assert "ma_bounce" in found(shaped(spark, bounce, opens, {79: 3000})) and "ma_bounce" not in found(shaped(spark, bounce, opens))
    flat = [100 - i / 1000 for i in range(78)]
    assert found(shaped(spark, [*flat, 103.0, 103.5]))["breakout"] == ("long", True)
    assert found(shaped(spark, [*flat, 103.0, 102.0]))["breakout"] == ("long", False)
    assert found(shaped(spark, [*flat, 99.9, 103.0]))["breakout"] == ("long", None)
    down = [*rising, 95.0]
    assert found(shaped(spark, down, None, {79: 3000}))["breakdown"] == ("exit/short", None) and "breakdown" not in found(shaped(spark, down))
    turn = [*flat[:77], 99.0, 100.5, 101.0]
    assert found(shaped(spark, turn, [100.0, *flat[:76], 100.0, 99.0, 100.4], {79: 3000}))["reversal"] == ("long", None)
    assert found(shaped(spark, down[-59:], None, {58: 3000})) == {}


def test_crossings_in_both_directions(spark):
    b = shaped(spark, [*[100 - i / 100 for i in range(40)], 105.0, 105.0, 90.0, 105.0], None, {40: 5000})
    got = [(r["direction"], r["volume_confirmed"], r["confirmed"]) for r in I.sma_breakouts(b, (20,)).orderBy("session").collect()]
    assert got == [("up", True, True), ("down", False, False), ("up", False, None)]


def test_breadth_counts_bars_so_far(spark):
    """Eight names from different days on: no reading before the eighth has 55 bars, and later bars change nothing."""
    rows = [("P", f"T{j}", date(2020, 1, 1) + timedelta(days=i), 100.0 + i * (1 if j < 6 else -1)) for j in range(8) for i in range(5 * j, 120)]
    c = spark.createDataFrame(rows, "parent string, ticker string, session date, close double")
    whole = {r["session"]: (r["breadth"], r["n_names"]) for r in I.breadth(c).collect()}
    assert min(whole) == date(2020, 1, 1) + timedelta(days=35 + 54) and set(whole.values()) == {(75.0, 8)}
    cut = date(2020, 4, 10)
    assert {r["session"]: (r["breadth"], r["n_names"]) for r in I.breadth(c.where(F.col("session") <= F.lit(cut))).collect()} == {k: v for k, v in whole.items() if k <= cut}
