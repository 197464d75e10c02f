"""Cross-sectional operators and scores: peers of one tier on one session, then blends, phases, flags and rankings.

Frames hold a row for each (ticker, session) with a tier. Windows here partition by (tier, session); everything by ticker stays
in the indicators, so a full run shuffles twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.rolling import blend, clip, last_rows, ordered
from . import indicators as I

#: Weights of the composite score, of the footprint proxies, and of the momentum score.
CSRI_WEIGHTS = {"mansfield": 0.30, "rs_mom": 0.20, "breadth": 0.20, "cmf": 0.15, "inst": 0.15}
FOOTPRINT_WEIGHTS = (0.40, 0.35, 0.25)
VMS_WEIGHTS = (0.5, 0.5)
PHASES = ("CONFIRMED_BREAKOUT", "STEALTH_ACCUMULATION", "DISTRIBUTION", "CAPITAL_FLIGHT", "NEUTRAL")


def peers() -> WindowSpec:
    return Window.partitionBy("tier", "session")


def peer_z(x: str, ddof: int = 0) -> Column:
    sd = F.stddev_pop(x) if ddof == 0 else F.stddev_samp(x)
    return (F.col(x) - F.avg(x).over(peers())) / F.nullif(sd.over(peers()), F.lit(0.0))


def rrg_normalise(frame: DataFrame, columns: dict[str, str], limit: float = 4.0, least_peers: int = 3, own: int = 252, own_least: int = 63) -> DataFrame:
    """100 plus the clipped z-score among peers; with too few peers, against the instrument's own last readings. columns: output by input."""
    w, first, second = last_rows(own), {}, {}
    for i, x in enumerate(columns):
        first[f"_own{i}"] = F.when(F.count(x).over(w) >= own_least, (F.col(x) - F.avg(x).over(w)) / F.nullif(F.stddev_pop(x).over(w), F.lit(0.0)))
        second |= {f"_n{i}": F.count(x).over(peers()), f"_peer{i}": peer_z(x)}
    # by ticker while the bars still are, then all peers at once: one shuffle
    frame = frame.withColumns(first).withColumns(second)
    frame = frame.withColumns({f"_v{i}": F.when(F.col(f"_n{i}") >= least_peers, F.col(f"_peer{i}")).otherwise(F.col(f"_own{i}")) for i in range(len(columns))})
    frame = frame.withColumns({out: 100 + clip(F.col(f"_v{i}"), -limit, limit) for i, out in enumerate(columns.values())})
    return frame.drop(*[f"{p}{i}" for i in range(len(columns)) for p in ("_own", "_n", "_peer", "_v")])


def quadrant(ratio: str = "rs_ratio", mom: str = "rs_mom") -> Column:
    x, y = F.col(ratio), F.col(mom)
    return F.when(x.isNull() | y.isNull(), "Unknown").when((x >= 100) & (y >= 100), "Leading").when((x < 100) & (y >= 100), "Improving").when(x >= 100, "Weakening").otherwise("Lagging")


def latest(frame: DataFrame, *needed: str) -> DataFrame:
    """Each ticker's last row (of those that have all of needed)."""
    f = frame.where(" and ".join(f"{c} is not null" for c in needed)) if needed else frame
    # the newest row by a mergeable aggregate, not by sorting each ticker
    return f.groupBy("ticker").agg(F.max_by(F.struct(*f.columns), "session").alias("r")).select("r.*")


def vms(last: DataFrame, a: str = "mom_12_1", b: str = "rs_mom") -> DataFrame:
    """Momentum score by tier over latest rows: z-scores (0 where a tier doesn't vary) blended, missing ones left out; rank and tier size."""
    tier = Window.partitionBy("tier")

    def zed(x: str) -> Column:
        sd = F.stddev_pop(x).over(tier)
        return F.when(F.col(x).isNotNull(), F.when(sd > 0, (F.col(x) - F.avg(x).over(tier)) / sd).otherwise(0.0))

    f = last.withColumns({"_a": zed(a), "_b": zed(b)}).withColumn("vms", blend([(VMS_WEIGHTS[0], F.col("_a")), (VMS_WEIGHTS[1], F.col("_b"))]))
    place = F.row_number().over(tier.orderBy(F.desc_nulls_last("vms"), "ticker"))
    return f.withColumns({"vms_rank": F.when(F.col("vms").isNotNull(), place), "tier_size": F.count("vms").over(tier)}).drop("_a", "_b")


def vms_history(frame: DataFrame, a: str = "mom_12_1", b: str = "rs_mom", least: int = 3, dates: int = 30) -> DataFrame:
    """The score on every session on which both parts have at least least names; null unless both are there."""
    f = frame.withColumns({"_na": F.count(a).over(peers()), "_nb": F.count(b).over(peers())}).where((F.col("_na") >= least) & (F.col("_nb") >= least))
    f = f.withColumn("vms_hist", VMS_WEIGHTS[0] * peer_z(a) + VMS_WEIGHTS[1] * peer_z(b))
    shared = f.select("tier", "session").distinct().groupBy("tier").count().where(F.col("count") >= dates).select("tier")
    return f.join(F.broadcast(shared), "tier", "left_semi").drop("_na", "_nb")


def footprint(frame: DataFrame) -> DataFrame:
    """inst: what the bars say about institutions, -1 to 1, from absorption, accumulation balance and block intensity."""
    f = I.z_last(frame, {"absorption": "absorption_z"}, spread=True)
    w = FOOTPRINT_WEIGHTS
    return f.withColumn("inst", blend([(w[0], F.tanh(F.col("absorption_z") / 1.5)), (w[1], clip(2.5 * F.col("ad_balance"), -1, 1)), (w[2], F.tanh(F.col("block_intensity_z") / 2))]))


def observed_footprint(frame: DataFrame) -> DataFrame:
    """The footprint with observed order flow where there is any: three quarters flow, one quarter proxy; and which of the two it rests on."""
    both = blend([(0.75, F.col("flow_score")), (0.25, F.col("inst"))])
    kind = F.when(F.col("flow_score").isNotNull(), "observed").when(F.col("inst").isNotNull(), "proxied").otherwise("none")
    return frame.withColumns({"inst_observed": F.when(F.col("flow_score").isNotNull(), both).otherwise(F.col("inst")), "flow_regime": kind})


def _carried(c: str) -> Column:
    return F.last(c, ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, 0))


def csri(frame: DataFrame) -> DataFrame:
    """The composite score of z-scored components (the footprint counts twice its score), its change against 21 readings back, and its history.
    In the two latter, absorption stands for the footprint. A component that is missing on a session counts with its last reading."""
    # the footprint has absorption's z-score already
    f = I.z_last(frame, {"mansfield_rs": "_z_mansfield", "rs_mom": "_z_rs_mom", "breadth": "_z_breadth", "cmf": "_z_cmf"}, spread=True)
    f = f.withColumnsRenamed({"absorption_z": "_z_absorption", "sd_absorption_z": "sd__z_absorption", "n_absorption_z": "n__z_absorption"})
    cols = {}
    for c, x in (("mansfield", "mansfield_rs"), ("rs_mom", "rs_mom"), ("breadth", "breadth"), ("cmf", "cmf"), ("absorption", "absorption")):
        there = Window.partitionBy("ticker", F.col(x).isNotNull()).orderBy("session")
        before = F.when(F.col(x).isNotNull() & (F.col(f"n__z_{c}") > 60), F.lag(f"_z_{c}", 21).over(there))
        cols |= {f"_b_{c}": before, f"_h_{c}": F.when(F.col(f"sd__z_{c}") > 0, F.col(f"_z_{c}"))}
    f = f.withColumns(cols)
    names = ("mansfield", "rs_mom", "breadth", "cmf", "absorption")
    f = f.withColumns({**{f"z_{c}": _carried(f"_z_{c}") for c in names}, **{f"_b_{c}": _carried(f"_b_{c}") for c in names}})
    f = f.withColumn("z_inst", 2 * _carried("inst"))
    w = CSRI_WEIGHTS
    f = f.withColumn("csri", blend([(w[c], F.col(f"z_{c}")) for c in w]))
    proxy = {c: ("absorption" if c == "inst" else c) for c in w}
    f = f.withColumn("csri_delta", F.col("csri") - blend([(w[c], F.col(f"_b_{proxy[c]}")) for c in w]))
    f = f.withColumn("csri_hist", blend([(w[c], F.col(f"_h_{proxy[c]}")) for c in w]))
    return f.drop(*[f"{p}_{c}" for p in ("_z", "_b", "_h", "n__z", "sd__z") for c in names])


def strictly_below(x: str, within: WindowSpec | None = None) -> Column:
    """Share (in 100) of peers strictly below."""
    w = peers() if within is None else within
    return F.when(F.col(x).isNotNull(), (F.rank().over(w.orderBy(F.asc_nulls_last(x))) - 1) / F.count(x).over(w) * 100)


def phase(strict: bool = False) -> Column:
    """The first rule that fits. A missing breadth passes unless strict."""
    mrs, mom, cmf, inst, pct, b = (F.col(c) for c in ("mansfield_rs", "rs_mom", "cmf", "inst", "inst_pct", "breadth"))

    def has_breadth(c: Column) -> Column:
        return F.when(b.isNull(), F.lit(not strict)).otherwise(c)

    rules = (
        ("CONFIRMED_BREAKOUT", (mrs > 0) & has_breadth(b >= 60) & (cmf >= 0.05) & F.col("quadrant").isin("Leading", "Improving")),
        ("STEALTH_ACCUMULATION", (mrs <= 0) & (mom >= 100) & has_breadth(b >= 45) & (inst >= -0.10) & (pct.isNull() | (pct >= 60))),
        ("DISTRIBUTION", (mrs > 0) & (mom < 100) & (cmf <= 0)),
        ("CAPITAL_FLIGHT", (mrs <= 0) & (mom < 100) & has_breadth(b <= 40)),
    )
    out = F.lit("NEUTRAL")
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def flags() -> Column:
    """Kinds of what stands out, in a fixed order."""
    c = F.col
    rules = (
        ("mansfield_cross", c("cross_up")), ("unusual_volume", c("volume_z") >= 2), ("block_activity", c("block_intensity_z") >= 2), ("csri_surge", c("csri_delta") >= 0.75), ("csri_slump", c("csri_delta") <= -0.75),
        ("absorption", (c("absorption") > 0.25) & (F.coalesce(c("ret_21"), F.lit(0.0)) * 100 < 3)), ("dark_pool", F.abs("dark_trend") > 0.015), ("off_exchange", c("off_trend") > 0.02), ("block_direction", F.abs("block_direction") > 0.15),
        ("large_print", c("largest_notional") >= 25e6), ("stage4", c("stage") == 4),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules]))


def tier_rank(last: DataFrame, x: str = "csri") -> DataFrame:
    w = Window.partitionBy("tier")
    f = last.where(F.col(x).isNotNull()).withColumn("rank", F.row_number().over(w.orderBy(F.desc(x), "ticker")))
    return f.withColumn("percentile", 100.0 * (F.count("*").over(w) - F.col("rank") + 1) / F.count("*").over(w))


def rotation(last: DataFrame, score: str = "vms", top: int = 4, least: int = 4, material: float = 0.5) -> DataFrame:
    """Among tier 1 (at least so many names), by the momentum score: the top ones above zero gain ground and the last ones below lose it; and
    whether each stands out from its peers."""
    f = last.where((F.col("tier") == 1) & F.col(score).isNotNull())
    up = f.where(F.col(score) > 0).orderBy(F.desc(score), "ticker").limit(top).withColumn("side", F.lit("gaining"))
    down = f.where(F.col(score) < 0).orderBy(score, F.desc("ticker")).limit(top).withColumn("side", F.lit("losing"))
    enough = f.agg(F.count("*").alias("n_total"), F.sum((F.abs(score) >= material).cast("int")).alias("n_material")).where(F.col("n_total") >= least)
    return up.unionByName(down).withColumn("material", F.abs(score) >= material).crossJoin(F.broadcast(enough))  # one row


def market_regime(bench: DataFrame) -> DataFrame:
    """RISK-ON, PULLBACK, CAUTION or RISK-OFF on each session of the benchmark, by its 50- and 200-session averages and the latter's slope over 41 sessions."""
    b = I.moving_averages(bench.withColumn("ticker", F.lit("benchmark")), (50, 200))
    slope = (F.col("sma_200") / I.lag("sma_200", 41) - 1) * 100
    b = b.withColumn("slope_200", slope)
    above, near, rising = F.col("above_200"), F.col("above_50"), F.col("slope_200") > 0
    kind = F.when(above & near & rising, "RISK-ON").when(above & ~near, "PULLBACK").when(~above & rising, "CAUTION").otherwise("RISK-OFF")
    return b.withColumn("regime", F.when(F.col("slope_200").isNotNull(), kind))


def tilt(last: DataFrame, cyclical: list[str], defensive: list[str], band: float = 0.15) -> DataFrame:
    """Mean composite score of cyclical less defensive tickers, and what that says."""
    part = lambda names: F.avg(F.when(F.col("ticker").isin(*names), F.col("csri")))
    t = last.agg((part(cyclical) - part(defensive)).alias("tilt"))
    return t.withColumn("stance", F.when(F.col("tilt") > band, "offensive").when(F.col("tilt") < -band, "defensive").otherwise("balanced"))


def score_frame(bars: DataFrame, bench: DataFrame, breadth: DataFrame | None = None) -> DataFrame:
    """Everything above by (ticker, session), from bars with a tier, the benchmark's bars and breadth (ticker, session, breadth)."""
    f = I.rrg_raw(I.mansfield(I.relative_strength(bars, bench)))
    f = I.block_intensity(I.absorption(I.ad_balance(I.money_flow(I.momentum(I.momentum(I.returns(f, (21,))), 126, 21, "mom_6_1")))))
    f = f.join(breadth, ["ticker", "session"], "left") if breadth is not None else f.withColumn("breadth", F.lit(None).cast("double"))
    f = rrg_normalise(f, {"rs_ratio_raw": "rs_ratio", "rs_mom_raw": "rs_mom"})
    f = csri(footprint(f)).withColumn("quadrant", quadrant())
    f = f.withColumn("inst_pct", strictly_below("inst"))
    return f.withColumn("phase", phase())
