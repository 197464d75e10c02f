"""Seeded resampling, power, and the verdict over a panel.

Replicates are rows: every draw is a hash of (seed, replicate, place), so a result doesn't depend on partitions or on how often a
task ran. A group's values are a few hundred numbers by then; they travel as one array beside each replicate and are summed there.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import panel as P

SEED = 42


def _values(x: DataFrame, keys: tuple[str, ...], value: str, order: tuple[str, ...]) -> DataFrame:
    a = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda r: r["_v"])
    return x.where(F.col(value).isNotNull()).groupBy(*keys).agg(a.alias("v"), F.avg(value).alias("mean"), F.count("*").alias("n"))


def _block_means(g: DataFrame, block: int, reps: int, seed: int, v: str = "v", out: str = "m") -> DataFrame:
    """g with a row for each replicate and the mean of a circular block resample of the array v (null if it is empty)."""
    n = F.size(v)
    some = F.nullif(n, F.lit(0))
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / F.lit(block)).cast("int"), F.lit(1)) - 1), lambda b: F.pmod(F.xxhash64(F.lit(seed), F.col("rep"), F.lit(v), b), some).cast("int"))
    picked = F.slice(F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda i: F.get(v, F.pmod(s + i, some).cast("int"))))), F.lit(1), n)
    if "rep" not in g.columns:
        g = g.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    return g.withColumn(out, F.aggregate(picked, F.lit(0.0), lambda s, x: s + x) / some)


def block_for(horizon: int, step: int) -> int:
    """Observations a block: twice as many as overlap in a horizon, and 8 at least."""
    return max(8, 2 * math.ceil(horizon / max(step, 1)))


def _share_beyond(m: str, observed: Column) -> Column:
    """Of an array of replicates, centred on their own mean: the share at least as far from 0 as what was observed."""
    n = F.nullif(F.size(m), F.lit(0))
    middle = F.aggregate(m, F.lit(0.0), lambda s, x: s + x) / n
    return F.size(F.filter(F.transform(m, lambda x: x - middle), lambda x: F.abs(x) >= F.abs(observed))) / n


def bootstrap_mean(x: DataFrame, *keys: str, value: str = "x", order: tuple[str, ...] = ("date",), block: int = 8, reps: int = 5000, seed: int = SEED, least: int = 8) -> DataFrame:
    """By group: mean, 95 % interval, and the share of centred replicates at least as far from 0 as the mean (null under least values)."""
    g = _values(x, keys, value, order)
    r = _block_means(g, block, reps, seed).groupBy(*keys).agg(F.first("mean").alias("mean"), F.first("n").alias("n"), F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.collect_list("m").alias("m"))
    r = r.withColumn("p", _share_beyond("m", F.col("mean")))
    return r.select(*keys, "n", "mean", F.when(F.col("n") >= least, F.col("q")[0]).alias("low"), F.when(F.col("n") >= least, F.col("q")[1]).alias("high"), F.when(F.col("n") >= least, F.col("p")).alias("p"))


def spread_test(eps: DataFrame, a: str, b: str, y: str = "fwd_21", block: int | None = None, reps: int = 4000, seed: int = SEED, horizon: int = 21, step: int = P.STEP) -> DataFrame:
    """The difference of two phases' mean returns with its bootstrap interval, and the verdict, which goes by p."""
    block = block or block_for(horizon, step)
    legs = [_values(eps.where(F.col("phase") == p), (), y, ("start", "ticker")).select(F.col("v").alias(n), F.col("mean").alias(f"m{n}"), F.col("n").alias(f"n{n}")) for n, p in (("a", a), ("b", b))]
    g = legs[0].crossJoin(F.broadcast(legs[1]))  # one row each
    g = _block_means(_block_means(g, block, reps, seed, "a", "ra"), block, reps, seed + 1, "b", "rb")
    r = g.groupBy("ma", "mb", "na", "nb").agg(F.percentile(F.col("ra") - F.col("rb"), F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.collect_list(F.col("ra") - F.col("rb")).alias("m"))
    r = r.withColumn("p", _share_beyond("m", F.col("ma") - F.col("mb"))).select("na", "nb", (F.col("ma") - F.col("mb")).alias("spread"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "p")
    enough = F.least("na", "nb") >= 8
    flat = (F.least("na", "nb") >= 50) & (F.col("high") - F.col("low") < 1) & (F.abs("spread") < 0.25)
    return r.withColumn("verdict", F.when(~enough, "UNDERPOWERED").when((F.col("p") < 0.05) & (F.col("spread") > 0), "POSITIVE").when((F.col("p") < 0.05) & (F.col("spread") < 0), "INVERTED").when(flat, "NO_EDGE").otherwise("UNDERPOWERED"))


def permutation_null(obs: DataFrame, a: str, b: str, y: str = "fwd_21", reps: int = 1000, seed: int = SEED) -> DataFrame:
    """The spread of phase a over b against phases shuffled within each date: spread, and the share of shuffles at least as large."""
    # a date's names are one array and its replicates rows beside it; only sums by replicate leave a task. Dealt out before there are that many rows, as Spark goes by today's size
    o = obs.where(F.col(y).isNotNull()).select("date", "ticker", "phase", F.col(y).alias("y")).repartition(int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "date")
    o = o.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("ticker", "phase", "y"))).alias("v")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    order = lambda t: F.when(F.col("rep") > 0, F.xxhash64(F.lit(seed), F.col("rep"), F.col("date"), t))
    shuffled = F.array_sort(F.transform("v", lambda r: F.struct(order(r["ticker"]).alias("o"), r["ticker"].alias("t"), r["phase"].alias("p"))))
    o = o.select("rep", F.zip_with("v", shuffled, lambda r, l: F.struct(l["p"].alias("p"), r["y"].alias("y"))).alias("v"))
    ys = lambda phase: F.transform(F.filter("v", lambda r: r["p"] == phase), lambda r: r["y"])
    o = o.select("rep", ys(a).alias("a"), ys(b).alias("b"))
    mean = lambda v: F.sum(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)) / F.nullif(F.sum(F.size(v)), F.lit(0))
    s = o.groupBy("rep").agg((mean("a") - mean("b")).alias("s"))
    return s.agg(F.max(F.when(F.col("rep") == 0, F.col("s"))).alias("spread"), F.collect_list(F.when(F.col("rep") > 0, F.col("s"))).alias("_n")).select("spread", (F.size(F.filter("_n", lambda x: F.abs(x) >= F.abs("spread"))) / F.nullif(F.size("_n"), F.lit(0))).alias("p"))


def fit_weights(obs: DataFrame, columns: tuple[str, ...], y: str = "fwd_21", draws: int = 4000, seed: int = SEED) -> DataFrame:
    """Random weight vectors (normalised exponentials, with the even one as draw 0): mean rank correlation in training and in the embargoed test, best first."""
    u = [((F.pmod(F.xxhash64(F.lit(seed), F.col("draw"), F.lit(c)), F.lit(1 << 52)) + 0.5) / float(1 << 52)) for c in columns]
    w = obs.sparkSession.range(draws + 1).withColumnRenamed("id", "draw")
    w = w.withColumns({f"_e{k}": F.when(F.col("draw") == 0, 1.0).otherwise(-F.log(x)) for k, x in enumerate(u)})
    tot = sum((F.col(f"_e{k}") for k in range(len(columns))), F.lit(0.0))
    w = w.select("draw", *[(F.col(f"_e{k}") / tot).alias(f"w_{c}") for k, c in enumerate(columns)])
    o = P.embargo_split(obs).where("part <> 'embargo'").where(F.col(y).isNotNull()).select("date", "part", F.col(y).alias("y"), *columns)
    j = o.crossJoin(F.broadcast(w))  # draws + 1 rows, whatever the panel
    num = sum((F.coalesce(F.col(f"w_{c}") * F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    den = sum((F.when(F.col(c).isNotNull(), F.col(f"w_{c}")).otherwise(0.0) for c in columns), F.lit(0.0))
    j = j.withColumn("score", num / F.nullif(den, F.lit(0.0))).where("score is not null")
    key = ("draw", "part", "date")
    r = j.withColumns({"_rx": P.average_rank("score", *key), "_ry": P.average_rank("y", *key)}).groupBy(*key).agg(F.corr("_rx", "_ry").alias("ic"), F.count("*").alias("n")).where("n >= 6")
    g = r.groupBy("draw").pivot("part", ["train", "test"]).agg(F.avg("ic"))
    return g.join(F.broadcast(w), "draw").withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("train"), "draw")))


def power_analysis(n_a: int, n_b: int, sd: float, effect: float, alpha: float = 0.05, power: float = 0.8) -> dict:
    """Of a two-sided comparison of means: standard error, least detectable effect, achieved power, and the size each group would need."""
    normal = NormalDist()
    if min(n_a, n_b) < 2 or not sd > 0:
        return {"se": None, "mde": None, "power": None, "needed": None}
    se = sd * math.sqrt(1 / n_a + 1 / n_b)
    za, zb = normal.inv_cdf(1 - alpha / 2), normal.inv_cdf(power)
    shift = abs(effect) / se
    return {"se": se, "mde": (za + zb) * se, "power": normal.cdf(shift - za) + normal.cdf(-shift - za), "needed": math.ceil(2 * ((za + zb) * sd / effect) ** 2) if effect else None}


#: Limits of the checks.
CRITERIA = {"breakout_mean": 0.5, "breakout_hit": 55.0, "breakout_n": 40, "accumulation_mean": 1.5, "accumulation_n": 30, "flight_mean": -0.5, "bucket_gap": 0.5, "effect": 0.2, "dominance": 0.9, "power": 0.8, "episodes": 200, "dates": 100}


def verdict(facts: dict) -> dict:
    """PASS, MARGINAL, UNDERPOWERED, FAIL or KILL from what the tests found. facts: by name; a check that misses one is None, neither passed nor failed.

    The achieved power is looked at before the spread's verdict, so that a powered test without an edge can end it. signals: what speaks against one signal alone."""
    c, get = CRITERIA, facts.get
    num = lambda k: get(k) if get(k) is not None else float("nan")
    known = lambda x, *ks: x if all(get(k) is not None for k in ks) else None
    checks = {
        "breakout": known(num("breakout_n") >= c["breakout_n"] and num("breakout_mean") > c["breakout_mean"] and num("breakout_hit") > c["breakout_hit"], "breakout_mean"),
        "accumulation": known(num("accumulation_n") >= c["accumulation_n"] and num("accumulation_mean") > c["accumulation_mean"] and num("accumulation_hit") > c["breakout_hit"], "accumulation_mean"),
        "flight": known(num("flight_mean") < c["flight_mean"], "flight_mean"), "monotonic": get("in_order"), "spread": known(get("spread_verdict") == "POSITIVE", "spread"), "permutation": known(num("permutation_p") < 0.05, "permutation_p"),
        "beats_momentum": known(num("csri_ic") > num("momentum_ic"), "csri_ic", "momentum_ic"), "buckets": known(num("bucket_gap") > c["bucket_gap"], "bucket_gap") if num("buckets") >= 5 else None, "no_dominance": known(num("dominance") < c["dominance"], "dominance"),
        "effect": known(abs(num("cohen_d")) >= c["effect"], "cohen_d"), "tests_agree": get("tests_agree"), "survives_costs": known(num("net_mean") > 0, "net_mean"),
    }
    powered = num("power") >= c["power"]
    kills = [k for k, v in {"rank correlation is negative": num("rho") < 0, "spread is inverted": get("spread_verdict") == "INVERTED", "one component dominates": num("dominance") >= c["dominance"], "unstable by segment": get("stability") == "UNSTABLE", "no edge despite power": get("spread_verdict") == "NO_EDGE" and powered}.items() if v]
    weak = [k for k, v in {"few breakouts": 0 < num("breakout_n") < c["breakout_n"], "spread": get("spread_verdict") == "UNDERPOWERED" or (get("spread_verdict") == "NO_EDGE" and not powered), "permutation": checks["permutation"] is False, "momentum": checks["beats_momentum"] is False, "power": num("power") < c["power"], "tests disagree": checks["tests_agree"] is False}.items() if v]
    signals = [k for k, v in {"no accumulation": not num("accumulation_n") > 0, "few accumulations": 0 < num("accumulation_n") < c["accumulation_n"], "outliers are material": bool(get("outlier_driven")), "spread differs between two ways": get("ways_agree") is False}.items() if v]
    passed, failed = sum(v is True for v in checks.values()), sum(v is False for v in checks.values())
    thin = not (num("episodes") >= c["episodes"] and num("dates") >= c["dates"])
    out = "KILL" if kills else "UNDERPOWERED" if thin or len(weak) >= 2 else "PASS" if not failed and passed >= 4 else "MARGINAL" if passed > failed else "FAIL"
    return {"verdict": out, "passed": passed, "failed": failed, "kills": kills, "underpowered": weak, "signals": signals, "checks": checks}


def confidence(facts: dict) -> dict:
    """Whether a finding can be shared: what blocks it (red flags of high severity, outliers behind the best phase's mean, a spread that turns over time), what
    has to go with it (other red flags, too little power, kills, findings on single signals, returns that a median sums up better, a spread that holds in
    half of the time only), and the level by that: Needs revision, Share with noted caveats or Ready to share. facts: with those of verdict()."""
    flags, get = facts.get("red_flags") or {}, facts.get
    num = lambda k: get(k) if get(k) is not None else float("nan")
    blocking = [k for k, v in flags.items() if v == "high"] + [k for k, v in {"outliers drive the mean": bool(get("outlier_driven")), "spread reverses across segments": get("stability") == "UNSTABLE"}.items() if v]
    caveats = [k for k, v in flags.items() if v == "medium"] + ["sample is underpowered"] * (get("verdict") == "UNDERPOWERED") + [*(get("kills") or []), *(get("signals") or [])]
    caveats += [k for k, v in {"median rather than mean": abs(num("skew")) >= 1 or num("excess_kurtosis") >= 3, "spread holds in about half of segments": get("stability") == "MIXED"}.items() if v]
    return {"confidence": "Needs revision" if blocking else "Share with noted caveats" if caveats else "Ready to share", "blocking": blocking, "caveats": caveats}


def evaluate(obs: DataFrame, eps: DataFrame, best: str = "CONFIRMED_BREAKOUT", worst: str = "CAPITAL_FLIGHT", y: str = "fwd_21", later: str = "fwd_63") -> dict:
    """All tests over a panel, and the verdict. What reaches the driver are single rows. Accumulation is judged by the later return."""
    one = lambda df: (df.first() or {}) if not isinstance(df, dict) else df
    phases = {r["phase"]: r for r in P.phase_table(eps, y).collect()}
    row = lambda p, k: phases[p][k] if p in phases else None
    slow = {r["phase"]: r for r in P.phase_table(eps, later).collect()}.get("STEALTH_ACCUMULATION", {"n": None, "mean": None, "hit": None})
    sp, ef = one(spread_test(eps, best, worst, y)), one(P.two_groups(eps, "phase", best, worst, y))
    buckets = {r["bucket"]: r["mean"] for r in P.score_buckets(obs, y=y).collect()}
    comps = [r["spread"] for r in P.component_spread(obs, tuple(c for c in obs.columns if c.startswith("z_")), y).collect() if r["spread"] is not None]
    get = lambda r, k: r[k] if r else None
    # what there is to test, a row a date before
    has = F.col(y).isNotNull() & F.col("phase").isNotNull()
    there = obs.groupBy("date").agg(F.count(F.when(has, 1)).alias("n"), F.count("mom_12_1").alias("m"), *[F.count(F.when(has & (F.col("phase") == p), 1)).alias(k) for k, p in (("a", best), ("b", worst))])
    there = there.agg(F.count("*").alias("dates"), *[F.sum(k).alias(k) for k in ("n", "m", "a", "b")], F.percentile(F.when(F.col("n") > 0, F.col("n")), F.lit(0.5)).alias("median")).first()
    shuffles = (there["n"] or 0) >= 100 and there["median"] >= 4 and min(there["a"], there["b"]) >= 5
    rival = obs.where(F.col("mom_12_1").isNotNull())  # both scores on the same rows
    ic = lambda x: get(one(P.ic_summary(P.ic_by_date(rival, x, y))), "mean_ic") if (there["m"] or 0) >= 100 else None
    means = {p: row(p, "mean") for p in P.IN_ORDER if (row(p, "n") or 0) >= 8}
    some = min(get(ef, "na") or 0, get(ef, "nb") or 0) >= 5
    rank_p = (2 * (1 - NormalDist().cdf(abs(ef["z"] or 0.0)))) if some else None
    tails, shape, ways = one(P.trimmed(eps.where(F.col("phase") == best), value=y, trim=0.10)), one(P.describe(eps, value=y)), one(P.ols_check(eps, best, worst, y))
    facts = {
        "breakout_n": row(best, "n"), "breakout_mean": row(best, "mean"), "breakout_hit": row(best, "hit"), "accumulation_n": slow["n"], "accumulation_mean": slow["mean"], "accumulation_hit": slow["hit"], "flight_mean": row(worst, "mean"),
        "rho": get(one(P.monotonicity(eps, {p: k for k, p in enumerate(P.IN_ORDER)}, y)), "rho"), "in_order": sorted(means, key=lambda p: -means[p]) == list(means), "spread": get(sp, "spread") if min(get(sp, "na") or 0, get(sp, "nb") or 0) >= 8 else None, "spread_verdict": get(sp, "verdict"),
        "permutation_p": get(one(permutation_null(obs, best, worst, y)), "p") if shuffles else None, "csri_ic": ic("csri"), "momentum_ic": ic("mom_12_1"), "buckets": len(buckets), "bucket_gap": (buckets[max(buckets)] - buckets[min(buckets)]) if len(buckets) > 1 else None,
        "dominance": max(map(abs, comps)) / sum(map(abs, comps)) if len(comps) > 1 and sum(map(abs, comps)) else None, "cohen_d": ef["cohen_d"] if some else None, "tests_agree": (rank_p < 0.05) == (get(sp, "verdict") in ("POSITIVE", "INVERTED")) if some else None, "net_mean": get(one(P.performance(P.portfolio(obs, y=y))), "mean"),
        "outlier_driven": bool(tails["outlier_driven"]) and tails["se"] > 0 if (get(tails, "n") or 0) >= 10 else None, "skew": get(shape, "skew"), "excess_kurtosis": get(shape, "excess_kurtosis"), "ways_agree": abs(ways["difference"] - ways["slope"]) < 1e-6 if some else None,
        "stability": get(one(P.onset_stability(eps, best, worst, y)), "verdict"), "episodes": eps.count(), "dates": there["dates"],
    }
    # whether the spread that is asked for could have been seen
    facts["power"] = (power_analysis(int(ef["na"]), int(ef["nb"]), ef["pooled"], CRITERIA["breakout_mean"])["power"] if ef["pooled"] else 1.0) if some else None
    facts["red_flags"] = {r["check"]: r["severity"] for r in P.red_flags(obs, eps).where("raised").collect()}
    facts |= verdict(facts)
    return facts | confidence(facts)
