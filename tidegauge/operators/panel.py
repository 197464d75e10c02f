"""Walk-forward observations and the tests on them.

Indicators are causal, so the panel is one pass: the score frame filtered to rebalance sessions, with forward returns attached. Every
statistic is then a grouping or a window over the panel (date, ticker, tier, phase, csri, fwd_*, z_*). Per-group windows
sort within a date or a phase; nothing is collected but aggregates of a few numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import average_rank, blend, flag

HORIZONS = (5, 10, 21, 42, 63)
STEP = 20


def forward_returns(bars: DataFrame, bench: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """bars with fwd_h: the return over the next h of its own sessions less the benchmark's over the next h of its own, in 100; null near the end."""
    own, all_ = Window.partitionBy("ticker").orderBy("session"), Window.orderBy("session")
    # the benchmark is one series, a row a session
    b = bench.select("session", *[(F.lead("close", h).over(all_) / F.nullif("close", F.lit(0.0))).alias(f"_b{h}") for h in horizons])
    f = bars.withColumns({f"_o{h}": F.lead("close", h).over(own) / F.nullif("close", F.lit(0.0)) for h in horizons}).join(F.broadcast(b), "session")
    return f.withColumns({f"fwd_{h}": (F.col(f"_o{h}") - F.col(f"_b{h}")) * 100 for h in horizons}).drop(*[f"_{p}{h}" for p in "ob" for h in horizons])


def calendar(bench: DataFrame, step: int = STEP, warmup: int = 260, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """The benchmark's sessions: session, place of the first rebalance on or after it, whether it is one itself, the last place, and the
    benchmark's gross returns ahead (_b5, ...). Rebalances are every step-th session after warmup that leaves room for the longest horizon."""
    w = Window.orderBy("session")  # a row a session
    c = bench.select("session", (F.row_number().over(w) - 1).alias("_i"), *[(F.lead("close", h).over(w) / F.nullif("close", F.lit(0.0))).alias(f"_b{h}") for h in horizons])
    # the last place, from the number of sessions
    n = c.agg((F.floor((F.max("_i") + 1 - max(horizons) - 2 - warmup) / step)).cast("int").alias("_last"))
    c = c.crossJoin(F.broadcast(n)).withColumn("_place", F.greatest(F.lit(0), F.ceil((F.col("_i") - warmup) / step)).cast("int"))  # one row
    return c.withColumn("_rebalance", (F.col("_i") == warmup + step * F.col("_place")) & (F.col("_place") <= F.col("_last")))


def observations(scored: DataFrame, bench: DataFrame, step: int = STEP, warmup: int = 260, horizons: tuple[int, ...] = HORIZONS, least_bars: int = 260, least_names: int = 5) -> DataFrame:
    """The panel: on each rebalance date, every ticker's last row up to it (of tickers with enough bars, on dates with enough tickers) with fwd_h, the
    return over the next h of its own sessions less the benchmark's over the next h from the date, in 100. Rows without any are left out."""
    cal = calendar(bench, step, warmup, horizons)
    own = Window.partitionBy("ticker").orderBy("session")
    s = scored.withColumns({f"_o{h}": F.lead("close", h).over(own) / F.nullif("close", F.lit(0.0)) for h in horizons})
    s = s.join(F.broadcast(cal.select("session", "_place", "_last")), "session")
    # a row stands for the rebalances from its session to just before the ticker's next
    until = F.least(F.coalesce(F.lead("_place").over(own) - 1, F.col("_last")), F.col("_last"))
    s = s.withColumn("_until", until).where((F.col("_until") >= F.col("_place")) & (F.col("n_bars") >= least_bars))
    s = s.withColumn("_place", F.explode(F.sequence("_place", "_until"))).drop("session", "_last", "_until")
    o = s.join(F.broadcast(cal.where("_rebalance").select(F.col("session").alias("date"), "_place", *[f"_b{h}" for h in horizons])), "_place")
    o = o.withColumn("_k", F.count("*").over(Window.partitionBy("date"))).where(F.col("_k") >= least_names)
    o = o.withColumns({f"fwd_{h}": (F.col(f"_o{h}") - F.col(f"_b{h}")) * 100 for h in horizons})
    return o.drop("_k", "_place", *[f"_{p}{h}" for p in "ob" for h in horizons])


def with_returns(obs: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    return obs.where(F.coalesce(*[F.col(f"fwd_{h}") for h in horizons]).isNotNull())


def episodes(obs: DataFrame, carry: tuple[str, ...] = ("csri", "fwd_5", "fwd_21", "fwd_63")) -> DataFrame:
    """Runs of one phase by ticker over its observations: start, end, length and the first row's values."""
    w = Window.partitionBy("ticker").orderBy("date")
    e = obs.withColumn("_c", F.when(F.col("phase").eqNullSafe(F.lag("phase").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    e = e.withColumn("_g", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("ticker", "_g").agg(F.min_by(F.struct("tier", "phase", *carry), "date").alias("f"), F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("length_obs")).select("ticker", "f.*", "start", "end", "length_obs")


def summary(x: str) -> list[Column]:
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.stddev_samp(x).alias("sd"), (F.avg(F.when(F.col(x).isNotNull(), flag(F.col(x) > 0))) * 100).alias("hit")]


def phase_table(eps: DataFrame, x: str = "fwd_21") -> DataFrame:
    return eps.groupBy("phase").agg(*summary(x))


def ic_by_date(obs: DataFrame, x: str, y: str = "fwd_21", least: int = 6, distinct: int = 3, date: str = "date") -> DataFrame:
    """Rank correlation by date (ties at their mean), on dates with enough names and enough different values."""
    f = obs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    f = f.withColumns({"_rx": average_rank(x, date), "_ry": average_rank(y, date)})
    g = f.groupBy(date).agg(F.corr("_rx", "_ry").alias("ic"), F.count("*").alias("n"), F.countDistinct(x).alias("_dx"), F.countDistinct(y).alias("_dy"))
    return g.where((F.col("n") >= least) & (F.col("_dx") >= distinct) & (F.col("_dy") >= distinct)).select(date, "ic", "n")


def ic_summary(ics: DataFrame, *keys: str) -> DataFrame:
    g = ics.where("ic is not null").groupBy(*keys).agg(F.avg("ic").alias("mean_ic"), F.count("*").alias("dates"), F.stddev_samp("ic").alias("_s"), (F.avg(flag(F.round("ic", 9) > 0)) * 100).alias("positive"))
    return g.withColumn("t_stat", F.col("mean_ic") / F.nullif(F.col("_s") / F.sqrt("dates"), F.lit(0.0))).drop("_s")


def _scored(obs: DataFrame, models: dict[str, Column], horizons: tuple[int, ...], *carry: str) -> DataFrame:
    """A row for each model, horizon, date and ticker with a score and a return."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), c.alias("score")) for n, c in models.items()]))
    ahead = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("fwd")) for h in horizons]))
    keep = ("date", "ticker", *carry)
    return obs.select(*keep, each.alias("m"), *[f"fwd_{h}" for h in horizons]).select(*keep, "m.*", ahead.alias("h")).select(*keep, "model", "score", "h.*").where("score is not null and fwd is not null")


def _ics(long: DataFrame, *key: str) -> DataFrame:
    r = long.withColumns({"_rx": average_rank("score", *key), "_ry": average_rank("fwd", *key)})
    return r.groupBy(*key).agg(F.corr("_rx", "_ry").alias("ic"), F.count("*").alias("n"), F.countDistinct("score").alias("_d")).where("n >= 6 and _d >= 3 and ic is not null")


def ic_of_models(obs: DataFrame, models: dict[str, Column], horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Rank correlation of every model's score at every horizon: model, horizon, mean_ic, dates, positive, t_stat."""
    return ic_summary(_ics(_scored(obs, models, horizons), "model", "horizon", "date"), "model", "horizon")


def date_zscore(x: str) -> Column:
    """z-score among a date's names (sample deviation); null where they don't vary."""
    w = Window.partitionBy("date")
    return (F.col(x) - F.avg(x).over(w)) / F.nullif(F.stddev_samp(x).over(w), F.lit(0.0))


def global_rank(f: DataFrame, by: str, then: str, out: str = "_rank") -> DataFrame:
    """f with its rank (from 1) by (by, then) over all rows, and their number: rows are ranked within a value of by, and what stands before
    it is a running sum over those values alone."""
    per = f.groupBy(by).agg(F.count("*").alias("_here"))
    w = Window.orderBy(by)  # a row a value
    per = per.select(by, (F.sum("_here").over(w) - F.col("_here")).alias("_before"), F.sum("_here").over(Window.partitionBy(F.lit(1))).alias(f"{out}_n"))
    return f.join(per, by).withColumn(out, F.col("_before") + F.row_number().over(Window.partitionBy(by).orderBy(then))).drop("_before")


def quantile_block(k: Column | int, rank: str = "_rank") -> Column:
    """1 to k by linear-interpolated quantiles of ranks, each block closed at its upper edge."""
    return F.greatest(F.lit(1), F.ceil((F.col(rank) - 1) * k / F.nullif(F.col(f"{rank}_n") - 1, F.lit(0)))).cast("int")


#: The Sharpe ratio that a model has to beat, and the share of dates that are held out.
LEAST_SHARPE, HOLDOUT = 0.30, 0.30


def model_study(obs: DataFrame, models: dict[str, Column], base: str, even: str, horizons: tuple[int, ...] = HORIZONS, h: int = 21) -> DataFrame:
    """Fixed models against each other, a row each: ic_5, ..., ic_train and ic_holdout (the last three tenths of the dates) and ic_1 to ic_4
    (quarters of the panel) at h sessions, sign_stable, sharpe and net_ann of the costed book, positive (horizons), and the criteria: c1 beats base on the
    holdout, c2 sign stable, c3 beats even on the holdout, c4 Sharpe ratio, c5 most horizons positive; adopt if all hold (never for base and even)."""
    dates = obs.select("date").distinct().withColumns({"_i": F.row_number().over(Window.orderBy("date")), "_n": F.count("*").over(Window.partitionBy(F.lit(1)))})  # one row a date
    cut = dates.where(F.col("_i") == F.floor(F.col("_n") * (1 - HOLDOUT)) + 1).select(F.col("date").alias("cut"))
    o = global_rank(obs, "date", "ticker").withColumn("quarter", quantile_block(4))
    long = _scored(o, models, horizons, "quarter")
    whole = _ics(long, "model", "horizon", "date").crossJoin(F.broadcast(cut))  # one row
    at = lambda c: F.avg(F.when(c, F.col("ic")))
    now = F.col("horizon") == h
    g = whole.groupBy("model").agg(*[at(F.col("horizon") == x).alias(f"ic_{x}") for x in horizons], at(now & (F.col("date") < F.col("cut"))).alias("ic_train"), at(now & (F.col("date") >= F.col("cut"))).alias("ic_holdout"))
    q = _ics(long.where(now), "model", "quarter", "date").groupBy("model").agg(*[at(F.col("quarter") == x).alias(f"ic_q{x}") for x in (1, 2, 3, 4)])
    book = book_summary(costed_portfolio(long.where(now).select("model", "date", "ticker", "score", "fwd"), "score", "fwd", "model"), h, "model")
    g = g.join(q, "model", "left").join(book, "model", "left")
    quarters = [F.col(f"ic_q{x}") for x in (1, 2, 3, 4)]
    stable = sum((F.coalesce(F.round(c, 3) > 0, F.lit(False)).cast("int") for c in quarters), F.lit(0)) == 4
    plus = sum((F.coalesce(F.round(f"ic_{x}", 4) > 0, F.lit(False)).cast("int") for x in horizons), F.lit(0))
    there = sum((F.col(f"ic_{x}").isNotNull().cast("int") for x in horizons), F.lit(0))
    of = lambda m: F.max(F.when(F.col("model") == m, F.round("ic_holdout", 4))).over(Window.partitionBy(F.lit(1)))  # noqa: E731  a row a model
    mine = F.round("ic_holdout", 4)
    g = g.withColumns({"sign_stable": stable, "positive": plus, "c1": F.coalesce(mine > of(base), F.lit(False)), "c2": stable, "c3": F.coalesce(mine > of(even), F.lit(False)), "c4": F.coalesce(F.round("sharpe", 3) > LEAST_SHARPE, F.lit(False)), "c5": plus > there / 2})
    return g.withColumn("adopt", F.col("c1") & F.col("c2") & F.col("c3") & F.col("c4") & F.col("c5") & ~F.col("model").isin(base, even))


def component_days(obs: DataFrame, components: tuple[str, ...], y: str = "fwd_21", least: int = 6) -> DataFrame:
    """By component and date (of enough names): the top tercile's mean return less the bottom's (inclusive edges), and the names."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("x")) for c in components]))
    long = obs.select("date", F.col(y).alias("y"), each.alias("e")).select("date", "y", "e.*").where("x is not null and y is not null")
    edges = long.groupBy("component", "date").agg(F.percentile("x", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"), F.count("*").alias("n"))
    j = long.join(edges, ["component", "date"])
    top, low = F.avg(F.when(F.col("x") >= F.col("q")[1], F.col("y"))), F.avg(F.when(F.col("x") <= F.col("q")[0], F.col("y")))
    return j.groupBy("component", "date").agg(F.when(F.first("n") >= least, top - low).alias("spread"), F.first("n").alias("n"))


def component_spread(obs: DataFrame, components: tuple[str, ...], y: str = "fwd_21", least: int = 6, least_rows: int = 200, least_dates: int = 20) -> DataFrame:
    """By component: rows, dates, and the mean over dates of its spread (null with too few rows or dates)."""
    g = component_days(obs, components, y, least).groupBy("component").agg(F.sum("n").alias("n"), F.count("spread").alias("dates"), F.avg("spread").alias("spread"), F.avg(F.when(F.col("spread").isNotNull(), flag(F.col("spread") > 0))).alias("share_positive"))
    enough = (F.col("n") >= least_rows) & (F.col("dates") >= least_dates)
    return g.select("component", "n", "dates", F.when(enough, F.col("spread")).alias("spread"), F.when(enough, F.col("share_positive")).alias("share_positive"))


def transitions(eps: DataFrame) -> DataFrame:
    """From each phase, the share (in 100) of episodes that each phase follows."""
    nxt = F.lead("phase").over(Window.partitionBy("ticker").orderBy("start"))
    t = eps.withColumn("to_phase", nxt).where("to_phase is not null").groupBy(F.col("phase").alias("from_phase"), "to_phase").agg(F.count("*").alias("n"))
    return t.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("from_phase")))


def quantile_bucket(x: str, k: int, *keys: str) -> Column:
    """1 to k by linear-interpolated quantile edges within the keys, each bucket closed at its upper edge."""
    w = Window.partitionBy(*keys)
    return F.lit(1) + sum((F.when(F.col(x) > F.percentile(x, F.lit(i / k)).over(w), 1).otherwise(0) for i in range(1, k)), F.lit(0))


def bucketed(obs: DataFrame, x: str = "csri", y: str = "fwd_21", least_rows: int = 300) -> DataFrame:
    """Rows with a bucket of the score among the date's names: 5, 3 or 2 buckets as the median date has 20, 9 or fewer names. Dates with fewer
    different scores than buckets drop out; with too few rows nothing is left."""
    f = obs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    k = f.groupBy("date").count().agg(F.percentile("count", F.lit(0.5)).alias("m"), F.sum("count").alias("_rows")).where(F.col("_rows") >= least_rows).select(F.when(F.col("m") >= 20, 5).when(F.col("m") >= 9, 3).otherwise(2).alias("n_buckets"))
    b = {n: quantile_bucket(x, n, "date") for n in (2, 3, 5)}
    f = f.withColumns({f"_b{n}": c for n, c in b.items()} | {"_kinds": F.size(F.collect_set(x).over(Window.partitionBy("date")))}).crossJoin(F.broadcast(k))  # one row
    f = f.where(F.col("_kinds") >= F.col("n_buckets"))
    return f.withColumn("bucket", F.when(F.col("n_buckets") == 5, F.col("_b5")).when(F.col("n_buckets") == 3, F.col("_b3")).otherwise(F.col("_b2"))).drop("_b2", "_b3", "_b5", "_kinds")


def score_buckets(obs: DataFrame, x: str = "csri", y: str = "fwd_21", least_rows: int = 300) -> DataFrame:
    return bucketed(obs, x, y, least_rows).groupBy("bucket", "n_buckets").agg(*summary(y))


def subperiods(eps: DataFrame, a: str = "CONFIRMED_BREAKOUT", b: str = "CAPITAL_FLIGHT", y: str = "fwd_21", k: int = 4, least: int = 5) -> DataFrame:
    """The spread of phase a over b in consecutive periods with as many episodes each; k of them, or one for 40 episodes (two at least) where
    there are fewer than 20 for each. A mean needs least episodes."""
    f = global_rank(eps.where(F.col(y).isNotNull()), "start", "ticker")
    n = F.col("_rank_n")
    f = f.withColumn("period", quantile_block(F.when(n < k * 20, F.greatest(F.lit(2), F.floor(n / 40))).otherwise(k)))
    ina, inb = F.col("phase") == a, F.col("phase") == b
    mean = lambda c: F.when(F.sum(flag(c)) >= least, F.avg(F.when(c, F.col(y))))
    g = f.groupBy("period").agg(F.min("start").alias("from"), F.max("start").alias("to"), F.count("*").alias("episodes"), F.sum(ina.cast("int")).alias("na"), F.sum(inb.cast("int")).alias("nb"), mean(ina).alias("mean_a"), mean(inb).alias("mean_b"))
    return g.withColumn("spread", F.col("mean_a") - F.col("mean_b"))


def held_and_onset(obs: DataFrame, eps: DataFrame, y: str = "fwd_21") -> DataFrame:
    """By phase, returns of all observations (held) and of episodes' first ones (onset)."""
    h = obs.groupBy("phase").agg(F.count(y).alias("held_n"), F.avg(y).alias("held_mean"))
    o = eps.groupBy("phase").agg(F.count(y).alias("onset_n"), F.avg(y).alias("onset_mean"))
    return h.join(o, "phase", "full")


def _sides(f: DataFrame, x: str, keys: tuple[str, ...], names: Column, least_rows: int) -> DataFrame:
    """f with _top and _low (places from either end of a date), _side (names a side, from the median date) and _m; nothing with too few rows."""
    w = Window.partitionBy(*keys, "date")
    k = f.groupBy(*keys, "date").count().groupBy(*keys).agg(F.percentile("count", F.lit(0.5)).alias("m"), F.sum("count").alias("_rows")).where(F.col("_rows") >= least_rows)
    k = F.broadcast(k.select(*keys, names.alias("_side")))  # a row for each of keys
    f = f.withColumns({"_top": F.row_number().over(w.orderBy(F.desc(x), "ticker")), "_low": F.row_number().over(w.orderBy(x, F.desc("ticker"))), "_m": F.count("*").over(w)})
    return f.join(k, list(keys)) if keys else f.crossJoin(k)


def portfolio(obs: DataFrame, x: str = "csri", y: str = "fwd_21", cost_bps: float = 5.0, least_rows: int = 200, least_dates: int = 10) -> DataFrame:
    """By date: a book half long the best and half short the worst names (a fifth of the median date each where that has 20, else a third), the
    turnover of its signed weights (2 at first), and the return before and after costs. Nothing with too few rows or dates."""
    f = obs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    f = _sides(f, x, (), F.greatest(F.lit(1), F.floor(F.when(F.col("m") >= 20, F.col("m") / 5).otherwise(F.col("m") / 3))), least_rows)
    n = F.least("_side", "_m")
    f = f.withColumns({"long": F.when(F.col("_top") <= n, 1.0 / n).otherwise(0.0), "short": F.when(F.col("_low") <= n, 1.0 / n).otherwise(0.0)}).where("long > 0 or short > 0")
    book = f.select("date", "ticker", (F.col("long") - F.col("short")).alias("weight"), F.col(y).alias("y"))
    days = book.select("date").distinct().withColumns({"_i": F.row_number().over(Window.orderBy("date")), "_n": F.count("*").over(Window.partitionBy(F.lit(1)))}).where(F.col("_n") >= least_dates).drop("_n")  # one row a date
    book = book.join(F.broadcast(days), "date")
    then = book.select((F.col("_i") + 1).alias("_i"), "ticker", F.col("weight").alias("before"))
    moved = book.select("_i", "ticker", "weight").join(then, ["_i", "ticker"], "full").groupBy("_i").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))).alias("_t"))
    r = book.groupBy("date", "_i").agg((F.sum(F.col("weight") * F.col("y")) / 2).alias("gross")).join(moved, "_i").withColumn("turnover", F.when(F.col("_i") == 1, 2.0).otherwise(F.col("_t")))
    return r.withColumn("net", F.col("gross") - F.col("turnover") * cost_bps / 100).select("date", "gross", "turnover", "net")


def performance(rets: DataFrame, x: str = "net", per_year: float = 252 / 21) -> DataFrame:
    """Of returns by date (in 100): mean, deviation, annualised return before and after costs, cost drag, volatility, Sharpe ratio, share of gains, and
    the deepest fall of the compounded equity below its highest point so far."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    # a running product by logarithms; a loss of over 100 turns its sign, as a product would
    step = 1 + F.col(x) / 100
    odd = F.sum(F.when(step < 0, 1).otherwise(0)).over(w) % 2
    r = rets.withColumn("_e", F.exp(F.sum(F.ln(F.nullif(F.abs(step), F.lit(0.0)))).over(w)) * (1 - 2 * odd))
    r = r.withColumn("_d", F.col("_e") / F.max("_e").over(w) - 1)
    g = r.agg(F.count(x).alias("periods"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), (F.avg("gross") * per_year).alias("gross_annualised"), (F.min("_d") * 100).alias("max_drawdown"), F.avg("turnover").alias("turnover"), (F.avg(flag(F.col(x) > 0)) * 100).alias("hit"))
    g = g.withColumns({"net_annualised": F.col("mean") * per_year, "volatility": F.col("sd") * per_year**0.5})
    return g.withColumns({"sharpe": F.col("net_annualised") / F.nullif("volatility", F.lit(0.0)), "cost_drag": F.col("gross_annualised") - F.col("net_annualised"), "survives_costs": F.col("net_annualised") > 0})


def costed_portfolio(obs: DataFrame, x: str = "csri", y: str = "fwd_21", *keys: str, cost_bps: float = 5.0, least_rows: int = 200, least_dates: int = 10) -> DataFrame:
    """By date (and keys): half the spread of the best over the worst fifth of the median date's names, the share of names that entered or left
    among those held now or before (1 at first), and the return after costs on that share. Nothing with too few rows or dates."""
    f = _sides(obs.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, keys, F.greatest(F.lit(1), F.floor(F.col("m") / 5)), least_rows)
    best, worst = F.col("_top") <= F.col("_side"), F.col("_low") <= F.col("_side")
    g = f.groupBy(*keys, "date").agg(F.collect_set(F.when(best | worst, F.col("ticker"))).alias("names"), ((F.avg(F.when(best, F.col(y))) - F.avg(F.when(worst, F.col(y)))) / 2).alias("gross"))
    w = Window.partitionBy(*keys).orderBy("date") if keys else Window.orderBy("date")  # one row a date
    g = g.withColumns({"_b": F.lag("names").over(w), "_n": F.count("*").over(Window.partitionBy(*(keys or [F.lit(1)])))}).where(F.col("_n") >= least_dates)
    moved = F.size(F.array_except("names", "_b")) + F.size(F.array_except("_b", "names"))
    g = g.withColumn("churn", F.when(F.col("_b").isNull(), 1.0).otherwise(moved / F.size(F.array_union("names", "_b"))))
    return g.select(*keys, "date", "gross", "churn", (F.col("gross") - F.col("churn") * cost_bps / 100).alias("net"))


def book_summary(book: DataFrame, horizon: int = 21, *keys: str, step: int = STEP) -> DataFrame:
    """Annualised net return and Sharpe ratio of a costed book that is rebalanced every step sessions and held for horizon."""
    g = book.groupBy(*keys).agg(F.count("*").alias("rebalances"), (F.avg("net") * (252 / horizon)).alias("net_ann"), (F.stddev_samp("net") * (252 / step) ** 0.5).alias("_s"))
    return g.withColumn("sharpe", F.col("net_ann") / F.nullif("_s", F.lit(0.0))).drop("_s")


def monotonicity(eps: DataFrame, ranks: dict[str, int], y: str = "fwd_21", least: int = 8) -> DataFrame:
    """Rank correlation between the phases' given order (best first) and their mean returns."""
    m = phase_table(eps, y).where(F.col("n") >= least).withColumn("_p", F.coalesce(*[F.when(F.col("phase") == p, float(-k)) for p, k in ranks.items()]))
    m = m.withColumns({"_a": F.rank().over(Window.orderBy("_p")), "_b": F.rank().over(Window.orderBy("mean"))})
    return m.agg(F.corr(F.col("_a").cast("double"), F.col("_b").cast("double")).alias("rho"), F.count("*").alias("phases")).select(F.when(F.col("phases") >= 3, F.col("rho")).alias("rho"), "phases")


def bh_adjust(tests: DataFrame, p: str = "p") -> DataFrame:
    """Benjamini-Hochberg: q-values over a table of tests."""
    w = Window.orderBy(p)
    m = F.count("*").over(Window.partitionBy(F.lit(1)))
    t = tests.withColumns({"_k": F.row_number().over(w), "_m": m})
    worst = F.min(F.col(p) * F.col("_m") / F.col("_k")).over(Window.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("q", F.least(F.lit(1.0), worst)).drop("_k", "_m")


def describe(x: DataFrame, *keys: str, value: str = "x") -> DataFrame:
    q = F.percentile(value, F.array(*[F.lit(v / 100) for v in (1, 5, 25, 50, 75, 95, 99)]))
    g = x.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("excess_kurtosis"), F.min(value).alias("low"), F.max(value).alias("high"), q.alias("_q"))
    names = ("p1", "p5", "p25", "p50", "p75", "p95", "p99")
    return g.select(*keys, "n", "mean", "sd", "skew", "excess_kurtosis", "low", "high", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def trimmed(x: DataFrame, *keys: str, value: str = "x", trim: float = 0.05) -> DataFrame:
    """Means: plain, without the trim share at each end, with it pulled in, and without the most extreme value; and whether outliers drive it (a gap of over one standard error)."""
    w = Window.partitionBy(*keys)
    f = x.where(F.col(value).isNotNull()).withColumns({"_r": F.row_number().over(w.orderBy(value)), "_n": F.count("*").over(w)})
    f = f.withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_n") * trim)))
    inside = (F.col("_r") > F.col("_k")) & (F.col("_r") <= F.col("_n") - F.col("_k"))
    f = f.withColumns({"_lo": F.min(F.when(inside, F.col(value))).over(w), "_hi": F.max(F.when(inside, F.col(value))).over(w)})
    g = f.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg(F.when(inside, F.col(value))).alias("trimmed_mean"), F.avg(F.least(F.greatest(value, "_lo"), "_hi")).alias("winsorised_mean"), ((F.sum(value) - F.max_by(value, F.abs(value))) / F.nullif(F.count("*") - 1, F.lit(0))).alias("without_extreme"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("se"))
    return g.withColumn("outlier_driven", F.abs(F.col("mean") - F.col("trimmed_mean")) > F.col("se"))


def two_groups(x: DataFrame, group: str, a: str, b: str, value: str = "x", *keys: str) -> DataFrame:
    """Effect size and rank test of group a over b: Cohen's d (pooled), Hedges' g, U with ties at their mean, AUC = P(a > b) + P(a = b) / 2, z with tie correction."""
    f = x.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).withColumn("_r", average_rank(value, *keys) if keys else _rank_all(value))
    ties = f.groupBy(*keys, value).agg(F.count("*").alias("_t")).groupBy(*keys).agg(F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("tie_sum"))
    ina, inb = F.col(group) == a, F.col(group) == b
    v = F.col(value)
    g = f.groupBy(*keys).agg(F.sum(flag(ina)).alias("na"), F.sum(flag(inb)).alias("nb"), F.avg(F.when(ina, v)).alias("ma"), F.avg(F.when(inb, v)).alias("mb"), F.var_samp(F.when(ina, v)).alias("va"), F.var_samp(F.when(inb, v)).alias("vb"), F.sum(F.when(ina, F.col("_r"))).alias("ra"))
    g = g.join(ties, list(keys)) if keys else g.crossJoin(F.broadcast(ties))
    na, nb, n = F.col("na"), F.col("nb"), F.col("na") + F.col("nb")
    pooled = F.sqrt(((na - 1) * F.col("va") + (nb - 1) * F.col("vb")) / F.nullif(n - 2, F.lit(0.0)))
    g = g.withColumn("pooled", pooled).withColumn("cohen_d", (F.col("ma") - F.col("mb")) / F.nullif("pooled", F.lit(0.0))).withColumn("hedges_g", F.col("cohen_d") * (1 - 3 / (4 * n - 9)))
    g = g.withColumn("u", F.col("ra") - na * (na + 1) / 2).withColumn("auc", F.col("u") / F.nullif(na * nb, F.lit(0.0)))
    var = na * nb / 12 * ((n + 1) - F.col("tie_sum") / F.nullif(n * (n - 1), F.lit(0.0)))
    d = F.abs("cohen_d")
    g = g.withColumn("z", (F.col("u") - na * nb / 2) / F.nullif(F.sqrt(var), F.lit(0.0)))
    return g.withColumn("magnitude", F.when(d < 0.2, "negligible").when(d < 0.5, "small").when(d < 0.8, "medium").otherwise("large")).select(*keys, "na", "nb", "ma", "mb", "cohen_d", "hedges_g", "u", "auc", "z", "magnitude", "pooled")


def _rank_all(x: str) -> Column:
    # ranks over the whole table; the panel is an aggregate of a row a ticker and rebalance date
    return F.rank().over(Window.orderBy(x)) + (F.count("*").over(Window.partitionBy(x)) - 1) / 2.0


def segment_stability(obs: DataFrame, a: str, b: str, y: str = "fwd_21", k: int = 4, least: int = 15) -> DataFrame:
    """Whether the spread of phase a over b has the same sign in k blocks of time (15 of each in a block at least): STABLE, MIXED or UNSTABLE."""
    f = global_rank(obs.where(F.col("phase").isin(a, b) & F.col(y).isNotNull()), "date", "ticker").withColumn("block", F.least(F.lit(k), F.floor((F.col("_rank") - 1) * k / F.col("_rank_n")) + 1).cast("int"))
    ina, inb = F.col("phase") == a, F.col("phase") == b
    s = f.groupBy("block").agg(F.sum(flag(ina)).alias("na"), F.sum(flag(inb)).alias("nb"), (F.avg(F.when(ina, F.col(y))) - F.avg(F.when(inb, F.col(y)))).alias("spread")).where((F.col("na") >= least) & (F.col("nb") >= least))
    whole = f.agg((F.avg(F.when(ina, F.col(y))) - F.avg(F.when(inb, F.col(y)))).alias("overall"))
    j = s.crossJoin(F.broadcast(whole)).groupBy("overall").agg(F.count("*").alias("blocks"), F.avg(flag(F.signum("spread") == F.signum("overall"))).alias("agreement"))
    return j.withColumn("verdict", F.when(F.col("agreement") >= 0.8, "STABLE").when(F.col("agreement") >= 0.5, "MIXED").otherwise("UNSTABLE"))


def onset_stability(eps: DataFrame, a: str, b: str, y: str = "fwd_21", k: int = 4, least: int = 15, least_rows: int = 60) -> DataFrame:
    """Whether the spread of phase a over b at episodes' starts has the same sign in blocks of time with as many episodes each: k of them, or one for
    40 episodes (two at least). A spread needs least of each phase; verdict is null without one, or unless there are over least_rows episodes."""
    f = global_rank(eps.where(F.col(y).isNotNull()), "start", "ticker")
    f = f.withColumn("block", quantile_block(F.least(F.lit(k), F.greatest(F.lit(2), F.floor(F.col("_rank_n") / 40)))))
    ina, inb = F.col("phase") == a, F.col("phase") == b
    part = lambda c, name: [F.sum(c.cast("int")).alias(f"n{name}"), F.sum(F.when(c, F.col(y))).alias(f"s{name}")]
    g = f.groupBy("block").agg(*part(ina, "a"), *part(inb, "b"))
    spread = lambda na, nb, sa, sb: F.when((na >= least) & (nb >= least), sa / na - sb / nb)
    g = g.withColumn("spread", spread(*map(F.col, ("na", "nb", "sa", "sb"))))
    g = g.agg(spread(*map(F.sum, ("na", "nb", "sa", "sb"))).alias("overall"), F.count("spread").alias("blocks"), F.collect_list(F.signum("spread")).alias("_s"))
    g = g.crossJoin(F.broadcast(eps.agg((F.count("*") > least_rows).alias("_enough"))))  # one row
    g = g.withColumn("agreeing", F.size(F.filter("_s", lambda x: x == F.signum("overall"))))
    share = F.col("agreeing") / F.nullif("blocks", F.lit(0))
    known = F.col("_enough") & F.col("overall").isNotNull() & (F.col("blocks") > 0)
    return g.select("overall", "blocks", "agreeing", F.when(known, F.when(share >= 0.8, "STABLE").when(share >= 0.5, "MIXED").otherwise("UNSTABLE")).alias("verdict"))


#: Phases from the best on, as the theory has them.
IN_ORDER = ("CONFIRMED_BREAKOUT", "STEALTH_ACCUMULATION", "NEUTRAL", "DISTRIBUTION", "CAPITAL_FLIGHT")


def _phase_checks(h: int) -> list[tuple[str, Column, Column, str]]:
    """Checks of one horizon over an array p of phases (n, c, m, h: count, mean and hit rate of returns)."""
    count, mean_, hit = (lambda r: r[f"c{h}"]), (lambda r: r[f"m{h}"]), (lambda r: r[f"h{h}"])
    pinned = F.size(F.filter("p", lambda r: (count(r) >= 10) & hit(r).isin(0.0, 1.0))).cast("double")
    means = F.transform(F.filter("p", lambda r: mean_(r).isNotNull()), lambda r: F.round(mean_(r), 6))
    kinds = F.size(F.array_distinct(means))
    ordered = F.array_compact(F.array(*[F.get(F.transform(F.filter("p", lambda r: r["phase"] == n), lambda r: mean_(r)), F.lit(0)) for n in IN_ORDER]))  # noqa: B023
    gaps = F.zip_with(F.slice(ordered, 2, len(IN_ORDER)), F.slice(ordered, F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(0))), lambda x, y: x - y)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n = F.nullif(F.size(gaps).cast("double"), F.lit(0.0))
    mean = total(gaps) / n
    sd = F.sqrt(F.greatest(total(F.transform(gaps, lambda x: x * x)) / n - mean * mean, F.lit(0.0)))
    even = sd / (F.abs(mean) + 1e-9)
    four = F.size(ordered) >= 4
    return [
        (f"missing fwd_{h}", F.col(f"miss{h}"), F.col(f"miss{h}") > 0.02, "medium"), (f"hit rate at boundary {h}", pinned, pinned > 0, "high"), (f"identical means {h}", kinds.cast("double"), (F.size(means) >= 3) & (kinds == 1), "high"),
        (f"too clean {h}", F.when(four, even), four & F.forall(gaps, lambda x: x < 0) & (even < 0.10), "medium"),
    ]


def red_flags(obs: DataFrame, eps: DataFrame, horizons: tuple[int, ...] = (21, 63)) -> DataFrame:
    """What calls a panel into question: check (with the horizon, phase or component it is about), value, raised, severity (high: an error, not a finding).
    Phase checks look at episodes."""
    phases = eps.groupBy("phase").agg(F.count("*").alias("n"), *[x for h in horizons for x in (F.count(f"fwd_{h}").alias(f"c{h}"), F.avg(f"fwd_{h}").alias(f"m{h}"), F.avg(F.when(F.col(f"fwd_{h}").isNotNull(), flag(F.col(f"fwd_{h}") > 0))).alias(f"h{h}"))])
    # a row a phase: one array of them all
    p = phases.agg(F.collect_list(F.struct("*")).alias("p"), F.count("*").alias("phases"), (F.max("n") / F.sum("n")).alias("share"))
    zs = [c for c in obs.columns if c.startswith("z_")]
    a = obs.agg(F.count("*").alias("rows"), *[F.avg(flag(F.col(f"fwd_{h}").isNull())).alias(f"miss{h}") for h in horizons], *[F.stddev_samp(c).alias(f"sd_{c}") for c in zs], *[F.count(c).alias(f"n_{c}") for c in zs], *[(F.min(c) == F.max(c)).alias(f"one_{c}") for c in zs])
    dup = obs.groupBy("date", "ticker").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).cast("double").alias("dups"))
    length = eps.agg(F.percentile("length_obs", F.lit(0.5)).alias("length"))
    one = a.crossJoin(F.broadcast(p)).crossJoin(F.broadcast(dup)).crossJoin(F.broadcast(length))  # one row each
    some = F.col("rows") > 0
    checks = [("empty", F.col("rows").cast("double"), F.col("rows") == 0, "high")]
    for h in horizons:
        checks += _phase_checks(h)
    checks += [(f"constant {c}", F.col(f"sd_{c}"), (F.col(f"n_{c}") > 50) & (F.col(f"sd_{c}") < 1e-6), F.when(F.col(f"one_{c}"), "high").otherwise("medium")) for c in zs]
    checks += [("concentration", F.col("share"), F.col("share") > 0.85, "medium"), ("few phases", F.col("phases").cast("double"), F.col("phases").between(1, 2), "medium"), ("duplicates", F.col("dups"), F.col("dups") > 0, "high"), ("episodes of one observation", F.col("length"), F.col("length") <= 1, "medium")]
    # an empty panel raises nothing else
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), v.alias("value"), F.coalesce(r if n == "empty" else some & r, F.lit(False)).alias("raised"), (F.lit(k) if isinstance(k, str) else k).alias("severity")) for n, v, r, k in checks])).alias("c")).select("c.*")


def ols_check(obs: DataFrame, a: str, b: str, y: str = "fwd_21") -> DataFrame:
    """The spread of phase a over b twice: as a difference of means and as the slope on a dummy."""
    f = obs.where(F.col("phase").isin(a, b) & F.col(y).isNotNull()).withColumn("_x", flag(F.col("phase") == a))
    return f.agg((F.avg(F.when(F.col("_x") == 1, F.col(y))) - F.avg(F.when(F.col("_x") == 0, F.col(y)))).alias("difference"), F.regr_slope(y, "_x").alias("slope"), F.count("*").alias("n"))


def concordance(obs: DataFrame, x: str = "csri", y: str = "fwd_21", least: int = 3) -> DataFrame:
    """Over pairs of tickers on one date (a date's few tickers only), the share on which the higher score had the higher return; ties on either side don't count."""
    f = obs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("date", "ticker", F.col(x).alias("x"), F.col(y).alias("y")).withColumn("_n", F.count("*").over(Window.partitionBy("date"))).where(F.col("_n") >= least)
    o = f.select("date", F.col("ticker").alias("t2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    j = f.join(o, "date").where("ticker < t2 and x <> x2 and y <> y2")
    return j.agg(F.count("*").alias("pairs"), (F.avg(flag(F.signum(F.col("x") - F.col("x2")) == F.signum(F.col("y") - F.col("y2")))) * 100).alias("concordant"))


def embargo_split(obs: DataFrame, share: float = 0.7, horizon: int = 21) -> DataFrame:
    """train, test or embargo by date: the cut at a share of the dates, training ends one and a half horizons of days before it."""
    d = obs.select("date").distinct()
    cut = d.withColumns({"_i": F.row_number().over(Window.orderBy("date")), "_n": F.count("*").over(Window.partitionBy(F.lit(1)))}).where(F.col("_i") == F.floor(F.col("_n") * share) + 1).select(F.col("date").alias("cut"))
    gap = int(1.5 * horizon)
    return obs.crossJoin(F.broadcast(cut)).withColumn("part", F.when(F.col("date") >= F.col("cut"), "test").when(F.col("date") < F.date_sub("cut", gap), "train").otherwise("embargo")).drop("cut")


def weighted_score(weights: dict[str, float]) -> Column:
    """A blend of columns, renormalised over what a row has."""
    return blend([(w, F.col(c)) for c, w in weights.items()])
