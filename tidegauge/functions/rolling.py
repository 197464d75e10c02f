"""Column functions over an instrument's bars: rolling windows with a minimum of values, lags, runs and blends.

A rolling value covers the last n rows, skips nulls, and is null unless at least m values are there. Zero denominators and
deviations give null, never NaN or infinity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY, TIME = "ticker", "session"


def ordered(key: str | list[str] = KEY, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(time)


def last_rows(n: int, skip: int = 0, key: str | list[str] = KEY, time: str = TIME) -> WindowSpec:
    """The n rows that end skip rows back."""
    return ordered(key, time).rowsBetween(-(n - 1) - skip, -skip)


def roll(fn: Callable[[Column], Column], x: str | Column, n: int, least: int, skip: int = 0) -> Column:
    x, w = (F.col(x) if isinstance(x, str) else x), last_rows(n, skip)
    return F.when(F.count(x).over(w) >= least, fn(x).over(w))


def mean(x, n: int, least: int | None = None) -> Column:
    return roll(F.avg, x, n, n if least is None else least)


def total(x, n: int, least: int | None = None) -> Column:
    return roll(F.sum, x, n, n if least is None else least)


def median(x, n: int, least: int, skip: int = 0) -> Column:
    """Linear-interpolated median over a frame; percentile(), unlike median(), takes frames."""
    return roll(lambda c: F.percentile(c, F.lit(0.5)), x, n, least, skip)


def ratio(a, b) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return a / F.nullif(b, F.lit(0.0))


def z(x, n: int, least: int | None = None) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    least = max(20, n // 4) if least is None else least
    w = last_rows(n)
    return F.when(F.count(x).over(w) >= least, (x - F.avg(x).over(w)) / F.nullif(F.stddev_pop(x).over(w), F.lit(0.0)))


def lag(x: str, k: int = 1) -> Column:
    return F.lag(x, k).over(ordered())


def lead(x: str, k: int = 1) -> Column:
    return F.lead(x, k).over(ordered())


def flag(condition: Column) -> Column:
    """1.0 or 0.0; an unknown condition counts as not met."""
    return F.when(condition, 1.0).otherwise(0.0)


def clip(x: Column, low: float, high: float) -> Column:
    """Nulls stay null; greatest() and least() alone would skip them."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def blend(parts: list[tuple[float, Column]]) -> Column:
    """Weighted mean over the parts that are there; a missing part's weight goes to the others."""
    over = sum((F.when(p.isNotNull(), F.lit(float(w))).otherwise(0.0) for w, p in parts), F.lit(0.0))
    return sum((F.coalesce(F.lit(float(w)) * p, F.lit(0.0)) for w, p in parts), F.lit(0.0)) / F.nullif(over, F.lit(0.0))


def position(key: str | list[str] = KEY, time: str = TIME) -> Column:
    return F.row_number().over(ordered(key, time))


def new_run(value: Column | str) -> Column:
    """1 where a value differs from the row before, 0 where it goes on; runs are its running sum."""
    value = F.col(value) if isinstance(value, str) else value
    before = F.lag(value).over(ordered())
    return F.when(position() == 1, 1).when(value.eqNullSafe(before), 0).otherwise(1)


def run_id(changed: str = "changed") -> Column:
    return F.sum(changed).over(ordered().rowsBetween(Window.unboundedPreceding, 0))


def average_rank(x: str, *keys: str) -> Column:
    """Rank from 1 with ties at their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2.0


def tidy(x, digits: int = 6) -> Column:
    """Rounded for output, without a negative zero; computations go on with unrounded columns."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x, digits) + F.lit(0.0)
