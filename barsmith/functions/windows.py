"""Ordered per-ticker window expressions. Missing is NULL, never NaN; divisions by zero give NULL."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY, TIME = "ticker", "ts"


def ordered(key: str = KEY, time: str = TIME) -> WindowSpec:
    return W.partitionBy(key).orderBy(time)


def last(n: int, w: WindowSpec | None = None) -> WindowSpec:
    """The n rows that end at the current one."""
    return (w or ordered()).rowsBetween(-(n - 1), 0)


def upto(w: WindowSpec | None = None) -> WindowSpec:
    """All rows up to the current one."""
    return (w or ordered()).rowsBetween(W.unboundedPreceding, 0)


def lagged(x: Column | str, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(x, n).over(w or ordered())


def full(x: Column | str, n: int, agg, w: WindowSpec | None = None) -> Column:
    """``agg(x)`` over the last n rows, NULL unless all n values are there."""
    x = F.col(x) if isinstance(x, str) else x
    frame = last(n, w)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def wide_mean(x: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    """Mean of the last n non-null values as a difference of running sums: one pass, whatever n."""
    w = w or ordered()
    total = F.sum(x).over(upto(w))
    return F.when(F.count(x).over(upto(w)) >= n, (total - F.coalesce(F.lag(total, n).over(w), F.lit(0.0))) / n)


def change(x: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    """x / x before n rows - 1."""
    x = F.col(x) if isinstance(x, str) else x
    return F.try_divide(x, lagged(x, n, w)) - 1


def flag(condition: Column) -> Column:
    """1 or 0, and 0 where the condition is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def clip(x: Column, low: float, high: float) -> Column:
    """Bounds x; NULL stays NULL (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(x, F.lit(high))))


def no_nan(x: Column) -> Column:
    """NaN and infinities as NULL, for imported values."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
