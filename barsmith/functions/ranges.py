"""One ordered series over many tasks.

A window over a ticker puts the whole series into one task. Here rows are numbered from counts: each week of a ticker is a
group of its own, and a week's rows go on from the sum of the counts of the weeks before, of which there are few. Rows are
then cut into ranges of PART rows by number. A range also gets copies of the rows next to it that its first or last frames
need (a halo), so that windows over ranges give what windows over tickers would; the copies go afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import KEY, TIME

#: Rows of a series in one range.
PART = 16_384


def _stretch(df: DataFrame, time: str) -> Column:
    """The week of a time; of numbers, the multiple of 65,536. It grows with time and says which rows are numbered together."""
    kind = dict(df.dtypes)[time]
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.floor((F.unix_date(F.col(time).cast("date")) + 3) / 7)
    return F.floor(F.col(time) / 65_536)


def with_index(df: DataFrame, key: str = KEY, time: str = TIME, previous: tuple[str, ...] = ()) -> DataFrame:
    """Adds _i, the row's position in its series, from 0, and ``_prev_x`` for each column x of ``previous``: its value in the
    row before. Rows without a key or a time are in no series and go. Rows of one time are numbered in any order."""
    rows = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("_week", _stretch(df, time))
    counts = rows.groupBy(key, "_week").agg(F.count("*").alias("_rows"), *[F.max_by(c, time).alias(f"_end_{c}") for c in previous])
    w, weeks = W.partitionBy(key, "_week").orderBy(time), W.partitionBy(key).orderBy("_week")
    before = F.coalesce(F.sum("_rows").over(weeks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(key, "_week", before.alias("_start"), *[F.lag(f"_end_{c}").over(weeks).alias(f"_end_{c}") for c in previous])
    rows = rows.withColumns({"_at": F.row_number().over(w)} | {f"_lag_{c}": F.lag(c).over(w) for c in previous}).join(starts, [key, "_week"])
    out = {"_i": (F.col("_start") + F.col("_at") - 1).cast("int")}
    out |= {f"_prev_{c}": F.when(F.col("_at") == 1, F.col(f"_end_{c}")).otherwise(F.col(f"_lag_{c}")) for c in previous}
    return rows.withColumns(out).select(*df.columns, *out)


def in_ranges(df: DataFrame, before: int = 0, after: int = 0, part: int = PART) -> DataFrame:
    """Rows (with _i, which is added if need be) by range: ``_part``, and ``_own``, false for the copies of ``before`` rows
    ahead of a range and ``after`` rows behind it."""
    if max(before, after) > part:
        raise ValueError(f"frames of more than {part} rows need longer ranges")
    rows = df if "_i" in df.columns else with_index(df)
    own, at = F.floor(F.col("_i") / part), F.col("_i") % part
    if not before and not after:
        return rows.withColumns({"_part": own, "_own": F.lit(True)})
    parts = [own, F.when(at >= part - before, own + 1) if before else None, F.when((at < after) & (own > 0), own - 1) if after else None]
    rows = rows.withColumn("_part", F.explode(F.array_compact(F.array(*[p for p in parts if p is not None]))))
    return rows.withColumn("_own", F.col("_part") == own)


def ranged(key: str = KEY) -> WindowSpec:
    """The order of a series within a range."""
    return W.partitionBy(key, "_part").orderBy("_i")


def own_rows(df: DataFrame, *keep: str) -> DataFrame:
    """Without the copies and the columns of :func:`in_ranges`, but for those of ``keep``."""
    return df.where("_own").drop(*{"_own", "_part", "_i"} - {*keep})


def over_ranges(df: DataFrame, *stages: Callable[[WindowSpec], dict[str, Column]], before: int = 0, after: int = 0, part: int = PART) -> DataFrame:
    """``df`` with the columns of each of ``stages``, which get the window to use; later stages see the columns of earlier
    ones. ``before`` and ``after`` are the rows that all stages together look back and ahead."""
    rows = in_ranges(df, before, after, part)
    for stage in stages:
        rows = rows.withColumns(stage(ranged()))
    return own_rows(rows, *df.columns)
