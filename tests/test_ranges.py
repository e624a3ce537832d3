"""Series over ranges against series in one task."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barsmith.functions.ranges import in_ranges, over_ranges, own_rows, with_index
from barsmith.functions.scan import Recurrence, affine_scan, ema
from barsmith.functions.windows import change, full, wide_mean
from barsmith.operators import features
from barsmith.plans import fixtures

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    """Two tickers of unlike density, weeks without rows, missing values."""
    r = random.Random(4)
    rows = []
    for ticker, n, step in (("A", 700, 5_000), ("B", 90, 400_000), ("C", 1, 1)):
        at = T0
        for k in range(n):
            at += dt.timedelta(seconds=r.randint(1, step) + (40 * 86_400 if k % 200 == 150 else 0))
            rows.append((ticker, at, 100 + r.gauss(0, 3), None if r.random() < 0.1 else float(r.randint(1, 50))))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, x double, y double").repartition(5).cache()


def rows(df, *columns):
    return [tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select("ticker", "ts", *columns).orderBy("ticker", "ts").collect()]


def test_index_and_previous_values(series):
    w = W.partitionBy("ticker").orderBy("ts")
    want = series.withColumns({"_i": F.row_number().over(w) - 1, "_prev_x": F.lag("x").over(w), "_prev_y": F.lag("y").over(w)})
    assert rows(with_index(series, previous=("x", "y")), "_i", "_prev_x", "_prev_y") == rows(want, "_i", "_prev_x", "_prev_y")
    odd = series.unionByName(series.limit(1).withColumn("ticker", F.lit(None).cast("string"))).unionByName(series.limit(1).withColumn("ts", F.lit(None).cast("timestamp_ntz")))
    assert with_index(odd).count() == series.count() and with_index(series.limit(0)).count() == 0
    numbers = series.withColumn("ts", F.unix_seconds(F.col("ts").cast("timestamp")))
    assert [r[2] for r in rows(with_index(numbers), "_i")] == [r[2] for r in rows(want, "_i")]
    dates = series.where("ticker = 'B'").withColumn("ts", F.col("ts").cast("date")).dropDuplicates(["ts"])
    assert [r[2] for r in rows(with_index(dates), "_i")] == list(range(dates.count()))


@pytest.mark.parametrize("part", [25, 64, 5_000])
def test_windows_over_ranges_equal_windows_over_tickers(series, part):
    columns = lambda w: {"a": change("x", 3, w), "b": full("y", 7, F.avg, w), "c": wide_mean("x", 21, w), "d": F.lead("x", 4).over(w), "e": F.max("y").over(w.rowsBetween(-12, 2))}
    second = lambda w: {"f": full("a", 4, F.stddev_samp, w)}
    w = W.partitionBy("ticker").orderBy("ts")
    want = series.withColumns(columns(w)).withColumns(second(w))
    got = over_ranges(series, columns, second, before=20, after=4, part=part)
    assert got.columns == want.columns and rows(got, *"abcdef") == rows(want, *"abcdef")
    with pytest.raises(ValueError, match="longer ranges"):
        in_ranges(series, before=part + 1, part=part)


def test_long_frames_in_ranges(series):
    from barsmith.functions.frames import long_frames

    wanted = {"p": ("max", "x", 70), "q": ("stddev_samp", "y", 70), "r": ("avg", "y", 5), "s": ("sum", "x", 90)}
    got = own_rows(long_frames(in_ranges(series, before=89, part=128), wanted))
    assert rows(got, *wanted) == rows(long_frames(series, wanted), *wanted)


@pytest.mark.parametrize("a", [0.0, 0.05, 0.98, 0.9999, 1.0])
def test_scan_over_many_parts(series, a):
    df = with_index(series).withColumn("z", F.coalesce("y", F.lit(0.0)))
    todo = [Recurrence("u", F.col("z"), a, 0.5, 3, 5), Recurrence("v", F.col("x"), a, 1.0, 0, F.col("x"))]
    got = affine_scan(df, todo, block=8, blocks=4, lags=("u", "v")).orderBy("ticker", "ts").collect()
    by = {}
    for r in got:
        by.setdefault(r["ticker"], []).append(r)
    for values in by.values():
        u = v = None
        for k, r in enumerate(values):
            assert r["u_lag"] is None if u is None else math.isclose(r["u_lag"], u, rel_tol=1e-9, abs_tol=1e-9)
            assert r["v_lag"] is None if v is None else math.isclose(r["v_lag"], v, rel_tol=1e-9, abs_tol=1e-9)
            v = r["x"] if k == 0 else a * v + r["x"]
            if k == 3:
                u = sum((values[j]["z"] for j in range(4))) / 5  # the mean of five values of which one lies before the series
            elif k > 3:
                u = a * u + 0.5 * r["z"]
            assert (r["u"] is None) == (u is None) and (u is None or math.isclose(r["u"], u, rel_tol=1e-9, abs_tol=1e-9)) and math.isclose(r["v"], v, rel_tol=1e-9)


def test_one_long_ticker_is_spread_over_tasks(spark):
    n = 120_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be put together again
    bars = spark.range(n).select(F.concat(F.lit("A"), F.col("id") % 1).alias("ticker"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"), *[(100 + F.sin(F.col("id") / 50)).alias(c) for c in ("open", "high", "low", "close")], F.lit(5.0).alias("volume"))
    got = features.recurrences(bars, parts=("ema", "obv"))
    tasks = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count("EMA_50_1d").alias("k")).collect()
    assert sum(r["n"] for r in tasks) == n and sum(r["k"] for r in tasks) == n - 1249 and max(r["n"] for r in tasks) < n / 3
    framed = features.framed(bars, [lambda w: features.sma_columns(w=w)], features.longest())
    assert max(r["count"] for r in framed.groupBy(F.spark_partition_id()).count().collect()) < n / 3
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
