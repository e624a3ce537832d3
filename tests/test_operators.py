"""Hand-made cases and invariants."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from barsmith.functions.scan import Recurrence, affine_scan, with_index
from barsmith.operators import dataset, evaluate, features, fundamentals, news, signals, strategy
from barsmith.sources import bars as src

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def frame(spark, closes, ticker="A", volume=100.0):
    return spark.createDataFrame([(ticker, T0 + dt.timedelta(minutes=15 * i), c, c, c, c, volume) for i, c in enumerate(closes)], SCHEMA)


def walk(n, seed=1):
    r, x, out = random.Random(seed), 100.0, []
    for _ in range(n):
        x *= 1 + r.uniform(-0.03, 0.03)
        out.append(x)
    return out


@pytest.mark.parametrize("a", [0.0, 0.05, 0.3, 0.8, 0.999])
def test_scan_equals_a_loop(spark, a):
    x = walk(700)
    df = with_index(frame(spark, x)).withColumn("seed", F.lit(5.0))
    got = [r["y"] for r in affine_scan(df, [Recurrence("y", F.col("close"), a, 1 - a, 3, F.col("seed"))], block=64).orderBy("ts").collect()]
    y, want = None, []
    for i, v in enumerate(x):
        y = 5.0 if i == 3 else a * y + (1 - a) * v if i > 3 else None
        want.append(y)
    assert got[:3] == [None] * 3
    assert all(math.isclose(g, w, rel_tol=1e-9) for g, w in zip(got[3:], want[3:]))


def test_flat_prices(spark):
    f = features.build_features(frame(spark, [10.0] * 40)).orderBy("ts").collect()
    assert f[13]["RSI_15m"] is None and f[14]["RSI_15m"] == 0  # no gain, no loss
    assert f[39]["RSI_Oversold"] == 1 and f[0]["RSI_Oversold"] == 0
    assert f[39]["Price_Range"] == 0 and f[39]["Max_Drawdown_4h"] == 0
    s = strategy.indicators(frame(spark, [10.0] * 20)).orderBy("ts").collect()
    assert s[19]["rsi"] is None
    s = strategy.indicators(frame(spark, [float(i) for i in range(1, 21)])).orderBy("ts").collect()
    assert s[12]["rsi"] is None and s[13]["rsi"] == 100


def test_volume_rounds_half_to_even_and_ranges_of_zero(spark):
    rows = [("A", T0 + dt.timedelta(minutes=i), 0.0, 0.0, 0.0, 0.0, v) for i, v in enumerate((0.5, 1.5, 2.5))]
    f = features.build_features(spark.createDataFrame(rows, SCHEMA)).orderBy("ts").collect()
    assert [r["Volume"] for r in f] == [0, 2, 2]
    assert f[0]["High_Low_Ratio"] is None and f[0]["Intraday_Return"] is None


def test_columns_and_order_and_isolation(spark):
    a, b = frame(spark, walk(60, 2), "A"), frame(spark, walk(45, 3), "B")
    both = features.build_features(a.unionByName(b), features.SHORT)
    assert both.columns == ["ticker", "ts", *features.NAMES] and len(features.NAMES) == 46
    alone = features.build_features(a, features.SHORT).orderBy("ts").collect()
    assert both.where("ticker = 'A'").orderBy("ts").collect() == alone
    past = features.build_features(a.where(F.col("ts") < T0 + dt.timedelta(minutes=15 * 40)), features.SHORT).orderBy("ts").collect()
    assert alone[:40] == past  # nothing looks ahead


def test_empty_bars(spark):
    assert features.build_features(spark.createDataFrame([], SCHEMA)).count() == 0


def test_optional_features_by_value(spark):
    x = walk(120, 5)
    f = features.optional_features(frame(spark, x)).orderBy("ts").collect()
    assert math.isclose(f[50]["ROC_10_15m"], (x[50] / x[40] - 1) * 100)
    top, low = max(x[37:51]), min(x[37:51])
    assert math.isclose(f[50]["Williams_R_15m"], max(-100, min(0, (top - x[50]) / (top - low) * -100)), abs_tol=1e-9)
    tr = [0.0, *[abs(x[i] - x[i - 1]) for i in range(1, 120)]]
    atr = sum(tr[1:15]) / 14
    for i in range(15, 51):
        atr = (13 * atr + tr[i]) / 14
    assert math.isclose(f[50]["ATR_14_15m"], atr, rel_tol=1e-9)
    assert 0 <= f[50]["Underwater_Periods_4h"] <= 16


def test_split_has_no_leakage(spark):
    df = dataset.with_target(frame(spark, walk(200))).withColumn("f", F.col("close")).dropna()
    split = dataset.temporal_split(df)
    changed = split.withColumn("target", F.when(F.col("split") == "test", F.lit(9.0)).otherwise(F.col("target"))).withColumn("f", F.when(F.col("split") == "test", F.lit(1e6)).otherwise(F.col("f")))
    train = lambda x: dataset.thresholds(x.where("split = 'train'")).collect()
    assert train(split) == train(changed)
    assert dataset.robust_parameters(split, ["f"]).collect() == dataset.robust_parameters(changed, ["f"]).collect()
    n = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert n == {"train": 156, "test": 40}
    assert dataset.temporal_split(frame(spark, walk(31))).count() == 0 and dataset.temporal_split(frame(spark, walk(32))).count() == 32


def test_three_way_split_weights_and_sequences(spark):
    df = dataset.with_target(frame(spark, walk(104))).dropna()
    n = {r["split"]: r["count"] for r in dataset.temporal_split(df, 0.2, val_size=0.1).groupBy("split").count().collect()}
    assert n == {"train": 72, "val": 8, "test": 20}
    two = spark.createDataFrame([(0,)] * 3 + [(2,)] * 1, "label int")
    w = {r["label"]: r for r in dataset.class_weights(two).collect()}
    assert w[1]["n"] == 0 and math.isclose(sum(r["weight"] for r in w.values()) / 3, 1)
    lab = df.withColumn("label", F.lit(1))
    for length, first, want in ((16, True, 1), (16, False, 0)):
        assert dataset.sequences(lab.limit(16), ["close"], length, first).count() == want
    assert all(len(r["window"]) == 16 for r in dataset.sequences(lab, ["close"]).collect())


def test_resample_is_balanced_and_repeatable(spark):
    rows = [("A", i, 0 if i < 900 else 1 if i < 990 else 2) for i in range(1000)]
    df = spark.createDataFrame(rows, "ticker string, ts long, label int")
    one = dataset.balanced_resample(df, 6000).groupBy("label").count().collect()
    assert all(abs(r["count"] - 2000) < 300 for r in one)
    assert sorted(one) == sorted(dataset.balanced_resample(df.repartition(5), 6000).groupBy("label").count().collect())
    b = dataset.balanced_batches(df.where("label <> 1"), 10, 4)
    assert b.count() == 40 and b.where("wanted = 1").count() == 12  # an empty class draws from all rows


def test_evaluation_cases(spark):
    s = spark.createDataFrame([("m", "t", 1, 0, [1.0, 1.0, 0.0]), ("m", "t", 2, 1, [0.0, 3.0, 3.0])], "model string, ticker string, ts long, actual int, logits array<double>")
    p = evaluate.predicted(s).orderBy("ts").collect()
    assert [r["pred"] for r in p] == [0, 1]  # the first of equals
    m = evaluate.confusion(evaluate.predicted(s)).collect()
    assert len(m) == 9 and sum(r["n"] for r in m) == 2
    assert {r["label"]: r["f1"] for r in evaluate.class_scores(evaluate.predicted(s)).collect()}[2] == 0


def test_early_stop_compares_with_the_kept_best(spark):
    losses = [1.0, 0.99995, 0.9998] + [2.0] * 10
    log = spark.createDataFrame([("r", i, x, x) for i, x in enumerate(losses)], "run string, epoch int, train_loss double, test_loss double")
    r = evaluate.early_stop(log).first()
    assert (r["best_epoch"], r["stop_epoch"]) == (2, 8)


def test_signals_at_the_borders(spark):
    p = spark.createDataFrame([("A", "x", 0.02), ("B", "x", 0.05), ("C", "x", -0.02), ("D", "x", 0.019), ("E", "x", None)], "ticker string, model string, predicted_return double")
    got = {r["ticker"]: (r["action"], r["signal_strength"]) for r in signals.signals(p).collect()}
    assert got == {"A": ("BUY", "MODERATE"), "B": ("BUY", "STRONG"), "C": ("SELL", "MODERATE")}


def test_headlines(spark):
    heads = ["{A:1:C:0.97}Text", "{A:1}No", "{C:n/a}x", "{C:nan}y", "{C:0.95}{C:0.1}z", "plain C:0.9"]
    df = spark.createDataFrame([(h,) for h in heads], "headline string")
    got = [(r["confidence"], r["headline"]) for r in news.with_confidence(df).collect()]
    assert got == [(0.97, "Text"), (None, "No"), (None, "x"), (None, "y"), (0.95, "{C:0.1}z"), (0.9, "plain C:0.9")]


def test_ledger_rule_before_stop_and_open_trade(spark):
    closes = [100.0] * 20 + [101, 102, 90, 91, 95, 99, 103, 104, 105]
    rows = [("p", "A", "m", T0 + dt.timedelta(days=i), c, float(c), float(c) - 1 if i != 22 else 95.0, 50.0, 0.03 if i in (20, 25) else -0.03 if i == 22 else 0.0) for i, c in enumerate(map(float, closes))]
    runs = spark.createDataFrame(rows, "period string, ticker string, model string, ts timestamp_ntz, open double, close double, sma_10 double, rsi double, predicted_return double")
    got = strategy.position_ledger(runs).orderBy("trade_no").collect()
    assert [(r["entry_price"], r["exit_price"], r["reason"]) for r in got] == [(102.0, 91.0, "rule"), (103.0, None, None)]
    m = strategy.metrics(runs, strategy.position_ledger(runs)).first()
    assert m["total_trades"] == 1 and m["win_rate"] == 0
    cash = 10_000 * (1 - 0.95 * 1.002 + 0.95 * 0.998 * 91 / 102)
    assert math.isclose(m["final_value"], cash * (1 - 0.95 * 1.002) + cash * 0.95 / 103 * 105)


def test_statement_sample(spark):
    wide = spark.createDataFrame([("X", "CurrentAssets", 159734.0, 184257.0), ("X", "CurrentLiabilities", 125286.0, 104149.0)], "ticker string, item string, `2024-06-30` double, `2023-06-30` double")
    long = fundamentals.to_long(wide, "balance_sheet")
    r = fundamentals.ratios(fundamentals.to_wide(long, ["CurrentAssets", "CurrentLiabilities", "TotalAssets"])).orderBy(F.desc("period")).first()
    assert math.isclose(r["current_ratio"], 159734 / 125286)


def test_sources(spark, tmp_path):
    b = frame(spark, walk(30)).unionByName(frame(spark, walk(20, 9), "B"))
    src.write_bars(b, f"{tmp_path}/b")
    assert sorted(src.read_bars(spark, f"{tmp_path}/b").collect()) == sorted(b.collect())
    (tmp_path / "u.txt").write_text("AAA\n\n BRK.B \nCCC\n")
    assert [(r["code"], r["ticker"]) for r in src.read_universe(spark, f"{tmp_path}/u.txt", 2).collect()] == [(0, "AAA"), (1, "BRK.B")]
    assert src.as_float(b).dtypes[5] == ("close", "float")
    assert src.feature_names(b.withColumn("target", F.lit(1.0))) == ["open", "high", "low", "close", "volume"]
    assert src.land_bars(b, b).count() == b.count()
