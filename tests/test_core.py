"""Parts of the engine on small cases: quantiles, draws, missing prices, streams in several batches, models."""

import datetime
import math
import random
import re
import time
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barsmith.operators import dataset, evaluate, features, models
from barsmith.plans import fixtures, queries
from barsmith.sources import bars as src
from barsmith.streaming import streams


@pytest.mark.parametrize("most", [5, 60, 10**6])
def test_exact_quantiles(spark, most):
    r = random.Random(most)
    rows = [(r.choice([r.gauss(0, 1), 3.0, -1e9 * r.random() ** 9]), 7.0, float(i % 3) if i % 5 else None, None, i % 11) for i in range(800)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e int").repartition(5)
    shares = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    got = dataset.exact_quantiles(df, list("abcde"), shares, most=most, parts=7)
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in "abcde"]).first()
    assert got == {c: want[c] or [None] * 6 for c in "abcde"}
    assert dataset.exact_quantiles(df.limit(0), ["a"], shares) == {"a": [None] * 6}
    odd = spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(math.nan,), (math.inf,), (-math.inf,), (None,)], "a double")
    assert dataset.exact_quantiles(odd, ["a"], (0.25, 0.5, 0.75), most=most, parts=7) == {"a": [25.75, 50.5, 75.25]}


@pytest.mark.parametrize("accuracy", [10_000, 300, 50])
def test_quantiles_of_groups(spark, accuracy):
    r = random.Random(5)
    rows = [(r.choice("aaaab") if i else "one", i % 2, r.choice([r.gauss(0, 1), r.gauss(1000, 0.001), 3.0, math.nan, None, -1e9 * r.random() ** 9])) for i in range(6_000)]
    df = spark.createDataFrame([*rows, ("none", 1, None)], "g string, h int, x double").repartition(5)
    shares = (0.0, 0.25, 0.45, 0.5, 0.999, 1.0)
    for by in (("g",), ("g", "h")):
        clean = df.where("NOT isnan(x)").groupBy(*by).agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("_q")).where("_q IS NOT NULL")
        got = dataset.group_quantiles(df, "x", shares, by, accuracy)
        assert sorted(map(tuple, got.select(*by, "_q").collect())) == sorted(map(tuple, clean.select(*by, "_q").collect()))
    assert dataset.group_quantiles(df.limit(0), "x", shares, ("g",)).count() == 0


def test_balanced_batches_draw_rows_of_the_class(spark):
    rows = [(f"t{i % 7}", i, 0 if i % 3 else 2, i * 1.5) for i in range(500)]
    df = spark.createDataFrame(rows, "ticker string, ts long, label int, x double")
    drawn = [dataset.balanced_batches(d, 10, 40, ranges=16).collect() for d in (df, df.repartition(9))]
    assert sorted(drawn[0]) == sorted(drawn[1])  # whatever the partitions
    known = set(rows)
    assert len(drawn[0]) == 400 and all((r["ticker"], r["ts"], r["label"], r["x"]) in known for r in drawn[0])
    by = {}
    for r in drawn[0]:
        by.setdefault(r["wanted"], []).append(r)
    assert {r["label"] for r in by[0]} == {0} and {r["label"] for r in by[2]} == {2} and {r["label"] for r in by[1]} == {0, 2}  # class 1 is empty
    assert len({r["ts"] for r in by[0]}) > 80


def test_a_missing_price_breaks_no_series(spark):
    rows = [("a", i, 10.0, 10.0, 10.0, {20: None, 25: math.nan, 30: math.inf}.get(i, 10.0), 5.0) for i in range(60)]
    bars = spark.createDataFrame(rows, "ticker string, ts long, open double, high double, low double, close double, volume double")
    got = features.recurrences(bars, features.SHORT).orderBy("ts").collect()
    assert len(got) == 57 and all(r["EMA_9_15m"] is None or math.isclose(r["EMA_9_15m"], 10) for r in got) and sum(r["EMA_9_15m"] is not None for r in got) == 49
    assert features.build_features(bars, features.SHORT).count() == 57


def test_prepared_features_equal_pandas(spark, data):
    f = features.build_features(fixtures.bars_daily(spark, data), features.SHORT)
    names = list(features.NAMES)
    p = f.toPandas().sort_values(["ticker", "ts"])
    p["target"] = p.groupby("ticker")["Close"].shift(-4) / p["Close"] - 1
    p = p.dropna(subset=[*names, "target"])
    n, at = p.groupby("ticker")["ts"].transform("size"), p.groupby("ticker").cumcount() + 1
    p["split"] = np.where(at > np.floor(n * (1 - 0.2)), "test", "train")
    p = p[n >= 32]
    train = p[p["split"] == "train"]
    q = train.groupby("ticker")["target"].quantile([0.45, 0.55]).unstack()
    low, high = p["ticker"].map(q[0.45]), p["ticker"].map(q[0.55])
    p["label"] = np.where(p["target"] > high, 2, np.where(p["target"] < low, 0, 1))
    iqr = train[names].astype(float).quantile(0.75) - train[names].astype(float).quantile(0.25)
    want = (p[names].astype(float) - train[names].astype(float).median()) / iqr.replace(0, 1)
    got = queries.QUERIES["prepared_features"](spark, data).toPandas().sort_values(["ticker", "ts"])
    assert len(got) == len(p) > 500 and (got["label"].to_numpy() == p["label"].to_numpy()).all() and (got["split"].to_numpy() == p["split"].to_numpy()).all()
    np.testing.assert_allclose(got[names].to_numpy(dtype=float), want.to_numpy(), rtol=1e-4, atol=6e-5)


def _ticks(spark, rows, path):
    spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, seq long, price double, size double").coalesce(1).write.mode("append").parquet(path)


def _indicators(spark, folder, batches, **more):
    """The result after all micro-batches; each is a run that goes on from the state of the one before."""
    for rows in batches:
        _ticks(spark, rows, f"{folder}/in")
        like = spark.read.parquet(f"{folder}/in")
        out = streams.drained(streams.stream_indicators(streams.read_stream(spark, f"{folder}/in", like), **more), "x", f"{folder}/out", settings=(streams.STATE_STORE,))
    return sorted(tuple(x) for x in out.select("seq", F.round("ema", 8), F.round("rsi", 8), F.round("obv", 8)).collect())


def test_indicators_in_any_order_of_rows_and_batches(spark, tmp_path):
    r, start = random.Random(1), datetime.datetime(2024, 1, 1)
    rows = [("ab"[i % 2], start + datetime.timedelta(minutes=i), i, None if i == 33 else 50 + r.gauss(0, 2), None if i % 10 == 0 else float(r.randint(1, 9))) for i in range(200)]
    end = [("z", start + datetime.timedelta(days=9), 999, 1.0, 1.0)]  # moves the watermark on
    mixed = r.sample(rows, len(rows))
    near = sorted(rows, key=lambda x: x[2] + r.uniform(0, 25))  # up to 25 minutes out of order
    one = _indicators(spark, tmp_path / "one", [rows, end], delay="1 day", stretch=600)
    many = _indicators(spark, tmp_path / "many", [mixed[:3], mixed[3:120], mixed[120:], end], delay="1 day", stretch=600)
    short = _indicators(spark, tmp_path / "short", [near[:50], near[50:60], near[60:150], near[150:], end], delay="30 minutes", stretch=300)
    assert len(one) == 199 and str(one) == str(many) == str(short)
    # against the definition, in plain order
    by = {t: [x for x in rows if x[0] == t and x[3] is not None] for t in "ab"}
    got = {s: (e, o) for s, e, _, o in one}
    for series in by.values():
        mean, flow, last = None, 0.0, None
        for k, (_, _, seq, price, size) in enumerate(series):
            mean = sum(x[3] for x in series[:9]) / 9 if k == 8 else 0.8 * mean + 0.2 * price if k > 8 else None
            flow += (size or 0) * (1 if last is None or price > last else -1 if price < last else 0)
            last = price
            assert (got[seq][0] is None) == (mean is None) and (mean is None or math.isclose(got[seq][0], mean, abs_tol=1e-6)) and math.isclose(got[seq][1], flow, abs_tol=1e-6)
    assert spark.conf.get(streams.STATE_STORE[0]) != streams.STATE_STORE[1]  # the session is as it was


def test_late_rows_change_no_indicator(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=m)
    batches = [[("a", at(k), k, 10.0 + k, 1.0) for k in (0, 1, 2, 3, 4, 6)], [("a", at(5), 5, 15.0, 1.0), ("a", at(60), 60, 17.0, 1.0)], [("a", at(1), 99, 500.0, 1.0)], [("a", at(600), 600, 1.0, 1.0)]]
    got = _indicators(spark, tmp_path, batches, ema=3, delay="5 minutes", stretch=60)
    assert [(x[0], x[1], x[3]) for x in got] == [(0, None, 1.0), (1, None, 2.0), (2, 11.0, 3.0), (3, 12.0, 4.0), (4, 13.0, 5.0), (5, 14.0, 6.0), (6, 15.0, 7.0), (60, 16.0, 8.0)]


def test_a_batch_that_comes_again_is_written_once(spark, tmp_path):
    df = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x long")
    path = str(tmp_path / "signals")
    read = lambda: sorted(r["x"] for r in streams.read_complete(spark, path, "x long").collect())
    assert read() == []
    streams.write_once(df(1, 2), 0, path)
    df(7, 8, 9).write.mode("overwrite").json(f"{path}/rows/batch=1")  # killed before the marker
    assert read() == [1, 2]
    streams.write_once(df(3), 1, path)
    streams.write_once(df(3), 1, path)  # killed behind the marker, before the stream took note
    assert read() == [1, 2, 3]


def test_a_run_that_fails_after_the_write_repeats_nothing(spark, tmp_path):
    path, folder = str(tmp_path / "signals"), str(tmp_path / "state")
    _ticks(spark, [("a", datetime.datetime(2024, 1, 1), k, 1.0, 1.0) for k in range(5)], f"{tmp_path}/in")
    like = spark.read.parquet(f"{tmp_path}/in")
    failing = [True]

    def work(batch, number):
        streams.write_once(batch.select("seq"), number, path)
        if failing:
            failing.clear()
            raise RuntimeError("killed after the write")

    run = lambda: streams.run_incrementally(streams.read_stream(spark, f"{tmp_path}/in", like), work, folder)
    with pytest.raises(Exception, match="killed"):
        run()
    run()
    assert sorted(r["seq"] for r in streams.read_complete(spark, path, "seq long").collect()) == list(range(5))


def test_late_ticks_are_dropped(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    batches = [[("a", at(10, 0), 1, 5.0, 1.0), ("a", at(11, 0), 2, 6.0, 1.0)], [("a", at(11, 30), 3, 7.0, 1.0)], [("a", at(9, 0), 4, 1.0, 1.0), ("a", at(11, 31), 5, 9.0, 1.0)], [("a", at(14, 0), 6, 8.0, 1.0)]]
    for rows in batches:
        _ticks(spark, rows, f"{tmp_path}/in")
        like = spark.read.parquet(f"{tmp_path}/in")
        out = streams.drained(streams.stream_bars(streams.read_stream(spark, f"{tmp_path}/in", like)), "bars", f"{tmp_path}/out")
    got = {str(r["ts"])[11:16]: (r["open"], r["close"]) for r in out.collect()}
    assert got == {"10:00": (5.0, 5.0), "11:00": (6.0, 6.0), "11:30": (7.0, 9.0)}  # 9:00 came after its bar was closed; 14:00 is open


def test_features_of_all_columns_read_their_ticks_once(spark, data):
    """Bars and features are written before they are read again: the plan of the result goes back to no table."""
    files = queries._prepared_features(spark, data).inputFiles()
    assert files and not [f for f in files if "lineitem" in f]


def _inputs_of_windows():
    return lambda x: np.stack([np.nansum(x[:, :, 0], axis=1), x[:, 0, 1], np.isnan(x).sum(axis=(1, 2))], axis=1)


def test_windows_as_they_are_and_by_column_are_the_same_inputs(spark):
    r = random.Random(2)
    pairs = [[(r.choice((None, r.random(), float("nan"))), r.choice((None, k, -k))) for _ in range(4)] for k in range(50)]
    df = spark.createDataFrame([("t", k, p) for k, p in enumerate(pairs)], "ticker string, ts int, window array<struct<a: double, b: int>>").repartition(3)
    wider = df.withColumn("window", F.transform("window", lambda x: F.struct(x["b"].alias("b"), F.lit("x").alias("c"), x["a"].alias("a"))))
    got, want = (sorted((x["ts"], *map(str, x["logits"])) for x in models.score_with(_inputs_of_windows, f, ["a", "b"], "m", window="window", rows=7).collect()) for f in (df, wider))
    assert got == want and len(got) == 50
    missing = lambda v: v is None or v != v
    assert [float(x[3]) for x in got] == [sum(missing(v) for pair in p for v in pair) for p in pairs]


def _quotes(spark, rows, path, parts=1):
    spark.createDataFrame(rows, "odd int, symbol string, ts timestamp_ntz, last double").repartition(parts).write.mode("append").parquet(path)
    read = streams.read_stream(spark, path, spark.read.parquet(path), files=99)
    return [read.where(f"odd = {k}") for k in (0, 1)]


def test_pairs_of_quotes_by_brute_force(spark, tmp_path):
    r, start = random.Random(4), datetime.datetime(2024, 2, 28, 23, 40)
    at = [start + datetime.timedelta(seconds=60 * r.randint(0, 90) + r.choice((0, 0, 0, 1, 59)), microseconds=r.choice((0, 0, 1, 999_999))) for _ in range(300)]
    rows = [(i % 2, r.choice(("a", "a", "b", None)), None if i % 40 == 0 else t, None if i % 37 == 0 else float(i)) for i, t in enumerate(at)]
    rows += [(0, "z", start, 1.0), (0, "z", start, 1.0), (1, "z", start, 2.0), *[(1, "z", start + datetime.timedelta(minutes=m, microseconds=u), 3.0) for m in (5, 7) for u in (-1, 0, 1)], (1, "z", start - datetime.timedelta(microseconds=1), 4.0)]
    for within in (5, 7):
        for k, batch in enumerate((rows[:100], rows[100:150], rows[150:])):
            both = _quotes(spark, batch, f"{tmp_path}/in{within}")
            out = streams.drained(streams.pair_quotes(*both, within=f"{within} minutes", delay="1 day"), "pairs", f"{tmp_path}/out{within}", settings=(streams.STATE_STORE,))
        got = sorted(tuple(x) for x in out.select("symbol", F.col("s_ts").cast("timestamp_ntz"), "s_last", F.col("o_ts").cast("timestamp_ntz"), "o_last").collect())
        whole = [x for x in rows if None not in x]
        want = sorted((s[1], s[2], s[3], o[2], o[3]) for s in whole for o in whole if (s[0], o[0]) == (0, 1) and s[1] == o[1] and s[2] <= o[2] <= s[2] + datetime.timedelta(minutes=within))
        assert got == want and len(want) > 300


def test_quotes_meet_only_those_near_them(spark, tmp_path, capsys):
    """Keys of the join in the state: with the underlying alone, the work grows with the square of its quotes."""
    start = datetime.datetime(2024, 1, 1)
    both = _quotes(spark, [(i % 2, "a", start + datetime.timedelta(minutes=i // 2 * 5), float(i)) for i in range(40_000)], f"{tmp_path}/in")
    pairs = streams.pair_quotes(*both)
    pairs.explain()
    keys = re.search(r"StreamingSymmetricHashJoin \[(.*?)\], \[(.*?)\]", capsys.readouterr().out).groups()
    assert [len(k.split(", ")) for k in keys] == [2, 2]
    began = time.monotonic()
    assert streams.drained(pairs, "pairs", f"{tmp_path}/out", settings=(streams.STATE_STORE,)).count() == 39_999  # with the one of its time and the next
    assert time.monotonic() - began < 120  # 400 million meetings by the underlying alone


def test_dense_quotes_are_kept_folded(spark, tmp_path, monkeypatch):
    """13 million pairs of 12,000 quotes around a full hour: every pair comes out, and what is written is no larger than the quotes."""
    r, start = random.Random(5), datetime.datetime(2024, 1, 1, 9, 55)
    at, last = np.array([r.randrange(600_000_000) for _ in range(12_000)]), np.array([r.randrange(1000) for _ in range(12_000)])
    rows = [(k, start + datetime.timedelta(microseconds=int(at[k])), k, "a", float(last[k]), "{}") for k in range(12_000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(queries, "_folder", lambda spark: f"{tmp_path}/shared")
    pairs = queries.QUERIES["stream_pair"](spark, str(tmp_path))
    written = sum(f.stat().st_size for f in (tmp_path / "shared" / "pairs").glob("*.parquet"))
    assert 0 < written < 1_000_000
    ahead = at[None, 1::2] - at[::2, None]
    met = (ahead >= 0) & (ahead <= 300_000_000)
    want = (met.sum(), (last[::2] * met.sum(1)).sum(), (last[1::2] * met.sum(0)).sum(), (last[::2, None] * last[None, 1::2] * met).sum(), ahead[met].sum())
    us = F.timestamp_diff("MICROSECOND", "s_ts", "o_ts")
    assert tuple(pairs.agg(F.count("*"), F.sum("s_last"), F.sum("o_last"), F.sum(F.col("s_last") * F.col("o_last")), F.sum(us)).first()) == want and want[0] > 10**7


def test_chunks_of_quotes_hold_each_row_once(monkeypatch):
    r = random.Random(6)
    rows = [(r.choice("ab"), r.choice((0, 60)), r.randrange(50), float(k)) for k in range(5000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 300], strict=True)], ["symbol", "block", "at", "last"]) for k in range(0, 5000, 300)]
    monkeypatch.setattr(streams, "SORTED", 2000)
    monkeypatch.setattr(streams, "CHUNK", 70)
    chunks = [x for b in streams._in_chunks(iter(batches)) for x in b.to_pylist()]
    assert sorted((x["symbol"], x["block"], a, v) for x in chunks for a, v in zip(x["at"], x["last"], strict=True)) == sorted(rows)
    assert all(x["at"] == sorted(x["at"]) and 0 < len(x["at"]) <= 70 and (x["from"], x["to"]) == (x["at"][0], x["at"][-1]) for x in chunks)


def test_late_quotes_are_dropped_and_their_pairs_forgotten(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    for batch in ([(0, "a", at(10, 0), 1.0), (1, "a", at(10, 2), 2.0)], [(0, "a", at(20, 0), 3.0), (1, "a", at(20, 0), 4.0)], [(1, "a", at(10, 3), 5.0), (1, "a", at(20, 1), 6.0)]):
        out = streams.drained(streams.pair_quotes(*_quotes(spark, batch, f"{tmp_path}/in")), "pairs", f"{tmp_path}/out", settings=(streams.STATE_STORE,))
    assert sorted((x["s_last"], x["o_last"]) for x in out.collect()) == [(1.0, 2.0), (3.0, 4.0), (3.0, 6.0)]


def test_broken_feature_files(spark, tmp_path):
    src.write_bars(spark.createDataFrame([("a", i, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(5)] + [("b", 1, 1.0, 1.0, 1.0, 1.0, 1.0)], "ticker string, ts long, open double, high double, low double, close double, volume double"), f"{tmp_path}/f")
    assert {tuple(r) for r in src.files_read(src.read_feature_files(spark, f"{tmp_path}/f")).collect()} == {("a", 1, 5), ("b", 1, 1)}
    (tmp_path / "f" / "ticker=c").mkdir()
    (tmp_path / "f" / "ticker=c" / "part-0.parquet").write_bytes(b"not parquet")
    schema = spark.read.parquet(f"{tmp_path}/f/ticker=a").schema
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/f").count()
    assert src.read_feature_files(spark, f"{tmp_path}/f", skip_broken=True).count() == 6
    few = src.read_feature_files(spark, f"{tmp_path}/f", skip_broken=True, schema="ts long, close double, more double")
    assert few.columns == ["ts", "close", "more", "ticker"] and few.count() == 6


def test_landing_from_another_zone(spark):
    rows = spark.sql("SELECT 'a' AS ticker, TIMESTAMP_NTZ '2024-07-01 14:00:00' AS ts, 1D AS open, 1D AS high, 1D AS low, 1D AS close, 1D AS volume")
    assert str(src.land_bars(rows, source_zone="UTC").first()["ts"]) == "2024-07-01 10:00:00"


@pytest.mark.parametrize("name", ["lr_scores", "mlp_scores"])
def test_scores_of_models(spark, data, name):
    rows = queries.QUERIES[name](spark, data).toPandas()
    p = rows[["p_down", "p_neutral", "p_up"]].to_numpy()
    assert len(rows) > 100 and np.allclose(p.sum(axis=1), 1, atol=1e-5) and (p.argmax(axis=1) == rows["pred"]).mean() > 0.999


def test_a_model_learns_what_can_be_learned(spark):
    r = random.Random(2)
    rows = [("t", i, k, k + r.gauss(0, 0.1), r.gauss(0, 1)) for i in range(300) for k in [i % 3]]
    df = spark.createDataFrame(rows, "ticker string, ts long, label int, x double, y double")
    scored = [models.score(models.train_classifier(df, ["x", "y"], kind, (8,), 100), df, kind) for kind in ("logistic", "mlp")]
    found = models.compare(*scored).orderBy("place").collect()
    assert [x["place"] for x in found] == [1, 2] and all(x["accuracy"] > 95 for x in found) and found[0]["accuracy"] >= found[1]["accuracy"]


def test_resampled_counts_are_near_their_mean(spark, data):
    n = {r["label"]: r["n"] for r in queries.QUERIES["resample_counts"](spark, data).collect()}
    assert set(n) == {0, 1, 2} and all(abs(x - 3000) < 6 * math.sqrt(3000) for x in n.values())


def test_a_numpy_model_gives_the_probabilities_of_spark_ml(spark):
    r = random.Random(3)
    rows = [("t", i, i % 3, i % 3 + r.gauss(0, 1), r.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "ticker string, ts long, label int, x double, y double")
    fitted = models.train_classifier(df, ["x", "y"], "logistic")
    ml = fitted.stages[-1]
    weights, bias = (tuple(map(tuple, ml.coefficientMatrix.toArray().T.tolist())), tuple(ml.interceptVector.toArray().tolist()))
    p = lambda scored: [tuple(x) for x in evaluate.predicted(scored).orderBy("ts").select("ts", "actual", "pred", "p_down", "p_up").collect()]
    own = p(models.score_with(partial(models.dense, weights, bias), df, ["x", "y"], "own", rows=7))
    np.testing.assert_allclose(own, p(models.score(fitted, df, "ml")), atol=1e-9)


def test_a_recurrent_model_gets_sequences(spark):
    rows = [("t", i, 1, float(i), None if i == 30 else i / 2) for i in range(40)]
    df = spark.createDataFrame(rows, "ticker string, ts long, label int, x double, y double")
    windows = dataset.sequences(df, ["x", "y"], 4)
    shape = partial(_sums, 2.0)
    got = {r["ts"]: r["logits"] for r in models.score_with(shape, windows, ["x", "y"], "n", window="window").collect()}
    assert got[10] == [4.0, 2.0, 2 * (7 + 8 + 9 + 10), 2 * (7 + 8 + 9 + 10) / 2] and math.isnan(got[31][3]) and len(got) == 37
    assert models.score_with(shape, windows.limit(0).drop("label"), ["x", "y"], "n", window="window").count() == 0


def _sums(weight):
    """A model that tells what it has got: places, columns and weighted sums."""
    return lambda x: np.concatenate([np.full((len(x), 1), x.shape[1]), np.full((len(x), 1), x.shape[2]), weight * x.sum(axis=1)], axis=1)


def test_exactly_as_many_draws_as_asked_for(spark):
    rows = [("t", i, 0 if i < 900 else 2 if i < 990 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "ticker string, ts long, label int")
    for seed in (1, 2, 3):
        drawn = dataset.resample(df, 5000, seed=seed).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("ts").alias("k")).collect()
        n = {r["label"]: r["n"] for r in drawn}
        assert sum(n.values()) == 5000 and set(n) == {0, 2} and abs(n[0] - 2500) < 250 and {r["label"]: r["k"] for r in drawn}[2] == 90
    assert sorted(dataset.resample(df, 50).collect()) == sorted(dataset.resample(df.repartition(7), 50).collect())
    assert dataset.resample(df.limit(0), 5).count() == 0


def test_landing_touches_its_months_only(spark, tmp_path):
    bar = lambda day, v: ("a", datetime.datetime(2024, *day), 1.0, 1.0, 1.0, 1.0, v)
    frame = lambda *rows: spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    path = str(tmp_path / "bars")
    src.land_months(frame(bar((1, 5), 1.0), bar((2, 5), 1.0), bar((2, 6), 1.0)), path)
    files = lambda m: sorted(p.name for p in (tmp_path / "bars" / f"month=2024-{m:02}").glob("part-*"))
    january, february = files(1), files(2)
    src.land_months(frame(bar((2, 6), 9.0), bar((2, 7), 9.0), bar((3, 1), 9.0)), path)
    assert files(1) == january and files(2) != february
    got = [(r["ts"].month, r["ts"].day, r["volume"]) for r in src.read_bars(spark, path).orderBy("ts").collect()]
    assert got == [(1, 5, 1.0), (2, 5, 1.0), (2, 6, 9.0), (2, 7, 9.0), (3, 1, 9.0)]


def test_a_manifest_names_broken_files(spark, tmp_path):
    (tmp_path / "ticker=a").mkdir()
    (tmp_path / "ticker=b").mkdir()
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"x": [1, 2], "y": ["u", None]}), tmp_path / "ticker=a" / "part-0.parquet")
    (tmp_path / "ticker=b" / "part-0.parquet").write_bytes(b"no parquet")
    got = sorted((r["ticker"], r["n_rows"], r["columns"], r["error"] is None) for r in src.file_manifest(spark, str(tmp_path)).collect())
    assert got == [("a", 2, ["x", "y"], True), ("b", None, None, False)]


def test_upserts_write_their_own_keys_only(spark, tmp_path):
    path = str(tmp_path / "latest")
    frame = lambda *rows: spark.createDataFrame(rows, "symbol string, last double")
    streams.write_once(frame(("a", 1.0), ("b", 1.0)), 0, path)
    before = {p: p.read_bytes() for p in (tmp_path / "latest" / "rows" / "batch=0").glob("part-*")}
    streams.write_once(frame(("b", 2.0), ("c", 2.0)), 1, path)
    assert {p: p.read_bytes() for p in (tmp_path / "latest" / "rows" / "batch=0").glob("part-*")} == before
    assert sorted(map(tuple, streams.latest_of(spark, path, "symbol string, last double", "symbol").collect())) == [("a", 1.0), ("b", 2.0), ("c", 2.0)]
