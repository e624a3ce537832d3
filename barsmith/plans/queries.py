"""Queries over the given tables: one or more for each operator."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranges import in_ranges, own_rows
from ..functions.windows import change, clip, full, lagged
from ..operators import dataset as ds
from ..operators import evaluate as ev
from ..operators import features as ft
from ..operators import fundamentals as fu
from ..operators import models as md
from ..operators import news as nw
from ..operators import options as op
from ..operators import signals as sg
from ..operators import strategy as st
from ..sources import bars as src
from ..streaming import streams as sm
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    """Registers a query; doubles are rounded for comparison across engines."""
    QUERIES[f.__name__] = lambda spark, sf_dir: fx.rounded(f(spark, sf_dir))
    return f


def _with(df: DataFrame, columns: dict) -> DataFrame:
    return df.select("ticker", "ts", *[c.alias(n) for n, c in columns.items()])


# sources


@query
def bars_15m(spark, d):
    return fx.bars15(spark, d)


@query
def bars_daily(spark, d):
    return fx.bars_daily(spark, d)


@query
def landed_bars(spark, d):
    b = fx.bars_daily(spark, d)
    newer, older = b.where("ts >= TIMESTAMP_NTZ '1995-01-01'"), b.where("ts < TIMESTAMP_NTZ '1995-06-01'").withColumn("volume", F.col("volume") + 1)
    return src.land_bars(newer, older)


@query
def bars_between(spark, d):
    return src.bars_between(fx.bars_daily(spark, d), "1994-01-01", "1996-01-01")


@query
def recent_bars(spark, d):
    return src.recent_bars(fx.bars_daily(spark, d), 60)


@query
def universe_codes(spark, d):
    b = fx.bars_daily(spark, d)
    lines = b.select("ticker").distinct().withColumn("pos", F.ascii("ticker") * 1000 + F.ascii(F.substring("ticker", 2, 1))).select("pos", F.concat(F.lit(" "), "ticker").alias("value"))
    return src.with_codes(b.select("ticker", "ts", "close"), src.universe(lines, 4))


@query
def ticker_report(spark, d):
    codes = fx.read(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("ticker"))
    more = fx.read(spark, d, "region").select((F.col("r_regionkey") + 1000).alias("code"), F.col("r_name").alias("ticker"))  # tickers that no customer has
    have = fx.read(spark, d, "customer").join(F.broadcast(codes), F.col("c_nationkey") == F.col("code")).select("ticker")
    return src.ticker_report(codes.unionByName(more), have)


@query
def pool_profile(spark, d):
    return src.pool_profile(fx.bars_daily(spark, d))


# bars to features


@query
def lag_change(spark, d):
    return ft.framed(fx.bars_daily(spark, d), [lambda w: ft.lags(w=w) | {"Close_Diff": F.col("close") - lagged("close", 1, w)}], ft.FULL.day)


@query
def price_action(spark, d):
    return _with(fx.bars15(spark, d), ft.raw_columns() | ft.price_action())


@query
def sma_ratios(spark, d):
    return ft.framed(fx.bars_daily(spark, d), [lambda w: ft.sma_columns(w=w)], ft.longest())


@query
def ema(spark, d):
    x = ft.recurrences(fx.bars_daily(spark, d), ft.FULL, ("ema",))
    return x.select("ticker", "ts", "EMA_9_15m", "EMA_21_15m", "EMA_21_1d", "EMA_50_1d")


@query
def rsi(spark, d):
    x = ft.recurrences(fx.bars_daily(spark, d), ft.FULL, ("rsi",))
    return x.select("ticker", "ts", "RSI_15m", "RSI_1h", "RSI_4h", "RSI_1d")


@query
def rsi_flags(spark, d):
    return ft.recurrences(fx.bars15(spark, d), ft.FULL, ("rsi",)).select("ticker", "ts", "RSI_Change", "RSI_Overbought", "RSI_Oversold")


@query
def macd(spark, d):
    x = ft.recurrences(fx.bars_daily(spark, d), ft.FULL, ("macd",))
    return x.select("ticker", "ts", *[f"MACD_{p}{n}" for n in ("15m", "4h") for p in ("", "Signal_", "Histogram_")])


@query
def macd_cross(spark, d):
    return ft.recurrences(fx.bars15(spark, d), ft.FULL, ("macd",)).select("ticker", "ts", "MACD_Change_15m", "MACD_Bull_Cross_15m", "MACD_Bear_Cross_15m")


@query
def volume_ratio(spark, d):
    return ft.framed(fx.bars_daily(spark, d), [lambda w: ft.volume_columns(w=w)], max(ft.FULL.volume) - 1)


@query
def obv(spark, d):
    return ft.recurrences(fx.bars_daily(spark, d), parts=("obv",)).select("ticker", "ts", "OBV")


@query
def trailing_drawdown(spark, d):
    x = in_ranges(fx.bars_daily(spark, d), before=max(ft.FULL.drawdown) - 1)
    return own_rows(ft.with_drawdown(x)).select("ticker", "ts", "Max_Drawdown_4h", "Max_Drawdown_20d")


@query
def rolling_sharpe(spark, d):
    return ft.framed(fx.bars_daily(spark, d), [lambda w: {"_r": change("close", 1, w)}, lambda w: {"Sharpe_Approx_4h": ft.rolling_sharpe("_r", 16, 384.0, w)}], 16)


@query
def features_all(spark, d):
    return ft.build_features(fx.bars_daily(spark, d))


@query
def features_optional(spark, d):
    return ft.optional_features(fx.bars_daily(spark, d))


@query
def target(spark, d):
    return ds.with_target(fx.bars_daily(spark, d)).select("ticker", "ts", "target")


#: Features that the data set queries use: cheap ones.
def _small(spark, d):
    b = fx.bars_daily(spark, d)
    df = _with(b, {"close": F.col("close"), "f1": change("close", 1), "f4": change("close", 4), "f_sma": F.try_divide(full("close", 5, F.avg), full("close", 20, F.avg)), "f_const": F.lit(3.0)})
    return ds.with_target(df)


def _split(spark, d, **more):
    return ds.temporal_split(_small(spark, d).dropna("any"), **more)


@query
def complete_rows(spark, d):
    return _small(spark, d).dropna("any")


@query
def temporal_split(spark, d):
    return _split(spark, d).select("ticker", "ts", "split")


@query
def three_way_split(spark, d):
    return _split(spark, d, val_size=0.1).select("ticker", "ts", "split")


@query
def labels(spark, d):
    return ds.labelled(_split(spark, d)).select("ticker", "ts", "split", "q_low", "q_high", "label")


@query
def labels_per_split(spark, d):
    return ds.labelled(_split(spark, d), per_split=True).select("ticker", "ts", "split", "label")


@query
def robust_scale(spark, d):
    return ds.robust_scaled(_split(spark, d), ["f1", "f4", "f_sma", "f_const"]).select("ticker", "ts", "f1", "f4", "f_sma", "f_const")


@query
def class_weights(spark, d):
    return ds.class_weights(ds.labelled(_split(spark, d)).where("split = 'train'"))


@query
def resample_counts(spark, d):
    x = ds.balanced_resample(ds.labelled(_split(spark, d), (0.1, 0.3)).where("split = 'train'"), 9000)
    return x.groupBy("label").agg(F.count("*").alias("n"))


@query
def resample_total(spark, d):
    """Exactly as many draws as are asked for, from all classes."""
    x = ds.resample(ds.labelled(_split(spark, d), (0.1, 0.3)).where("split = 'train'"), 9000)
    return x.agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"))


@query
def float_features(spark, d):
    """The features of a table by its schema, as single floats."""
    x = src.as_float(_split(spark, d))
    return x.select("ticker", "ts", *[F.col(c).cast("double").alias(c) for c in src.feature_names(x)])


@query
def balanced_batches(spark, d):
    x = ds.balanced_batches(ds.labelled(_split(spark, d)).where("split = 'train'"), 32, 50)
    return x.groupBy("batch_no", "label").agg(F.count("*").alias("n"))


def _sequence_row(x: DataFrame) -> DataFrame:
    return x.select("ticker", "ts", "label", F.size("window").alias("n"), F.get("window", F.lit(0))["f1"].alias("first_f1"), F.element_at("window", -1)["f1"].alias("last_f1"))


@query
def sequences(spark, d):
    return _sequence_row(ds.sequences(ds.labelled(_split(spark, d)), ["f1", "f4"]))


@query
def sequences_strict(spark, d):
    return _sequence_row(ds.sequences(ds.labelled(_split(spark, d)), ["f1", "f4"], include_first=False))


@query
def prepared(spark, d):
    f = _with(fx.bars_daily(spark, d), {"Close": F.col("close"), "f1": change("close", 1), "f4": change("close", 4)})
    return ds.prepare(f, ["f1", "f4"]).select("ticker", "ts", "split", "label", "f1", "f4")


@query
def prepared_features(spark, d):
    """All 46 features of the short preset, complete rows only, scaled and labelled."""
    return fx.rounded(_prepared_features(spark, d), 4)


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written once, for plans that read it several times."""
    path = _folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _prepared_features(spark, d) -> DataFrame:
    """Features read their bars for rows, counts and carries; scaling reads features for its parameters and for all rows."""
    f = _kept(ft.build_features(_kept(fx.bars_daily(spark, d)), ft.SHORT))
    return ds.prepare(f, list(ft.NAMES)).select("ticker", "ts", "split", "label", *ft.NAMES)


# evaluation


def _scored(spark, d):
    return ev.predicted(fx.scores(spark, d))


@query
def softmax_argmax(spark, d):
    return _scored(spark, d).select("model", "ts", "pred", "p_down", "p_neutral", "p_up")


@query
def accuracy_f1(spark, d):
    s = _scored(spark, d)
    return ev.accuracy(s).join(ev.weighted_f1(s), "model")


@query
def confusion(spark, d):
    return ev.confusion(_scored(spark, d))


@query
def class_report(spark, d):
    return ev.report(_scored(spark, d))


@query
def weighted_xent(spark, d):
    s = fx.scores(spark, d)
    return ev.cross_entropy(s, ds.class_weights(s.where("model = 'a'").select(F.col("actual").alias("label"))))


@query
def best_model(spark, d):
    return ev.best_model(ev.accuracy(_scored(spark, d)))


@query
def epoch_log(spark, d):
    return src.epoch_log(fx.epoch_lines(spark, d))


@query
def best_epoch(spark, d):
    return ev.best_epoch(src.epoch_log(fx.epoch_lines(spark, d)))


@query
def early_stop(spark, d):
    return ev.early_stop(src.epoch_log(fx.epoch_lines(spark, d)))


@query
def prediction_head(spark, d):
    return ev.prediction_head(_scored(spark, d), 100).drop("logits")


@query
def model_comparison(spark, d):
    s = fx.scores(spark, d)
    return md.compare(s.where("model = 'a'"), s.where("model = 'b'"))


@query
def imported_bars(spark, d):
    """15-minute bars without a volume where an import has NaN, and without those that lack a price."""
    b = fx.bars15(spark, d).withColumns({"close": F.when(F.col("close") < 20, F.lit(float("nan"))).otherwise(F.col("close")), "volume": F.when(F.col("volume") > 300, F.lit(float("inf"))).otherwise(F.col("volume"))})
    return ft.recurrences(src.usable(b), parts=("rsi",)).select("ticker", "ts", "close", "volume", "RSI_15m")


# signals


@query
def inverse_target(spark, d):
    e = fx.read(spark, d, "events")
    return e.select("event_id", sg.inverse_target(F.col("value") / 100, 0.01, 0.5).alias("plain"), sg.inverse_target(F.col("value") / 100, 0.01, 0.5, True).alias("logged"), clip(F.col("value"), 10.0, 200.0).alias("clipped"))


@query
def latest_row(spark, d):
    return sg.latest_row(fx.bars_daily(spark, d))


@query
def latest_sequence(spark, d):
    x = sg.latest_sequence(fx.bars_daily(spark, d), ["close", "volume"], 10)
    return x.select("ticker", "ts", F.size("window").alias("n"), F.get("window", F.lit(0))["close"].alias("first_close"), F.aggregate("window", F.lit(0.0), lambda a, r: a + r["volume"]).alias("volume"))


@query
def signals(spark, d):
    return sg.signals(fx.predictions(spark, d)).drop("model_predictions", "timestamp")


@query
def signal_lines(spark, d):
    return sg.signal_lines(sg.signals(fx.predictions(spark, d)))


# strategy


@query
def strategy_indicators(spark, d):
    return st.indicators(fx.bars_daily(spark, d)).drop("open", "high", "low", "close", "volume")


@query
def strategy_vector(spark, d):
    return st.feature_vector(fx.bars_daily(spark, d))


@query
def position_ledger(spark, d):
    return st.position_ledger(fx.strategy_runs(spark, d))


def _results(spark, d):
    runs = fx.strategy_runs(spark, d)
    return st.metrics(runs, st.position_ledger(runs))


def _money(df: DataFrame) -> DataFrame:
    """Compounded values, to fewer digits."""
    return fx.rounded(df, 3)


@query
def backtest_metrics(spark, d):
    return _money(_results(spark, d))


@query
def leaderboard(spark, d):
    return _money(st.leaderboard(_results(spark, d)))


@query
def return_box(spark, d):
    return _money(st.return_box(_results(spark, d)))


@query
def return_grid(spark, d):
    return _money(st.return_grid(_results(spark, d), ["follow", "revert", "trend"]))


@query
def avg_trades(spark, d):
    return _money(st.average_trades(_results(spark, d)))


@query
def risk_return(spark, d):
    return _money(st.risk_return(_results(spark, d)))


# fundamentals


def _needed() -> dict[str, list[str]]:
    return {"income_stmt": list(fx.ITEMS)}


@query
def statement_items(spark, d):
    good, _ = fu.select_items(fx.statements(spark, d).where("NOT (ticker LIKE '%7' AND item = 'TaxProvision')"), _needed())
    return fu.union_statements(good.where("item < 'M'"), good.where("item >= 'M'")).select("source", "ticker", "item", F.col("period").cast("string").alias("period"), "value")


@query
def statement_rejects(spark, d):
    _, bad = fu.select_items(fx.statements(spark, d).where("NOT (ticker LIKE '%7' AND item = 'TaxProvision')"), _needed())
    return bad


def _wide(spark, d):
    return fu.to_wide(fx.statements(spark, d), list(fx.ITEMS))


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("period", F.col("period").cast("string"))


@query
def statement_pivot(spark, d):
    return _dated(_wide(spark, d))


@query
def ratios(spark, d):
    return _dated(fu.ratios(fu.market_context(_wide(spark, d), fu.select_info(fx.info(spark, d)))))


@query
def yoy(spark, d):
    return _dated(fu.growth(_wide(spark, d), {"asset_growth": ("TotalAssets", False), "ocf_growth": ("OperatingCashFlow", True)}))


def _filings(spark, d):
    good, _ = fu.select_items(fx.filings(spark, d))
    return fu.to_wide(good, list(fx.FILINGS))


@query
def all_ratios(spark, d):
    """Every ratio, for the tickers that have every item."""
    return _dated(fu.ratios(fu.market_context(_filings(spark, d), fu.select_info(fx.info(spark, d)))))


@query
def all_growth(spark, d):
    return _dated(fu.growth(_filings(spark, d)))


@query
def pe_gap(spark, d):
    return fu.pe_gap(fu.select_info(fx.info(spark, d)))


@query
def ratings_since(spark, d):
    o = fx.read(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderdate").alias("rating_ts"), F.col("o_orderkey").alias("rating_id"), F.lit(1).alias("Rating_Old"))
    return src.drop_prefix(fu.ratings_since(o, "1998-01-01"), "Rating_")


# news and options


@query
def news_confidence(spark, d):
    return nw.clean_news(fx.news_raw(spark, d)).select("ticker", "datetime", "headline", "confidence")


@query
def news_weekly(spark, d):
    return nw.weekly(nw.clean_news(fx.news_raw(spark, d)), every=10)


@query
def greeks_rows(spark, d):
    return op.greeks_rows(fx.option_snapshots(spark, d))


# models


def _trained(spark, d, kind):
    x = ds.labelled(_split(spark, d))
    columns = ["f1", "f4", "f_sma"]
    x = ds.robust_scaled(x, columns)
    train = x.where("split = 'train'")
    if kind == "mlp":
        train = ds.balanced_resample(train, 6000)
    return ev.predicted(md.score(md.train_classifier(train, columns, kind, (8,), 20), x.where("split = 'test'"), kind)).drop("logits")


@query
def linear_scores(spark, d):
    """A user's own linear model, called with batches of rows."""
    columns = ["f1", "f4", "f_sma"]
    x = ds.robust_scaled(ds.labelled(_split(spark, d)), columns).where("split = 'test'")
    return ev.predicted(md.score_with(partial(md.dense, fx.DENSE, fx.BIAS), x, columns, "linear")).drop("logits")


@query
def network_scores(spark, d):
    """A user's own recurrent net, called with batches of sequences of all 46 features."""
    x = ds.sequences(_prepared_features(spark, d), list(ft.NAMES))
    net = partial(md.elman, fx.INNER, fx.OWN, fx.HEAD, fx.BIAS)
    return ev.predicted(md.score_with(net, x, list(ft.NAMES), "network", window="window")).drop("logits")


@query
def lr_scores(spark, d):
    return _trained(spark, d, "logistic")


@query
def mlp_scores(spark, d):
    return _trained(spark, d, "mlp")


# streams: each runs over what is there and ends


def _folder(spark) -> str:
    """A new folder that driver and executors share; only a local session may do without spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}" if base else "file://" + tempfile.mkdtemp(prefix="spark-")


def _stream(spark, d, make) -> DataFrame:
    """A stream of the events table's files with the columns of ``make`` (a fixture on a static table)."""
    events = fx.read(spark, d, "events")
    return make(spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*"))


def _ticks(e: DataFrame) -> DataFrame:
    return e.select(F.col("event_type").alias("ticker"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.get_json_object("props", "$.k").try_cast("double").alias("size"))


def _quotes(e: DataFrame) -> DataFrame:
    return e.select(F.col("event_type").alias("symbol"), (F.col("user_id") % 2).alias("odd"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("last"), (F.col("value") - 0.01).alias("bid"), (F.col("value") + 0.01).alias("ask"))


@query
def stream_bars(spark, d):
    x = sm.drained(sm.stream_bars(_stream(spark, d, _ticks)), "bars", _folder(spark))
    return x.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query
def stream_latest_quote(spark, d):
    folder, quotes = _folder(spark), sm.latest_quotes(_stream(spark, d, _quotes))
    sm.run_incrementally(quotes, lambda batch, number: sm.write_once(batch, number, f"{folder}/latest", "parquet"), f"{folder}/state", "update")
    return sm.latest_of(spark, f"{folder}/latest", "symbol string, ts timestamp_ntz, last double, bid double, ask double", "symbol", "parquet")


@query
def stream_ema(spark, d):
    x = sm.drained(sm.stream_ema(_stream(spark, d, _ticks)), "ema", _folder(spark), settings=(sm.STATE_STORE,))
    return x.select("ticker", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq", "ema")


@query
def stream_indicators(spark, d):
    x = sm.drained(sm.stream_indicators(_stream(spark, d, _ticks)), "indicators", _folder(spark), settings=(sm.STATE_STORE,))
    return x.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query
def latest_pairs(spark, d):
    return sm.latest_pairs(fx.quotes(spark, d))


def stream_pair(spark, d):
    """Pairs are written folded. What holds for a quote, as its rounding, is done before it is paired, not once a pair."""
    quotes = [_stream(spark, d, _quotes).where(f"odd = {k}").withColumn("last", fx.r6("last")) for k in (0, 1)]
    met, naive = sm.met_quotes(*quotes), "array<struct<s_ts: timestamp_ntz, s_last: double, first: int, until: int>>"
    met = met.withColumns({"s": F.col("s").cast(naive), "o_ts": F.col("o_ts").cast("array<timestamp_ntz>")})
    x = sm.drained(met, "pairs", _folder(spark), settings=(sm.STATE_STORE, sm.JOIN_STATE))
    return sm.unfolded(x.repartition(4 * spark.sparkContext.defaultParallelism))  # a small file can hold many pairs


QUERIES["stream_pair"] = stream_pair


@query
def stream_signals(spark, d):
    """Each micro-batch of events gives its signals to a table that later runs add to."""
    folder = _folder(spark)

    def work(batch: DataFrame, number: int) -> None:
        p = batch.groupBy(F.col("event_type").alias("ticker"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model")).agg((F.avg("value") / 1000).alias("predicted_return"))
        sm.write_once(sg.signals(p).drop("model_predictions", "timestamp"), number, f"{folder}/signals")

    sm.run_incrementally(_stream(spark, d, lambda e: e), work, f"{folder}/state")
    return sm.read_complete(spark, f"{folder}/signals", "action string, confidence double, predicted_return double, rank int, signal_strength string, ticker string")


# sinks: written and read again


@query
def landed_files(spark, d):
    """Bars as a folder of files for each ticker, read again."""
    folder = _folder(spark)
    src.write_bars(fx.bars_daily(spark, d), folder)
    return src.read_bars(spark, folder)


@query
def feature_files(spark, d):
    """Features as a folder of files for each ticker; what a scan of all of them finds."""
    folder = _folder(spark)
    f = _with(fx.bars_daily(spark, d), ft.lags())
    f.repartition("ticker").write.partitionBy("ticker").parquet(folder)
    found = src.files_read(src.read_feature_files(spark, folder))
    return found.select("ticker", "n_rows", (F.col("n_files") > 0).alias("found"))


@query
def feature_manifest(spark, d):
    """What the files of a feature folder hold, file by file, summed up for each ticker."""
    folder = _folder(spark)
    _with(fx.bars_daily(spark, d), ft.lags()).repartition("ticker").write.partitionBy("ticker").parquet(folder)
    found = src.file_manifest(spark, folder)
    return found.groupBy("ticker").agg(F.sum("n_rows").alias("n_rows"), F.max(F.size("columns")).alias("n_columns"), F.count("error").alias("n_errors"))


@query
def landed_months(spark, d):
    """A table of months that a later chunk, overlapping and with other volumes, is added to."""
    folder, b = _folder(spark), fx.bars_daily(spark, d)
    src.land_months(b.where("ts < TIMESTAMP_NTZ '1995-06-15'"), folder)
    src.land_months(b.where("ts >= TIMESTAMP_NTZ '1995-05-20'").withColumn("volume", F.col("volume") + 1), folder)
    return src.read_bars(spark, folder)


@query
def signals_files(spark, d):
    """Signals of two runs, the second of them written twice, read again with the time of their run."""
    folder, p = _folder(spark), fx.predictions(spark, d)
    for at in ("2024-01-31 09:30:00", "2024-01-31 16:00:00", "2024-01-31 16:00:00"):
        src.write_signals(sg.signals(p, at=at), folder)
    return src.read_json(spark, folder, "ticker string, action string, confidence double, signal_strength string, rank int, run string")


@query
def signals_json(spark, d):
    folder = _folder(spark)
    src.write_json(sg.signals(fx.predictions(spark, d)), folder, "action")
    return src.read_json(spark, folder, "ticker string, action string, predicted_return double, confidence double, signal_strength string, rank int")


@query
def news_json(spark, d):
    folder = _folder(spark)
    src.write_json(nw.clean_news(fx.news_raw(spark, d)).select("ticker", "datetime", "headline", "confidence"), folder)
    return src.read_json(spark, folder, "ticker string, datetime timestamp_ntz, headline string, confidence double")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving-average crosses on 15-minute bars, for the short preset."""
    return fx.rounded(_with(fx.bars15(spark, sf_dir), {"close": F.col("close")} | ft.sma_columns(ft.SHORT)))
