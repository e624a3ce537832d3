"""A rule-based strategy over bars with predictions: indicators, a ledger of trades, metrics and leaderboards.

Orders fill at the next bar's open. A buy spends 95 % of the cash, both sides pay 0.2 %; one position at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import full, lagged, last, ordered

CASH, PART, FEE = 10_000.0, 0.95, 0.002
LOOKBACK = 20
ENTER, LEAVE, STOP, TAKE = 0.02, -0.02, -0.05, 0.10


def simple_rsi(n: int = 14) -> Column:
    """RSI with plain means; the first change counts as 0. 100 without losses, NULL without any change."""
    gain, loss = full("_gain", n, F.avg), full("_loss", n, F.avg)
    return F.when(loss > 0, 100 - 100 / (1 + gain / loss)).when((loss == 0) & (gain > 0), 100.0)


def indicators(bars: DataFrame) -> DataFrame:
    """``bars`` with sma_10, sma_20, sma_50, rsi, bb_upper, bb_lower and volume_sma."""
    d = F.coalesce(F.col("close") - lagged("close"), F.lit(0.0))
    bars = bars.withColumns({"_gain": F.greatest(d, F.lit(0.0)), "_loss": F.greatest(-d, F.lit(0.0))})
    mean, dev = full("close", 20, F.avg), full("close", 20, F.stddev_samp)
    out = {f"sma_{n}": full("close", n, F.avg) for n in (10, 20, 50)}
    out |= {"rsi": simple_rsi(), "bb_upper": mean + 2 * dev, "bb_lower": mean - 2 * dev, "volume_sma": full("volume", 10, F.avg)}
    return bars.withColumns(out).drop("_gain", "_loss")


def feature_vector(bars: DataFrame) -> DataFrame:
    """ticker, ts and the strategy's 15 inputs; NULL on the first 20 bars."""
    df = indicators(bars).withColumns({"_r": F.try_divide(F.col("close") - lagged("close"), lagged("close")), "_i": F.row_number().over(ordered()) - 1})
    c = F.col("close")
    out = {
        "f_close": c, "f_high": F.col("high"), "f_low": F.col("low"), "f_open": F.col("open"),
        "f_range": F.try_divide(F.col("high") - F.col("low"), c), "f_volume": F.try_divide(F.col("volume"), F.avg("volume").over(last(LOOKBACK + 1))),
        "f_sma_10": F.try_divide(F.col("sma_10"), c) - 1, "f_sma_20": F.try_divide(F.col("sma_20"), c) - 1, "f_sma_50": F.try_divide(F.col("sma_50"), c) - 1, "f_rsi": F.col("rsi") / 100,
        "f_mean_5": F.avg("_r").over(last(5)), "f_mean_10": F.avg("_r").over(last(10)), "f_std_10": F.stddev_pop("_r").over(last(10)), "f_max_5": F.max("_r").over(last(5)), "f_min_5": F.min("_r").over(last(5)),
    }
    return df.select("ticker", "ts", *[F.when(F.col("_i") >= LOOKBACK, x).alias(n) for n, x in out.items()])


LEDGER = "period string, ticker string, model string, trade_no long, entry_ts timestamp_ntz, entry_price double, exit_ts timestamp_ntz, exit_price double, reason string"


def _trades(rows: pd.DataFrame) -> pd.DataFrame:
    """The ordered fold over one (period, ticker, model): what a bar decides depends on the position held by then."""
    rows = rows.sort_values("ts", kind="stable")
    ts, opens, close, sma, rsi, pred = (rows[c].tolist() for c in ("ts", "open", "close", "sma_10", "rsi", "predicted_return"))
    out: list[list] = []
    entry = None
    for i in range(LOOKBACK, len(ts)):
        fills = i + 1 < len(ts)
        if entry is None:
            if fills and pred[i] > ENTER and close[i] > sma[i] and rsi[i] < 70:  # NaN compares false
                entry = opens[i + 1]
                out.append([len(out) + 1, ts[i + 1], entry, None, None, None])
            continue
        if out[-1][1] > ts[i]:
            continue
        change = (close[i] - entry) / entry
        reason = "rule" if pred[i] < LEAVE and close[i] < sma[i] and rsi[i] > 30 else "stop" if change < STOP else "take" if change > TAKE else None
        if reason and fills:
            out[-1][3:] = [ts[i + 1], opens[i + 1], reason]
            entry = None
    first = rows.iloc[0]
    table = pd.DataFrame(out, columns=["trade_no", "entry_ts", "entry_price", "exit_ts", "exit_price", "reason"])
    for c in ("period", "ticker", "model"):
        table[c] = first[c]
    table["exit_ts"] = pd.to_datetime(table["exit_ts"])
    table["entry_ts"] = pd.to_datetime(table["entry_ts"])
    table["exit_price"] = table["exit_price"].astype("float64")
    return table[["period", "ticker", "model", "trade_no", "entry_ts", "entry_price", "exit_ts", "exit_price", "reason"]]


def position_ledger(runs: DataFrame) -> DataFrame:
    """Trades of ``runs`` (period, ticker, model, ts, open, close, sma_10, rsi, predicted_return). A trade that is still
    open has no exit. Groups are one ticker's bars of one period."""
    cols = ["period", "ticker", "model", "ts", "open", "close", "sma_10", "rsi", "predicted_return"]
    return runs.select(*cols).groupBy("period", "ticker", "model").applyInPandas(_trades, LEDGER)


def equity(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(period, ticker, model, ts, equity) for every bar: what a closed trade leaves of the cash is a factor, so cash is
    a running product over trades."""
    key = ["period", "ticker", "model"]
    factor = 1 - PART * (1 + FEE) + PART * (1 - FEE) * F.col("exit_price") / F.col("entry_price")
    before = W.partitionBy(*key).orderBy("trade_no").rowsBetween(W.unboundedPreceding, -1)
    t = ledger.withColumn("_cash", CASH * F.exp(F.coalesce(F.sum(F.log(factor)).over(before), F.lit(0.0)))).withColumn("_factor", factor)
    buys = t.select(*key, F.col("entry_ts").alias("ts"), (F.col("_cash") * (1 - PART * (1 + FEE))).alias("cash"), (F.col("_cash") * PART / F.col("entry_price")).alias("units"))
    sells = t.where("exit_ts IS NOT NULL").select(*key, F.col("exit_ts").alias("ts"), (F.col("_cash") * F.col("_factor")).alias("cash"), F.lit(0.0).alias("units"))
    moves = buys.unionByName(sells).select(*key, "ts", F.struct("cash", "units").alias("_move"))
    w = W.partitionBy(*key).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    rows = runs.select(*key, "ts", "close").join(moves, [*key, "ts"], "left").withColumn("_state", F.last("_move", ignorenulls=True).over(w))
    return rows.select(*key, "ts", F.coalesce(F.col("_state.cash") + F.col("_state.units") * F.col("close"), F.lit(CASH)).alias("equity"))


def metrics(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row for each (period, ticker, model): final_value, total_return and max_drawdown in percent, sharpe,
    total_trades (closed ones) and win_rate in percent."""
    key = ["period", "ticker", "model"]
    w = W.partitionBy(*key).orderBy("ts")
    e = equity(runs, ledger)
    e = e.withColumns({"_r": F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1, "_down": F.col("equity") / F.max("equity").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1})
    by = e.groupBy(*key).agg(
        F.max_by("equity", "ts").alias("final_value"), (100 * (F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1)).alias("total_return"),
        (F.try_divide(F.avg("_r"), F.stddev_samp("_r")) * F.sqrt(F.lit(252.0))).alias("sharpe"), (100 * F.min("_down")).alias("max_drawdown"),
    )
    closed = ledger.where("exit_ts IS NOT NULL").withColumn("_won", ((1 - FEE) * F.col("exit_price") > (1 + FEE) * F.col("entry_price")).cast("int"))
    n = closed.groupBy(*key).agg(F.count("*").alias("total_trades"), (100.0 * F.avg("_won")).alias("win_rate"))
    return by.join(n, key, "left").select(*key, "final_value", "total_return", "sharpe", "max_drawdown", F.coalesce("total_trades", F.lit(0)).cast("long").alias("total_trades"), F.coalesce("win_rate", F.lit(0.0)).alias("win_rate"))


def grid(bars: DataFrame, models: DataFrame, periods: DataFrame) -> DataFrame:
    """Bars by period and model: ``models`` (model) and ``periods`` (period, start, end) are short lists."""
    inside = (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end"))
    return bars.join(F.broadcast(periods), inside).drop("start", "end").crossJoin(F.broadcast(models))


def _valid() -> Column:
    return F.col("sharpe").isNotNull() & (F.col("sharpe") != 0)


def leaderboard(results: DataFrame) -> DataFrame:
    by = results.where(_valid()).groupBy("model").agg(F.avg("total_return").alias("avg_return"), F.avg("sharpe").alias("avg_sharpe"), F.count("*").alias("total_tests"))
    rank = F.row_number().over(W.orderBy(F.col("avg_return").desc(), "model"))
    return by.withColumns({"rank": rank, "final_value": CASH * (1 + F.col("avg_return") / 100), "profit": CASH * F.col("avg_return") / 100})


def return_box(results: DataFrame) -> DataFrame:
    """Quartiles of the return of each model, and the extremes within 1.5 interquartile ranges."""
    q = results.groupBy("model").agg(F.percentile("total_return", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    rows = results.join(F.broadcast(q), "model")
    iqr = F.col("q")[2] - F.col("q")[0]
    near = (F.col("total_return") >= F.col("q")[0] - 1.5 * iqr) & (F.col("total_return") <= F.col("q")[2] + 1.5 * iqr)
    return rows.groupBy("model").agg(
        F.first("q")[0].alias("q1"), F.first("q")[1].alias("median"), F.first("q")[2].alias("q3"), F.min(F.when(near, F.col("total_return"))).alias("low"), F.max(F.when(near, F.col("total_return"))).alias("high")
    )


def return_grid(results: DataFrame, models: list[str], stocks: int = 5) -> DataFrame:
    """Mean return of the first stocks by model, 0 where there is none."""
    first = results.select("ticker").distinct().orderBy("ticker").limit(stocks)
    return results.join(F.broadcast(first), "ticker").groupBy("ticker").pivot("model", models).agg(F.avg("total_return")).fillna(0.0)


def average_trades(results: DataFrame) -> DataFrame:
    return results.groupBy("model").agg(F.avg("total_trades").alias("avg_trades"))


def risk_return(results: DataFrame) -> DataFrame:
    return results.where(_valid()).select("period", "ticker", "model", "sharpe", "total_return")


