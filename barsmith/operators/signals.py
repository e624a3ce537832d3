"""From model outputs to ranked trading signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import clip, ordered
from ..sources.bars import newest


def inverse_target(y: Column, center: float, scale: float, log_target: bool = False) -> Column:
    """A scaled target back in percent; with ``log_target`` bounded to +-10 and exponentiated first."""
    x = y * scale + center
    if log_target:
        x = F.expm1(clip(x, -10.0, 10.0))
    return x * 100


def ensemble(predictions: DataFrame) -> DataFrame:
    """(ticker, predicted_return, model_predictions): mean over the models that predict the ticker, and all by model."""
    have = predictions.where("predicted_return IS NOT NULL")
    by = F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", F.col("predicted_return").alias("value")))))
    return have.groupBy("ticker").agg(F.avg("predicted_return").alias("predicted_return"), by.alias("model_predictions"))


def signals(predictions: DataFrame, threshold: float = 0.02, strong: float = 0.05, at: str = "1970-01-01 00:00:00") -> DataFrame:
    """BUY and SELL signals whose mean return is large enough, the largest first (``rank``, ties by ticker)."""
    avg = F.col("predicted_return")
    found = ensemble(predictions).withColumn("confidence", F.abs(avg)).where(F.col("confidence") >= threshold)
    found = found.select(
        "ticker", F.when(avg > 0, "BUY").otherwise("SELL").alias("action"), "predicted_return", "confidence", "model_predictions",
        F.lit(at).cast("timestamp").alias("timestamp"), F.when(F.col("confidence") >= strong, "STRONG").otherwise("MODERATE").alias("signal_strength"),
    )
    from pyspark.sql import Window as W

    return found.withColumn("rank", F.row_number().over(W.orderBy(F.col("confidence").desc(), "ticker"))).orderBy("rank")


def signal_lines(found: DataFrame) -> DataFrame:
    """A row for each model of each signal."""
    return found.select("ticker", "action", "rank", F.explode("model_predictions").alias("model", "model_return"))


def latest_row(features: DataFrame) -> DataFrame:
    return newest(features)


def latest_sequence(features: DataFrame, columns: list[str], length: int = 10) -> DataFrame:
    """The last ``length`` rows of each ticker; shorter tickers go."""
    rows = F.collect_list(F.struct(*columns)).over(ordered().rowsBetween(-(length - 1), 0))
    return newest(features.select("ticker", "ts", rows.alias("window"))).where(F.size("window") == length)


def predicted_return(p_up: Column, p_down: Column) -> Column:
    """A classifier's output as a return-like number."""
    return p_up - p_down
