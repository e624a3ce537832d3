"""News: one row for each article, confidence from the headline, weekly counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by_id(news: DataFrame) -> DataFrame:
    """The first article of each (ticker, article_id): the earliest, then by headline."""
    w = W.partitionBy("ticker", "article_id").orderBy("time", "headline")
    return news.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_confidence(news: DataFrame) -> DataFrame:
    """``confidence`` from ``{...C:0.97}`` in front of the headline (NULL where there is no number), and the headline
    without it."""
    h = F.col("headline")
    part = F.substring_index(F.get(F.split(h, "C:"), F.lit(1)), "}", 1).try_cast("double")
    text = F.when(F.instr(h, "}") > 0, F.expr("substring(headline, instr(headline, '}') + 1)")).otherwise(h)
    return news.withColumn("confidence", F.when(~F.isnan(part), part)).withColumn("headline", text)


def clean_news(news: DataFrame, least: float = 0.9) -> DataFrame:
    """(ticker, datetime, headline, confidence, article) of confident articles, each once."""
    found = with_confidence(first_by_id(news)).where(F.col("confidence") >= least)
    return found.select("ticker", F.col("time").alias("datetime"), "headline", "confidence", "article")


def weekly(clean: DataFrame, origin: str = "0 days", every: int = 50) -> DataFrame:
    """Articles kept in each 7-day window, the running total, and whether the week is a checkpoint (each ``every``-th)."""
    weeks = clean.groupBy(F.window("datetime", "7 days", "7 days", origin).alias("_w")).agg(F.count("*").alias("n_articles"))
    w = W.orderBy("week")
    weeks = weeks.select(F.col("_w.start").alias("week"), "n_articles")
    return weeks.withColumns({"total": F.sum("n_articles").over(w), "checkpoint": (F.row_number().over(w) % every == 0).cast("int")})
