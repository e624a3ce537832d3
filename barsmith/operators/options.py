"""Option snapshots with nested greeks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("bid", "ask", "last", "model")


def greeks_rows(snapshots: DataFrame) -> DataFrame:
    """A row for each of the four greeks records of a snapshot, with the quoted spread."""
    records = F.array(*[F.struct(F.lit(k).alias("greeks"), *[F.col(f"{k}_greeks.{f}").alias(f) for f in FIELDS]) for k in KINDS])
    rows = snapshots.select("symbol", "ts", (F.col("ask") - F.col("bid")).alias("spread"), F.explode(records).alias("_g"))
    return rows.select("symbol", "ts", "spread", "_g.*")


FIELDS = ("implied_vol", "delta", "opt_price", "pv_dividend", "gamma", "vega", "theta", "und_price")
