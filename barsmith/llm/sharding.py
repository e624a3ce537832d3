"""Sharding by sampled splitters: range-partition records into shards of near-equal bytes.

Records are ordered by (hash of the text, hash of the id), so equal texts stand next to each other. Keys are sampled
with a chance proportional to size, quantiles of the sample become splitters of many small ranges, exact totals of the
ranges are counted, and ranges that turn out overfull are sampled again and subdivided. A record's exact byte position
follows from the totals of the ranges before its own and a running sum inside it; the position decides the shard. No
shard is more than one record away from its share, and no task orders more than one range.

Null ids and texts are allowed (a null text has no bytes); rows equal in id and text are counted as one unit with a
multiplicity and take consecutive places; a text longer than a shard's share fills what it needs, and is never cut; records
of equal hashes are ordered by their ids' hash and size; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

N_SHARDS = 16
#: Ranges: one per so many rows, within these bounds.
ROWS_PER_RANGE, RANGES = 200_000, (256, 65_536)
SAMPLES_PER_RANGE = 24
#: A range with more than so many times the mean bytes is subdivided, in so many rounds at most.
OVERFULL, ROUNDS, PARTS = 2.0, 6, 8

K1, K2, SIZE, TIMES = "_shard_k1", "_shard_k2", "_shard_size", "_shard_times"


def _keyed(docs: DataFrame, at: str = "") -> DataFrame:
    """``docs`` with its two order keys and its size; ``at``: the struct that holds doc_id and text."""
    text = F.coalesce(f"{at}text", F.lit(""))
    return docs.withColumns(
        {K1: F.xxhash64(text), K2: F.xxhash64(f"{at}doc_id", F.lit(17)), SIZE: F.octet_length(text).cast("long") + 1}
    )


def _range_of(cuts: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below (k1, k2)."""
    s1 = np.array([a for a, _ in cuts], dtype=np.int64)
    s2 = np.array([b for _, b in cuts], dtype=np.int64)

    @F.pandas_udf("int")
    def number(k1: pd.Series, k2: pd.Series) -> pd.Series:
        a, b = k1.to_numpy(np.int64), k2.to_numpy(np.int64)
        low, high = np.searchsorted(s1, a, "left"), np.searchsorted(s1, a, "right")
        out = low.copy()
        for i in np.unique(low[low < high]):  # first keys that splitters share: the second key decides
            rows = np.flatnonzero((low == i) & (high > low))
            out[rows] = i + np.searchsorted(s2[i : high[rows[0]]], b[rows], "right")
        return pd.Series(out.astype(np.int32))

    return number(F.col(K1), F.col(K2))


def _sample(units: DataFrame, step: float, salt: int) -> list[tuple[int, int, float]]:
    """Keys drawn with chance min(1, bytes / step), and the bytes each stands for: about total / step keys."""
    held = (F.col(SIZE) * F.col(TIMES)).cast("double")
    chance = F.shiftrightunsigned(F.xxhash64(K1, K2, F.lit(salt)), 11) / F.lit(float(2**53))
    return sorted(tuple(r) for r in units.where(chance < held / F.lit(step)).select(K1, K2, F.greatest(held, F.lit(step))).collect())


def _quantiles(sample: list[tuple[int, int, float]], n: int) -> list[tuple[int, int]]:
    if not sample:
        return []
    weight = np.cumsum([w for *_, w in sample])
    at = np.minimum(np.searchsorted(weight, weight[-1] * np.arange(1, n) / n), len(sample) - 1)
    return [sample[i][:2] for i in at]


class Plan:
    """Splitters with the bytes and rows before each range; all of it bounded by the number of ranges."""

    def __init__(self, units: DataFrame, ranges: tuple[int, int] = RANGES, rows_per_range: int = ROWS_PER_RANGE):
        held = F.sum(F.col(SIZE) * F.col(TIMES))
        self.rows, self.total = (x or 0 for x in units.agg(F.sum(TIMES), held).first())
        n = min(ranges[1], max(ranges[0], self.rows // rows_per_range))
        self.cuts = sorted(set(_quantiles(_sample(units, max(1.0, self.total / (n * SAMPLES_PER_RANGE)), 0), n)))
        for salt in range(1, ROUNDS + 1):
            sums = {
                r: x for r, *x in units.groupBy(_range_of(self.cuts).alias("r")).agg(held, F.sum(TIMES), F.count("*")).collect()
            }
            over = [r for r, (b, _, c) in sums.items() if b > OVERFULL * self.total / n and c > 1]
            if not over or salt == ROUNDS or len(self.cuts) > ranges[1]:
                break
            step = max(1.0, sum(sums[r][0] for r in over) / (PARTS * SAMPLES_PER_RANGE * len(over)))
            found = _sample(units.where(_range_of(self.cuts).isin(over)), step, salt)
            place = np.searchsorted(np.array([f"{a + 2**63:020d}{b + 2**63:020d}" for a, b in self.cuts]), [f"{a + 2**63:020d}{b + 2**63:020d}" for a, b, _ in found], "right")
            more = {c for r in over for c in _quantiles([x for x, p in zip(found, place, strict=True) if p == r], PARTS)}
            if not more - set(self.cuts):
                break
            self.cuts = sorted(set(self.cuts) | more)
        self.before, b, n = [], 0, 0
        for r in range(len(self.cuts) + 1):
            self.before.append((r, b, n))
            b, n = b + sums.get(r, (0, 0))[0], n + sums.get(r, (0, 0))[1]

    def place(self, df: DataFrame) -> DataFrame:
        """Adds _pos and _row: the bytes and rows that stand before a row's first record."""
        w = W.partitionBy("_range").orderBy(K1, K2, SIZE).rowsBetween(W.unboundedPreceding, -1)
        start = F.broadcast(df.sparkSession.createDataFrame(self.before, "_range int, _b long, _n long"))
        df = df.withColumn("_range", _range_of(self.cuts))
        df = df.withColumns({"_p": F.sum(F.col(SIZE) * F.col(TIMES)).over(w), "_q": F.sum(TIMES).over(w)}).join(start, "_range")
        zero = F.lit(0)
        return df.withColumns({"_pos": F.col("_b") + F.coalesce("_p", zero), "_row": F.col("_n") + F.coalesce("_q", zero)}).drop(
            "_range", "_b", "_n", "_p", "_q"
        )

    def shard(self, pos: Column, n_shards: int) -> Column:
        share = pos.cast("decimal(20,0)") * F.lit(n_shards) / F.lit(max(1, self.total)).cast("decimal(20,0)")
        return F.least(F.lit(n_shards - 1), F.floor(share).cast("int"))


def _units(docs: DataFrame) -> DataFrame:
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    keyed = _keyed(docs.select("doc_id", "text")).select("doc_id", crc.alias("text_crc32"), K1, K2, SIZE)
    return stored(keyed.groupBy("doc_id", "text_crc32", K1, K2, SIZE).agg(F.count("*").alias(TIMES)), "shard-keys")


def _expanded(plan: Plan, units: DataFrame, n_shards: int) -> DataFrame:
    """A row for each record: doc_id, size, text_crc32, shard, _row."""
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col(TIMES) - 1)).alias("_copy")
    each = plan.place(units).select("*", copy)
    shard = plan.shard(F.col("_pos") + F.col("_copy") * F.col(SIZE), n_shards)
    return each.select("doc_id", F.col(SIZE).alias("size"), "text_crc32", shard.alias("shard"), (F.col("_row") + F.col("_copy")).alias("_row"))


def _slotted(df: DataFrame, records: DataFrame) -> DataFrame:
    """Adds slot: the place within the shard, from the first row of each shard among ``records``."""
    first = records.groupBy("shard").agg(F.min("_row").alias("_first"))  # a row for each shard
    return df.join(F.broadcast(first), "shard").withColumn("slot", F.col("_row") - F.col("_first")).drop("_row", "_first")


def shard_assignment(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs`` (doc_id, text)."""
    units = _units(docs)
    each = stored(_expanded(Plan(units), units, n_shards), "shard-rows")
    return _slotted(each, each).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shard_records(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot``, range-partitioned by the splitters (columns of these two
    names are replaced). Equal rows may swap places with each other."""
    docs = docs.drop("shard", "slot")
    units = _units(docs)
    plan = Plan(units)
    each = _expanded(plan, units, n_shards)
    rows = docs.select(F.struct("*").alias("_doc"))  # packed, so that no column's name can clash
    placed = plan.place(_keyed(rows, "_doc.").withColumn(TIMES, F.lit(1).cast("long")))
    placed = placed.withColumn("shard", plan.shard(F.col("_pos"), n_shards))
    return _slotted(placed, each).select("_doc.*", "shard", "slot")


def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its shard of 16 and its slot; edge cases: see the module's text."""
    return shard_assignment(table(spark, sf_dir, "documents"))
