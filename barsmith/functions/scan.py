"""First-order recurrences y[t] = a * y[t-1] + b * x[t] over ordered series, in built-in functions only.

Rows of a series are cut into blocks, and blocks into parts. Inside a block the recurrence is a running sum of x weighted by
powers of a. The values at block ends compose: a fold over the few blocks of a part gives what each block inherits within it,
and a window over the parts of a series what each part inherits. So no task holds a series, only one row for each part of it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import with_index

__all__ = ["Recurrence", "affine_scan", "ema", "wilder", "with_index"]

BLOCK = 256
#: Blocks of a part.
BLOCKS = 64
#: What has decayed by this power of e is gone.
GONE = 42.0


@dataclass(frozen=True)
class Recurrence:
    """``name`` gets y; y[first] = seed, NULL before. A number n as seed is the mean of the n values of x that end there.
    ``x`` must not be NULL where it is used."""

    name: str
    x: Column
    a: float
    b: float
    first: int
    seed: Column | int


def _terms(r: Recurrence) -> dict[str, tuple[Column, float]]:
    """Recurrences y[t] = a * y[t-1] + u[t] from 0 that ``r`` is made of: name, u and a."""
    i = F.col("_i")
    if isinstance(r.seed, Column):
        return {r.name: (F.when(i < r.first, 0.0).when(i == r.first, r.seed).otherwise(r.b * r.x), r.a)}
    seed = F.when((i > r.first - r.seed) & (i <= r.first), r.x / r.seed).otherwise(0.0)
    return {r.name: (F.when(i <= r.first, 0.0).otherwise(r.b * r.x), r.a), f"{r.name}#": (seed, 1.0)}


def _value(r: Recurrence, term: dict[str, Column], i: Column) -> Column:
    """y at place ``i`` from the values of its terms."""
    y = term[r.name]
    if f"{r.name}#" in term:
        y = y + term[f"{r.name}#"] * F.pow(F.lit(r.a), F.greatest(i - r.first, F.lit(0)))
    return F.when(i >= r.first, y)


def affine_scan(df: DataFrame, recurrences: list[Recurrence], key: str = "ticker", block: int = BLOCK, lags: tuple[str, ...] = (), blocks: int = BLOCKS) -> DataFrame:
    """``df`` (with _i) and a column for each recurrence; for each name of ``lags`` also ``name_lag``, the value of the row
    before. All of them share one pass."""
    terms = {n: t for r in recurrences for n, t in _terms(r).items()}
    at_of = {n: k for k, n in enumerate(terms)}
    powers = [a for _, a in terms.values()]
    rows = df.withColumns({"_block": F.floor(F.col("_i") / block), "_at": F.col("_i") % block})
    inputs = {f"_u{k}": u for k, (u, _) in enumerate(terms.values())}
    rows = rows.withColumns(inputs)
    order = W.partitionBy(key, "_block").orderBy("_i")
    within = order.rowsBetween(W.unboundedPreceding, 0)

    def local(k: int, a: float) -> Column:
        u = F.col(f"_u{k}")
        if a == 1:
            return F.sum(u).over(within)
        if a < 0.07:  # powers over a block would overflow; so short a memory ends within a few rows
            past = u
            for n in range(1, 2 + int(40 / -math.log10(a)) if a else 1):
                past = past + F.coalesce(F.lag(u, n).over(order), F.lit(0.0)) * a**n
            return past
        return F.sum(u * F.pow(F.lit(a), -F.col("_at"))).over(within) * F.pow(F.lit(a), F.col("_at"))

    rows = rows.withColumns({f"_y{k}": local(k, a) for k, a in enumerate(powers)}).drop(*inputs)
    carried = _carries(rows, key, powers, block, blocks)
    rows = rows.join(carried, (rows[key] == carried["_key"]) & (rows["_block"] == carried["_to"]), "left").drop("_key", "_to")
    before = {n: F.coalesce(F.get("_carry", F.lit(k)), F.lit(0.0)) for n, k in at_of.items()}  # where the block begins
    now = {n: F.col(f"_y{k}") + before[n] * F.pow(F.lit(powers[k]), F.col("_at") + 1) for n, k in at_of.items()}
    out = rows.withColumns({r.name: _value(r, now, F.col("_i")) for r in recurrences})
    prior = {f"{r.name}_lag": F.when(F.col("_at") == 0, _value(r, before, F.col("_i") - 1)).otherwise(F.lag(r.name).over(order)) for r in recurrences if r.name in lags}
    return out.withColumns(prior).drop("_carry", "_block", "_at", *[f"_y{k}" for k in range(len(terms))])


def _carries(rows: DataFrame, key: str, powers: list[float], block: int, blocks: int) -> DataFrame:
    """(_key, _to, _carry): for each block ``_to`` but the first of a series the values of all terms where the block before
    ends."""
    n = len(powers)
    by_block, by_part = [a**block for a in powers], [a ** (block * blocks) for a in powers]
    floats = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    ends = rows.where(F.col("_at") == block - 1).select(key, F.floor(F.col("_block") / blocks).alias("_p"), F.struct("_block", F.array(*[f"_y{k}" for k in range(n)]).alias("e")).alias("_end"))
    folded = ends.groupBy(key, "_p").agg(F.sort_array(F.collect_list("_end")).alias("_ends"))  # one for each block of a part

    def step(state: Column, x: Column) -> Column:
        c = F.transform(state["c"], lambda v, k: v * F.get(floats(by_block), k) + F.get(x["e"], k))
        return F.struct(c.alias("c"), F.array_append(state["out"], c).alias("out"))

    start = F.struct(floats([0.0] * n).alias("c"), F.expr("CAST(array() AS array<array<double>>)").alias("out"))
    folded = folded.select(key, "_p", F.aggregate("_ends", start, step, lambda s: s["out"]).alias("_within"))
    # what a part inherits: of the parts before, as many as are not forgotten; sums forget nothing
    parts = W.partitionBy(key).orderBy("_p")
    reach = max([1, *[math.ceil(GONE / -math.log(a)) for a in by_part if 1e-300 < a < 1]])
    past = F.collect_list(F.element_at("_within", -1)).over(parts.rowsBetween(-reach, -1))
    folded = folded.withColumns({"_past": past} | {f"_sum{k}": F.sum(F.element_at("_within", -1)[k]).over(parts.rowsBetween(W.unboundedPreceding, -1)) for k, a in enumerate(powers) if a == 1})
    fold = F.aggregate("_past", floats([0.0] * n), lambda c, e: F.transform(c, lambda v, k: v * F.get(floats(by_part), k) + F.get(e, k)))
    folded = folded.withColumn("_fold", fold)
    inherited = F.array(*[F.coalesce(F.col(f"_sum{k}"), F.lit(0.0)) if a == 1 else F.get("_fold", F.lit(k)) for k, a in enumerate(powers)])
    each = folded.withColumn("_in", inherited).select(F.col(key).alias("_key"), "_p", "_in", F.posexplode("_within").alias("_b", "_c"))
    carry = F.transform("_c", lambda v, k: v + F.get("_in", k) * F.pow(F.get(floats(by_block), k), F.col("_b") + 1))
    return each.select("_key", (F.col("_p") * blocks + F.col("_b") + 1).alias("_to"), carry.alias("_carry"))


def ema(name: str, x: Column, n: int) -> Recurrence:
    """Exponential mean: k = 2 / (n + 1), seeded with the mean of the first n values."""
    k = 2 / (n + 1)
    return Recurrence(name, x, 1 - k, k, n - 1, n)


def wilder(name: str, x: Column, n: int) -> Recurrence:
    """Wilder's mean of x[1..]: seeded at row n with the mean of x[1..n]."""
    return Recurrence(name, x, (n - 1) / n, 1 / n, n, n)
