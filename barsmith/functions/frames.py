"""Aggregates over long frames of an ordered series at a cost that does not grow with the frame.

A series is cut into blocks as long as the frame. The last n rows are then the end of one block and the beginning of the
next, and both are running aggregates, one forwards and one backwards; means and deviations of the two are put together
without a difference of large sums. What has no such form (ranks, mean deviations: :mod:`ranks`) is worked out in Arrow
batches over parts of a series, each with the rows before it that its first frames need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import ranged, with_index
from .windows import KEY, full, lagged, ordered, upto

#: Shorter frames are left to plain windows.
LONG = 64
#: Rows of a series in one part.
PART = 4_096

PLAIN = {"max": F.max, "min": F.min, "sum": F.sum, "avg": F.avg, "stddev_samp": F.stddev_samp, "stddev_pop": F.stddev_pop}
#: The running aggregates that each kind is put together from.
RUNNING = {"max": ("max",), "min": ("min",), "sum": ("sum",), "avg": ("avg",), "stddev_samp": ("avg", "var_pop"), "stddev_pop": ("avg", "var_pop")}


def _combined(kind: str, n: int, a: dict[str, Column], b: dict[str, Column], n_b: Column) -> Column:
    """From a, running aggregates of the n - n_b rows up to the current one, and b, those of the n_b rows before."""
    if kind in ("max", "min"):
        return (F.greatest if kind == "max" else F.least)(a[kind], b[kind])
    if kind == "sum":
        return a["sum"] + F.when(n_b > 0, b["sum"]).otherwise(0)
    n_a = n - n_b
    if kind == "avg":
        return F.when(n_b == 0, a["avg"]).otherwise((a["avg"] * n_a + b["avg"] * n_b) / n)
    between = (a["avg"] - b["avg"]) * (a["avg"] - b["avg"]) * n_a * n_b / n
    squares = a["var_pop"] * n_a + F.when(n_b > 0, b["var_pop"] * n_b + between).otherwise(0.0)
    return F.sqrt(squares / (n - 1 if kind == "stddev_samp" else n))


def long_frames(df: DataFrame, wanted: dict[str, tuple[str, str, int]]) -> DataFrame:
    """``df`` with, for each name of ``wanted``, a kind of PLAIN of a column over the last n rows of its ticker, NULL unless
    all n values are there. Rows of :func:`ranges.in_ranges` stay in their ranges."""
    if "_part" in df.columns:
        keys, w = (KEY, "_part"), ranged()
    else:
        keys, w = (KEY,), ordered()
    short = {name: full(x, n, PLAIN[kind], w) for name, (kind, x, n) in wanted.items() if n < LONG}
    wanted = {name: of for name, of in wanted.items() if name not in short}
    df = df.withColumns(short) if short else df
    if not wanted:
        return df
    kept = [F.col(c) for c in df.columns]
    df = df if "_i" in df.columns else with_index(df)
    df = df.withColumns({f"_b{n}": F.floor(F.col("_i") / n) for n in {n for *_, n in wanted.values()}})
    first, second = {}, {}
    for kind, x, n in wanted.values():
        block = W.partitionBy(*keys, f"_b{n}")
        forward, backward = upto(block.orderBy("_i")), upto(block.orderBy(F.col("_i").desc()))
        for agg in RUNNING[kind]:
            first[f"_a_{agg}_{x}_{n}"] = getattr(F, agg)(x).over(forward)
            first[f"_z_{agg}_{x}_{n}"] = getattr(F, agg)(x).over(backward)
            second[f"_y_{agg}_{x}_{n}"] = lagged(f"_z_{agg}_{x}_{n}", n - 1, w)
        first[f"_k_{x}"] = F.count(x).over(upto(w))
        second[f"_j_{x}_{n}"] = F.coalesce(lagged(f"_k_{x}", n, w), F.lit(0))
    df = df.withColumns(first).withColumns(second)
    out = {}
    for name, (kind, x, n) in wanted.items():
        a, b = ({agg: F.col(f"_{side}_{agg}_{x}_{n}") for agg in RUNNING[kind]} for side in "ay")
        value = _combined(kind, n, a, b, n - 1 - F.col("_i") % n)
        out[name] = F.when(F.col(f"_k_{x}") - F.col(f"_j_{x}_{n}") == n, value)
    return df.select(*kept, *[c.alias(name) for name, c in out.items()])


def in_parts(df: DataFrame, wanted: dict[str, tuple], part: int = PART) -> DataFrame:
    """``df`` with, for each name of ``wanted`` (function, column, n), function(values, n) over the series, as a double."""
    before = max(n for *_, n in wanted.values()) - 1
    part = max(part, before)
    columns, schema = df.columns, df.schema
    rows = df if "_i" in columns else with_index(df)
    own = F.floor(F.col("_i") / part)
    near_end = F.col("_i") % part >= part - before
    rows = rows.withColumn("_part", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i").combine_chunks()
        mine = table["_i"].to_numpy() // part == table["_part"].to_numpy()
        out = table.select(columns)
        for name, (function, x, n) in wanted.items():
            found = function(table[x].to_numpy().astype(np.float64), n)
            out = out.append_column(name, pa.array(found, pa.float64(), from_pandas=True))
        return out.filter(pa.array(mine))

    for name in wanted:
        schema = schema.add(name, "double")
    return rows.groupBy(KEY, "_part").applyInArrow(run, schema)
