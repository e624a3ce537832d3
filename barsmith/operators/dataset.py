"""Training sets without leakage: target, temporal split, labels, scaling, weights, resampling, sequences."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranges import over_ranges, with_index
from ..functions.windows import last, no_nan, ordered

DOWN, NEUTRAL, UP = 0, 1, 2


def with_target(df: DataFrame, price: str = "close", horizon: int = 4) -> DataFrame:
    """Forward return over ``horizon`` rows; NULL on the last ones of each ticker."""
    return df.withColumn("target", F.try_divide(F.lead(price, horizon).over(ordered()), F.col(price)) - 1)


def temporal_split(df: DataFrame, test_size: float = 0.2, min_rows: int = 32, val_size: float | None = None) -> DataFrame:
    """``split`` by place in each ticker: the first floor(n * (1 - test_size)) rows are train, the rest test; with
    ``val_size``, the last part of train is val. Tickers with fewer than ``min_rows`` rows go."""
    n = F.count("*").over(W.partitionBy("ticker"))
    df = df.withColumns({"_n": n, "_at": F.row_number().over(ordered())}).where(F.col("_n") >= min_rows)
    train = F.floor(F.col("_n") * F.lit(1 - test_size))
    split = F.when(F.col("_at") > train, "test")
    if val_size:
        split = split.when(F.col("_at") > F.floor(train * F.lit(1 - val_size)), "val")
    return df.withColumn("split", split.otherwise("train")).drop("_n", "_at")


def group_quantiles(df: DataFrame, column: str, shares: tuple[float, ...], by: tuple[str, ...], accuracy: int = 10_000) -> DataFrame:
    """``by`` and ``_q``, the exact quantiles (between neighbours by place) of each group's values; missing values, NaN and
    infinities don't count, groups without values and rows without a group are left out.

    A sketch of bounded size gives each quantile a bracket that is sure to hold it; groups of at most ``accuracy`` values are
    brackets themselves. Values in a bracket (a few in ``accuracy`` of the group) are put in order, those below are only
    counted, before the exchange. So no buffer and no task holds a group."""
    values = df.select(*by, no_nan(F.col(column).cast("double")).alias("_v")).where("_v IS NOT NULL")
    reach = 4 / accuracy  # the sketch may be one off in ``accuracy``, places are two ranks wide
    around = [min(1.0, max(0.0, s + d)) for s in shares for d in (-reach, reach)]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(a) for a in around]), accuracy)
    ends = values.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), sketch.alias("_a"))
    few = F.col("_n") <= accuracy
    low = [F.when(few | F.lit(a <= 0), F.col("_min")).otherwise(F.col("_a")[2 * j]) for j, a in enumerate(around[::2])]
    high = [F.when(few | F.lit(a >= 1), F.col("_max")).otherwise(F.col("_a")[2 * j + 1]) for j, a in enumerate(around[1::2])]
    ends = ends.select(*by, "_n", *[c.alias(f"_low{j}") for j, c in enumerate(low)], *[c.alias(f"_high{j}") for j, c in enumerate(high)])
    v = F.col("_v")
    parts = [F.when(v <= F.col(f"_high{j}"), F.struct(F.lit(j).alias("j"), F.when(v >= F.col(f"_low{j}"), v).alias("x"))) for j in range(len(shares))]
    found = values.join(ends, list(by)).select(*by, "_n", F.explode(F.array_compact(F.array(*parts))).alias("_p"))
    found = found.groupBy(*by, "_n", F.col("_p.j").alias("_j"), F.col("_p.x").alias("_x")).agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(W.partitionBy(*by, "_j").orderBy(F.col("_x").asc_nulls_first()))
    place = (F.col("_n") - 1) * F.get(F.array(*[F.lit(float(s)) for s in shares]), F.col("_j"))
    found = found.withColumns({"_upto": upto, "_at": place})
    held = lambda r: F.max(F.when((r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_k")), F.col("_x")))
    ends = found.groupBy(*by, "_j").agg(held(F.floor("_at")).alias("_lower"), held(F.ceil("_at")).alias("_upper"), F.first("_at").alias("_at"))
    between = (F.ceil("_at") - F.col("_at")) * F.col("_lower") + (F.col("_at") - F.floor("_at")) * F.col("_upper")
    ends = ends.withColumn("_x", F.when(F.col("_lower") == F.col("_upper"), F.col("_lower")).otherwise(between))
    return ends.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_j", "_x"))), lambda s: s["_x"]).alias("_q"))


def thresholds(df: DataFrame, band: tuple[float, float] = (0.45, 0.55), by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Exact quantiles of the target, for each group."""
    return group_quantiles(df, "target", band, by).select(*by, F.col("_q")[0].alias("q_low"), F.col("_q")[1].alias("q_high"))


def labelled(df: DataFrame, band: tuple[float, float] = (0.45, 0.55), per_split: bool = False) -> DataFrame:
    """``label``: 2 above the high quantile of the ticker's train rows, 0 below the low one, else 1; with ``per_split``
    each split uses quantiles of its own."""
    by = ("ticker", "split") if per_split else ("ticker",)
    q = thresholds(df if per_split else df.where("split = 'train'"), band, by)
    label = F.when(F.col("target") > F.col("q_high"), UP).when(F.col("target") < F.col("q_low"), DOWN).otherwise(NEUTRAL)
    return df.join(q, list(by)).withColumn("label", label)


def exact_quantiles(df: DataFrame, columns: list[str], shares: tuple[float, ...], most: int = 1_000_000, parts: int = 128) -> dict[str, list[float | None]]:
    """For each column the quantiles (between neighbours by place) of its values; missing values, NaN and infinities don't
    count. Around each place that is asked for, a bracket is cut into ``parts`` ranges whose rows are counted, until it
    holds ``most`` values at most or only equal ones; only those are put in order. So no task orders or holds a column,
    and the driver sees counts. The columns are worked out once and kept until all is found."""
    columns_only = df.select(*[no_nan(F.col(c).cast("double")).alias(c) for c in columns]).persist()
    try:
        return _exact_quantiles(columns_only, columns, shares, most, parts)
    finally:
        columns_only.unpersist()


def _exact_quantiles(df: DataFrame, columns: list[str], shares: tuple[float, ...], most: int, parts: int) -> dict[str, list[float | None]]:
    row = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
    wanted = {i: [(row[f"n{i}"] - 1) * s for s in shares] for i in range(len(columns)) if row[f"n{i}"]}
    #: (column, place): least and largest value of the bracket, values before it, values in it
    open_ = {(i, r): (float(row[f"a{i}"]), float(row[f"b{i}"]), 0, row[f"n{i}"]) for i, ps in wanted.items() for p in ps for r in (math.floor(p), math.ceil(p))}
    while wide := {k: v for k, v in open_.items() if v[3] > most and v[0] < v[1]}:
        keys = {(i, *b): (i, b) for (i, _), b in wide.items()}
        cut = [F.when(F.col(columns[i]).between(a, b), F.struct(F.lit(j).alias("j"), F.least(F.lit(parts - 1), F.floor((F.col(columns[i]) - a) / (b - a) * parts)).alias("part"), F.col(columns[i]).alias("x"))) for j, (i, (a, b, *_)) in enumerate(keys.values())]
        found = df.select(F.explode(F.array_compact(F.array(*cut))).alias("_c")).select("_c.*").groupBy("j", "part").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        by: dict[int, list] = {}
        for x in sorted(found.collect()):  # at most ``parts`` rows for each bracket
            by.setdefault(x["j"], []).append(x)
        for (i, r), bracket in wide.items():
            before = bracket[2]
            for x in by[list(keys).index((i, *bracket))]:
                if r < before + x["n"]:
                    open_[i, r] = (x["a"], x["b"], before, x["n"])
                    break
                before += x["n"]
    narrow = {(i, v): None for (i, _), v in open_.items() if v[0] < v[1]}
    values: dict = {}
    if narrow:
        cut = [F.when(F.col(columns[i]).between(a, b), F.struct(F.lit(j).alias("j"), F.col(columns[i]).alias("x"))) for j, (i, (a, b, *_)) in enumerate(narrow)]
        each = df.select(F.explode(F.array_compact(F.array(*cut))).alias("_c")).select("_c.*").groupBy("j", "x").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(W.partitionBy("j").orderBy("x"))
        places = spark_rows(df, [(j, r - v[2]) for j, (i, v) in enumerate(narrow) for (k, r), o in open_.items() if k == i and o == v], "j int, r long")
        placed = each.withColumn("upto", upto).join(F.broadcast(places), "j").where("r < upto AND r >= upto - n")  # a row for each place
        found = {(x["j"], x["r"]): x["x"] for x in placed.select("j", "r", "x").collect()}
        values = {(i, r): found[j, r - v[2]] for j, (i, v) in enumerate(narrow) for (k, r), o in open_.items() if k == i and o == v}
    at = lambda i, r: values.get((i, r), open_[i, r][0])

    def between(i: int, p: float) -> float:
        low, high = at(i, math.floor(p)), at(i, math.ceil(p))
        return low if low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high

    return {c: [between(i, p) for p in wanted[i]] if i in wanted else [None] * len(shares) for i, c in enumerate(columns)}


def spark_rows(df: DataFrame, rows: list, schema: str) -> DataFrame:
    """A few rows as literals: no Python worker is needed to read them."""
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    structs = [F.struct(*[F.lit(x).cast(kind).alias(name.strip("`")) for x, (name, kind) in zip(row, fields, strict=True)]) for row in rows]
    return df.sparkSession.range(1).select(F.inline(F.array(*structs)))


def robust_parameters(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: median and interquartile range (1 where it is 0) of each column over the train rows of all tickers."""
    found = exact_quantiles(df.where("split = 'train'"), columns, (0.25, 0.5, 0.75))
    row = {}
    for c, (low, mid, high) in found.items():
        row |= {f"{c}_median": mid, f"{c}_iqr": None if mid is None else (high - low) or 1.0}
    return spark_rows(df, [tuple(row.values())], ", ".join(f"`{k}` double" for k in row))


def robust_scaled(df: DataFrame, columns: list[str], parameters: DataFrame | None = None) -> DataFrame:
    row = parameters if parameters is not None else robust_parameters(df, columns)
    wide = df.crossJoin(F.broadcast(row))  # one row
    scaled = {c: (F.col(c) - F.col(f"{c}_median")) / F.col(f"{c}_iqr") for c in columns}
    return wide.withColumns(scaled).select(*df.columns)


def class_weights(df: DataFrame, classes: int = 3) -> DataFrame:
    """(label, n, percent, weight): counts of all classes, also empty ones; weights N / (n + 1e-6), with mean 1."""
    spark = df.sparkSession
    dim = spark.range(classes).select(F.col("id").cast("int").alias("label"))
    n = df.groupBy("label").agg(F.count("*").alias("n"))
    n = dim.join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    every = W.partitionBy()
    raw = F.sum("n").over(every) / (F.col("n") + 1e-6)
    n = n.withColumns({"percent": F.try_divide(100.0 * F.col("n"), F.sum("n").over(every)), "_raw": raw})
    return n.withColumn("weight", F.col("_raw") / F.avg("_raw").over(every)).drop("_raw")


def with_weights(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(class_weights(df).select("label", "weight")), "label")


def _draw(*key, salt: int):
    """A double in [0, 1) that retries and partitions don't change."""
    return F.shiftrightunsigned(F.xxhash64(*key, F.lit(salt)), 11) / F.lit(float(2**53))


def balanced_resample(df: DataFrame, n: int, keys: tuple[str, ...] = ("ticker", "ts"), seed: int = 1, most: int = 64) -> DataFrame:
    """About ``n`` rows drawn with replacement so that classes are equally likely: each row is repeated a Poisson number
    of times with mean n / classes / (rows of its class). ``most`` bounds the terms of the Poisson sum, not the rows:
    the whole part of the mean is taken for certain."""
    counts = df.groupBy("label").agg(F.count("*").alias("_n"))
    k = counts.agg(F.count("*").alias("_k"))
    rate = counts.crossJoin(F.broadcast(k)).select("label", (F.lit(float(n)) / F.col("_k") / F.col("_n")).alias("_rate"))
    drawn = df.join(F.broadcast(rate), "label").withColumn("_u", _draw(*keys, salt=seed))
    part = F.col("_rate") - F.floor("_rate")
    # inverse of the distribution function, term by term
    terms = F.sequence(F.lit(1), F.lit(most))
    start = F.struct(F.exp(-part).alias("p"), F.exp(-part).alias("cdf"), F.lit(0).alias("k"))
    step = lambda s, i: F.struct((s["p"] * part / i).alias("p"), (s["cdf"] + s["p"] * part / i).alias("cdf"), F.when(F.col("_u") >= s["cdf"], i).otherwise(s["k"]).alias("k"))
    times = F.floor("_rate").cast("int") + F.aggregate(terms, start, step)["k"]
    return drawn.withColumn("_t", times).where("_t > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_t")))).select(*df.columns)


def _numbered(df: DataFrame, keys: tuple[str, ...], ranges: int) -> DataFrame:
    """_row (all columns), _pool (the label), _no and _of_any: numbers from 0 of the rows of a label, and of all rows. Rows
    are numbered within hash ranges of their class, and ranges by the counts of those before: no task holds a class."""
    ranged = df.select(F.struct(*df.columns).alias("_row"), F.col("label").cast("int").alias("_pool"), F.pmod(F.xxhash64(*keys), F.lit(ranges)).alias("_range"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    held = ranged.groupBy("_pool", "_range").agg(F.count("*").alias("_held"))
    before = lambda w: F.coalesce(F.sum("_held").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = held.select("_pool", "_range", before(W.partitionBy("_pool").orderBy("_range")).alias("_start"), before(W.partitionBy().orderBy("_pool", "_range")).alias("_any"))
    order = W.partitionBy("_pool", "_range").orderBy(*[f"_k{i}" for i in range(len(keys))])
    rows = ranged.withColumn("_in", F.row_number().over(order) - 1).join(starts, ["_pool", "_range"])
    rows = rows.select("_row", "_pool", (F.col("_in") + F.col("_start")).alias("_no"), (F.col("_in") + F.col("_any")).alias("_of_any"))
    return rows


def resample(df: DataFrame, n: int, keys: tuple[str, ...] = ("ticker", "ts"), seed: int = 1, ranges: int = 4096) -> DataFrame:
    """Exactly ``n`` rows of ``df`` drawn with replacement, all classes that have rows equally likely, and within a class all
    rows: each draw picks a class and a number in it from a hash of its own number. Without rows there is nothing to draw."""
    counts = df.groupBy(F.col("label").cast("int").alias("_c")).agg(F.count("*").alias("_n")).where("_c IS NOT NULL")
    kinds = counts.agg(F.sort_array(F.collect_list(F.struct("_c", "_n"))).alias("_kinds")).where(F.size("_kinds") > 0)  # one row, an entry for each class
    draws = df.sparkSession.range(n).crossJoin(F.broadcast(kinds))
    kind = F.get("_kinds", F.pmod(F.xxhash64("id", F.lit(seed)), F.size("_kinds")).cast("int"))
    draws = draws.select("id", kind.alias("_k")).select("id", F.col("_k._c").alias("_c"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.col("_k._n")).alias("_pick"))
    rows = _numbered(df, keys, ranges)
    return draws.join(rows, (F.col("_c") == F.col("_pool")) & (F.col("_pick") == F.col("_no"))).select("_row.*")


def balanced_batches(df: DataFrame, batch: int, n_batches: int, classes: int = 3, keys: tuple[str, ...] = ("ticker", "ts"), seed: int = 1, ranges: int = 4096) -> DataFrame:
    """(batch_no, slot, drawn row): batch // classes slots for each class, one more for the first classes while there is
    a rest; each slot draws a row of its class with replacement, or any row where the class is empty."""
    spark = df.sparkSession
    sizes = [batch // classes + (c < batch % classes) for c in range(classes)]
    slots = spark.range(n_batches).select(F.col("id").alias("batch_no"), F.explode(F.array(*[F.lit(c) for c in range(classes)])).alias("wanted"))
    slots = slots.withColumn("slot", F.explode(F.sequence(F.lit(0), F.get(F.array(*[F.lit(max(0, s - 1)) for s in sizes]), F.col("wanted")))))
    slots = slots.where(F.col("slot") < F.get(F.array(*[F.lit(s) for s in sizes]), F.col("wanted")))
    rows = _numbered(df, keys, ranges)
    counts = df.groupBy(F.col("label").cast("int").alias("_c")).agg(F.count("*").alias("_n"))
    slots = slots.join(F.broadcast(counts), F.col("wanted") == F.col("_c"), "left")  # a row for each class
    hashed = F.xxhash64("batch_no", "wanted", "slot", F.lit(seed))
    picked = slots.where("_n IS NOT NULL").withColumn("_pick", F.pmod(hashed, F.col("_n")))
    found = picked.join(rows, (F.col("wanted") == F.col("_pool")) & (F.col("_pick") == F.col("_no"))).select("batch_no", "wanted", "slot", "_row.*")
    number = dict(counts.collect())
    if set(range(classes)) - set(number):
        picked = slots.where("_n IS NULL").withColumn("_pick", F.pmod(hashed, F.lit(max(1, sum(number.values())))))
        found = found.unionByName(picked.join(rows, F.col("_pick") == F.col("_of_any")).select("batch_no", "wanted", "slot", "_row.*"))
    return found


def sequences(df: DataFrame, columns: list[str], length: int = 16, include_first: bool = True) -> DataFrame:
    """ticker, ts, label and the ``length`` rows that end there; without ``include_first`` a ticker's first full window
    is left out."""
    window = lambda w: {"window": F.collect_list(F.struct(*columns)).over(last(length, w))}
    rows = over_ranges(with_index(df), window, before=length - 1)
    return rows.where(F.col("_i") >= length - include_first).select("ticker", "ts", "label", "window")


def prepare(features: DataFrame, columns: list[str], horizon: int = 4, test_size: float = 0.2, band: tuple[float, float] = (0.45, 0.55), min_rows: int = 32, val_size: float | None = None, price: str = "Close") -> DataFrame:
    """Features to a scaled, labelled and split table. Rows with a missing value go before anything is counted;
    quantiles and scaling see train rows only."""
    df = with_target(features, price, horizon).dropna("any", subset=[*columns, "target"])
    df = temporal_split(df, test_size, min_rows, val_size)
    return robust_scaled(labelled(df, band), columns, robust_parameters(df, columns))  # labels leave all train rows


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
