"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only.

A source's target share of words divided by its size is the number of copies each of its documents should get. The
whole part is taken for certain; the fractional parts are rounded together. Two documents with chances p and q and
sizes a and b meet, and words move between them, at random in either direction but fair in the mean, until one chance
is 0 or 1: a*p + b*q never changes, so a source's taken words miss its target by less than one document. Blocks of
documents are folded at once and each leaves one undecided document; these form the next level of a reduction tree,
down to one per source, which a fair coin decides. Randomness is a hash of document and level: reruns agree.

m rows equal in id, text and source are one unit: of their m chances the whole part is taken for certain, and what is
left is one chance of one row, which is rounded with the others. So equal rows differ by one copy at most, and a row
that is repeated any number of times moves a source no further from its target than a single one does. Null sources
form a group of their own, which comes last; null and empty texts have size 0 and take no words; equal chances are told
apart by hashes; a very long text is one unit like any other; an empty table gives no rows; extra columns are untouched
by :func:`mixed_documents`. The table of sources may be long (a source can be a host): their order and running sums are
found in ranges, with one row for each range put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_WORD, stored, table

WEIGHTS = (1, 2, 3)
MOST = 3
#: Documents in a block of the reduction tree, on average.
BLOCK = 64

#: One step of the fold: s is the undecided document (place i, chance p, size a) with the decisions so far, x the next.
STEP = """
IF(s.i = 0, named_struct('i', x.i, 'p', x.p, 'a', x.a, 'out', s.out),
 IF(x.u * (least(1 - s.p, x.p * x.a / s.a) + least(s.p, (1 - x.p) * x.a / s.a)) < least(s.p, (1 - x.p) * x.a / s.a),
  IF(1 - s.p <= x.p * x.a / s.a,
   named_struct('i', x.i, 'p', x.p - (1 - s.p) * s.a / x.a, 'a', x.a, 'out', array_append(s.out, named_struct('i', s.i, 'up', 1))),
   named_struct('i', s.i, 'p', s.p + x.p * x.a / s.a, 'a', s.a, 'out', array_append(s.out, named_struct('i', x.i, 'up', 0)))),
  IF(s.p <= (1 - x.p) * x.a / s.a,
   named_struct('i', x.i, 'p', x.p + s.p * s.a / x.a, 'a', x.a, 'out', array_append(s.out, named_struct('i', s.i, 'up', 0))),
   named_struct('i', s.i, 'p', s.p - (1 - x.p) * x.a / s.a, 'a', s.a, 'out', array_append(s.out, named_struct('i', x.i, 'up', 1))))))
"""
FOLD = f"""
aggregate(transform(block, (y, k) -> named_struct('i', k + 1, 'p', y.p, 'a', y.a, 'u', y.u)),
 named_struct('i', 0, 'p', 0D, 'a', 0D, 'out', CAST(array() AS array<struct<i:int,up:int>>)), (s, x) -> {STEP})
"""


def _chance(*of: str | Column) -> Column:
    """A double in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(2**53))


def units(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, source, size in words, and the number of rows equal in these."""
    size = F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "source", size.alias("size"))
    return rows.groupBy("doc_id", "h", "source", "size").agg(F.count("*").alias("m"))


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``sums``, the sum over the rows that stand before a row, and over all rows as <name>_all."""
    own = df.withColumns({f"_{k}": v for k, v in sums.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    own = stored(own, "mix-ranges")
    totals = own.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"_t_{k}") for k in sums])  # a row for each range
    ranges = W.partitionBy().orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(ranges), zero).alias(f"_b_{k}") for k in sums], *[F.sum(f"_t_{k}").over(W.partitionBy()).alias(f"{k}_all") for k in sums])
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = own.withColumns({k: F.coalesce(F.sum(f"_{k}").over(inside), zero) for k in sums}).join(F.broadcast(starts), "_range")
    return out.withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in sums}).drop("_range", *[f"{x}{k}" for k in sums for x in ("_", "_b_")])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of all words by weight, none above ``most`` times its size.

    Filling up by weight while caps hold: in the order of cap / weight, the level is the largest of (words not yet
    given to those before) / (weight of those from here on)."""
    name = F.col("source").asc_nulls_last()
    ranked = _running(sizes, [name], {"_place": F.lit(1).cast("long")}).drop("_place_all")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * most).drop("_place")
    filled = _running(ranked.withColumn("_ratio", F.col("cap") / F.col("w")), [F.col("_ratio"), name], {"_before": F.col("cap"), "_weight": F.col("w"), "_words": F.col("source_size")})
    filled = stored(filled.withColumn("level", (F.col("_words_all") - F.col("_before")) / (F.col("_weight_all") - F.col("_weight"))), "mix-levels")
    level = filled.agg(F.max("level")).first()[0] or 0.0
    return filled.select("source", "source_size", "n", F.least(F.col("cap").cast("double"), F.col("w") * F.lit(level)).alias("target"))


def _level(items: DataFrame, blocks: Column, level: int) -> DataFrame:
    """Folds blocks of ``items`` (source, blocks, p, a, ...): the items with ``up`` 0 or 1, or null where undecided."""
    key = F.xxhash64("doc_id", "h", "source", F.lit(level))
    order = F.xxhash64("doc_id", "h", "size", F.lit(level)).alias("order")
    item = F.struct("a", order, "doc_id", "h", "size", "m", "whole", "extra", "p", _chance("doc_id", "h", F.lit(1000 + level)).alias("u"))
    # the largest first: small documents settle them, and what stays undecided is small
    block = F.sort_array(F.collect_list(item), asc=False).alias("block")
    rows = items.groupBy("source", "blocks", F.pmod(key, blocks).alias("block_no")).agg(block)
    rows = rows.withColumn("fold", F.expr(FOLD))
    left = F.struct(F.col("fold.i").alias("i"), F.lit(None).cast("int").alias("up"))
    rows = rows.select("source", "blocks", "block", "fold.p", F.explode(F.concat("fold.out", F.array(left))).alias("d"))
    own = F.element_at("block", F.col("d.i"))
    return rows.select(
        "source", "blocks", *[own[c].alias(c) for c in ("doc_id", "h", "size", "m", "whole", "extra", "a")], F.when(F.col("d.up").isNull(), F.col("p")).alias("p"), F.col("d.up").alias("up")
    )


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, h, source, size, m, whole, extra, source_size, target: one row for each unit of ``docs``. Each of its m rows
    is taken ``whole`` times, and ``extra`` of them once more."""
    own = stored(units(docs), "mix-units")
    sizes = own.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n"))
    sources = stored(source_targets(sizes, weights, most), "mix-sources")
    n = sources.agg(F.max("n")).first()[0] or 0

    rate = F.least(F.lit(float(most)), F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    all_units = own.join(sources, own["source"].eqNullSafe(sources["source"])).select(own["*"], "n", rate.alias("rate"))
    all_units = all_units.select("doc_id", "h", "source", "size", "m", "n", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"))
    # of m equal rows, so many have a copy more for certain; p is the chance of one more
    all_units = all_units.withColumn("extra", F.floor(F.col("m") * F.col("p"))).withColumn("p", F.col("m") * F.col("p") - F.col("extra"))
    split = (F.col("size") > 0) & (F.col("p") > 0)
    plain = all_units.where(~split).withColumn("up", (_chance("doc_id", "h", F.lit(7)) < F.col("p")).cast("int"))
    items = all_units.where(split).withColumn("a", F.col("size").cast("double"))
    items = items.withColumn("blocks", F.ceil(F.col("n") / block)).drop("n")

    out = ["doc_id", "h", "source", "size", "m", "whole", "extra", "up"]
    done, level = [plain.select(out)], 0
    while True:
        last = n <= block
        if last:  # one block for each source
            items = items.withColumn("blocks", F.lit(1).cast("long"))
        folded = stored(_level(items, F.col("blocks"), level), "mix-level")
        done.append(folded.where("up IS NOT NULL").select(out))
        left = folded.where("up IS NULL")
        if last:
            coin = (_chance("doc_id", "h", F.lit(2000)) < F.col("p")).cast("int")
            done.append(left.withColumn("up", coin).select(out))
            break
        n, level = -(-n // block), level + 1
        items = left.drop("up").withColumn("blocks", F.ceil(F.col("blocks") / block))
    rounded = done[0]
    for x in done[1:]:
        rounded = rounded.unionByName(x)
    rounded = rounded.withColumn("extra", F.col("extra") + F.col("up"))
    return rounded.join(sources, rounded["source"].eqNullSafe(sources["source"])).select(
        *[rounded[c] for c in ("doc_id", "h", "source", "size", "m", "whole", "extra")], "source_size", "target"
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken. Of rows equal in id, text and source, those
    come first whose other columns have the lesser hash."""
    taken = copies(docs, weights, most).where("whole + extra > 0").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("source").alias("_s"), F.col("m").alias("_m"), F.col("whole").alias("_whole"), F.col("extra").alias("_extra"))
    rows = docs.select(F.struct("*").alias("_row"))  # packed, so that no column's name can clash
    rows = rows.withColumn("_hash", F.xxhash64("_row.text"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")) & F.col("_row.source").eqNullSafe(F.col("_s"))
    found = rows.join(taken, same)
    # rows that are equal throughout are counted, so a unit has a row here for each of its different rows only
    several = found.where("_m > 1 AND _extra > 0").withColumn("_all", F.xxhash64(F.to_json("_row")))
    several = several.groupBy("_id", "_h", "_s", "_whole", "_extra", "_all").agg(F.first("_row").alias("_row"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_id", "_h", "_s").orderBy("_all").rowsBetween(W.unboundedPreceding, -1))
    more = F.greatest(F.lit(0), F.least("_n", F.col("_extra") - F.coalesce(before, F.lit(0))))
    several = several.select("_row", (F.col("_whole") * F.col("_n") + more).alias("_copies"))
    alone = found.where("_m = 1 OR _extra = 0").select("_row", (F.col("_whole") + F.col("_extra")).alias("_copies"))
    repeated = alone.unionByName(several).where("_copies > 0")
    return repeated.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


def op2_pivotal_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the words that the mix takes of it; see the module's text for nulls and ties."""
    each = copies(table(spark, sf_dir, "documents")).withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    each = each.withColumn("copies", F.col("whole") + (F.col("_nth") <= F.col("extra")).cast("long"))
    return each.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
