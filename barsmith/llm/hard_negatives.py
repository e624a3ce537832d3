"""Hard-negative mining by exact inner products in a residue number system.

Vectors of integers are multiplied in blocks, modulo several small primes, by float32 matrix products that are exact: the
primes are so small that no sum of products leaves the 24 bits of a float's mantissa. The residues of a score are put
together by Chinese remaindering to the exact signed integer. A first pass keeps the best rows of an anchor's own label
(its positives), a second one the best rows of other labels whose score lies in a window below each positive's.

Anchors are packed into blocks, rows too; a block of rows meets every block of anchors, and only the few best rows of
each pair leave the task. Blocks of anchors are broadcast in groups of at most ``ANCHOR_BYTES``; more anchors take more
passes over the rows, never a larger broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, stored, table

#: Columns multiplied at once: keeps the primes above 250 for vectors of any length.
SLICE = 1_024
#: Rows of a block, by number and by bytes.
BLOCK_ROWS, BLOCK_BYTES = 16_384, 8_000_000
#: Anchors of a block (about), and bytes of all anchors that are broadcast at once.
ANCHOR_ROWS, ANCHOR_BYTES = 512, 32_000_000

BLOCK = "n int, ids binary, labels binary, parts binary"
FOUND = "anchor_id long, other_id long, score long"


def primes(dims: int, bound: int) -> list[int]:
    """Primes whose product is over 2 * ``bound`` + 1 and modulo each of which the products of ``dims`` centred residues
    (a slice of them at most) add up to less than 2**24."""
    half = math.isqrt(2**24 // max(1, min(dims, SLICE)))
    found, product = [], 1
    for p in range(min(2 * half, 4_093) | 1, 2, -2):
        if (p - 1) // 2 <= half and all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            product *= p
            if product > 2 * bound + 1:
                return found
    raise ValueError("scores of this size need more primes than there are")


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of whole doubles between -(p - 1) / 2 and (p - 1) / 2, as float32."""
    r = np.fmod(x, p)
    half = (p - 1) // 2
    r = np.where(r > half, r - p, np.where(r < -half, r + p, r))
    return r.astype(np.float32)


def scores(a: list[np.ndarray], b: list[np.ndarray], ps: list[int]) -> np.ndarray:
    """Inner products (int64) of the rows of two matrices, given by their centred residues modulo each of ``ps``."""
    digits, value, weight = [], None, 1
    for x, y, p in zip(a, b, ps, strict=True):
        r = np.zeros((len(x), len(y)), np.int64)
        for k in range(0, x.shape[1], SLICE):
            r += (x[:, k : k + SLICE] @ y[:, k : k + SLICE].T).astype(np.int64)  # exact: below 2**24
        digits.append(r % p)
    for r, p in zip(digits, ps, strict=True):  # mixed radix: a digit for each prime
        if value is None:
            value = r
        else:
            value = value + weight * ((r - value) * pow(weight, -1, p) % p)
        weight *= p
    return np.where(value > weight // 2, value - weight, value)


def taking_part(rows: DataFrame, key: str, vector: str, label: str | Column, scale: int) -> DataFrame:
    """(id, label, parts): rows with an id, a label and a vector of finite numbers, in whole steps of 1 / ``scale``. Of
    rows with one id the least in label and vector counts."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    label = F.col(label) if isinstance(label, str) else label
    good = rows.where(x.isNotNull() & fine).select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(x, lambda v: F.expr("1D") * F.floor(v.cast("double") * scale)).alias("parts"),
    )
    good = good.where("id IS NOT NULL AND label IS NOT NULL")
    return good.groupBy("id").agg(F.min(F.struct("label", "parts")).alias("r")).select("id", "r.label", "r.parts")


def packed(rows: pa.Table, dims: int) -> pa.Table:
    """One row: ids, labels and parts (int64, int64, float64) of a block in order of id; short vectors end in zeros."""
    rows = rows.sort_by("id").combine_chunks()
    lists = rows["parts"].combine_chunks()
    lengths = np.asarray(pc.list_value_length(lists).fill_null(0))
    parts = np.zeros((len(rows), dims))
    if len(rows):
        flat = lists.flatten().to_numpy()
        at = np.repeat(np.arange(len(rows)), lengths)
        parts[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return pa.table({
        "n": pa.array([len(rows)], pa.int32()), "ids": [rows["id"].to_numpy().astype(np.int64).tobytes()],
        "labels": [rows["label"].to_numpy().astype(np.int64).tobytes()], "parts": [parts.tobytes()],
    })


def _residues(parts: bytes, n: int, ps: list[int]) -> list[np.ndarray]:
    x = np.frombuffer(parts).reshape(n, -1)
    return [centred(x, p) for p in ps]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k] for c in batch.schema.names}


def _longs(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_py(), np.int64)


def _best_rows(ps: list[int], most: int):
    """Task: for each anchor the best ``most`` other rows of its label in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _pairs(batches):
            a_ids, a_labels, ids, labels = (_longs(pair[c]) for c in ("a_ids", "a_labels", "ids", "labels"))
            if not len(ids) or not len(a_ids):
                continue
            a, b = (_residues(pair[c].as_py(), n, ps) for c, n in (("a_parts", len(a_ids)), ("parts", len(ids))))
            out: list[tuple[np.ndarray, ...]] = []
            for label in np.intersect1d(a_labels, labels):  # only rows of the label are multiplied
                own, mine = np.flatnonzero(labels == label), np.flatnonzero(a_labels == label)
                y = [r[own] for r in b]
                for part in np.array_split(mine, -(-len(mine) // 128)):
                    for i, s in zip(part, scores([r[part] for r in a], y, ps), strict=True):
                        other = np.flatnonzero(ids[own] != a_ids[i])
                        top = other[np.argsort(-s[other], kind="stable")[:most]]
                        out.append((np.full(len(top), a_ids[i]), ids[own][top], s[top]))
            yield _found(out)

    return run


def _windowed_rows(ps: list[int], most: int, low: int, high: int):
    """Task: for each anchor and positive the best ``most`` rows of other labels within the positive's window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _pairs(batches):
            a_ids, a_labels, ids, labels = (_longs(pair[c]) for c in ("a_ids", "a_labels", "ids", "labels"))
            if not len(ids) or not len(a_ids):
                continue
            a, b = (_residues(pair[c].as_py(), n, ps) for c, n in (("a_parts", len(a_ids)), ("parts", len(ids))))
            positives: list[list[tuple[int, int]]] = [[] for _ in a_ids]
            for i, p, score in _longs(pair["a_positives"]).reshape(-1, 3).tolist():
                positives[i].append((p, score))
            out: list[tuple[np.ndarray, ...]] = []
            for start in range(0, len(a_ids), 128):
                for i, s in enumerate(scores([r[start : start + 128] for r in a], b, ps), start):
                    bounds = [(p, score, -(-low * score // 100), high * score // 100) for p, score in positives[i]]
                    bounds = [x for x in bounds if x[2] <= x[3]]
                    if not bounds:
                        continue
                    there = np.flatnonzero((labels != a_labels[i]) & (s >= min(x[2] for x in bounds)) & (s <= max(x[3] for x in bounds)))
                    there = there[np.argsort(-s[there], kind="stable")]  # the best first, ties by id
                    falling = -s[there]
                    for p, score, least, top in bounds:
                        first = np.searchsorted(falling, -top)
                        rows = there[first : min(first + most, np.searchsorted(falling, -least, "right"))]
                        out.append((np.full(len(rows), a_ids[i]), ids[rows], s[rows], np.full(len(rows), p), np.full(len(rows), score)))
            yield _found(out, ("positive_id", "positive_score"))

    return run


def _found(parts: list[tuple[np.ndarray, ...]], more: tuple[str, ...] = ()) -> pa.RecordBatch:
    names = ("anchor_id", "other_id", "score", *more)
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)


def _met(blocks: DataFrame, anchors: DataFrame, n_blocks: int, at_once: int, task, schema: str) -> DataFrame:
    """What ``task`` finds in each block of rows with each block of anchors; ``at_once`` blocks of anchors are broadcast."""
    wide = anchors.select("block", *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c not in ("block", "n")])
    out = None
    for low in range(0, n_blocks, at_once):
        high = min(n_blocks, low + at_once)
        few = wide.where(F.col("block").between(low, high - 1))
        rows = blocks.withColumn("block", F.explode(F.sequence(F.lit(low), F.lit(high - 1)))).join(F.broadcast(few), "block")
        found = rows.drop("block", "n").mapInArrow(task, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _top(rows: DataFrame, by: tuple[str, ...], most: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), "other_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", anchor_every: int = 100,
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (id divisible by
    ``anchor_every``) its best ``positives`` other rows of the same label, and for each of them the best ``negatives`` rows of
    other labels whose score is from ``low`` to ``high`` percent of the positive's. A score is the inner product of the vectors
    in whole steps of 1 / ``scale``; ties go by smaller id.

    Rows without id, label or vector, or with a missing or non-finite component, take no part; of rows with one id the least in
    label and vector does. Shorter vectors count as ended by zeros, vectors without components have score 0. A positive with
    a score below 0 has no window. Empty tables give no rows, other columns are not looked at. Vectors so long that a score
    might not fit into 62 bits are refused with an error."""
    spark = rows.sparkSession
    bounded_batches(spark)
    good = stored(taking_part(rows, key, vector, label, scale), "vectors")
    squares = F.aggregate("parts", F.lit(0.0), lambda s, v: s + v * v)
    anchor = F.col("id") % anchor_every == 0
    n, n_anchors, dims, bound = good.agg(F.count("*"), F.count_if(anchor), F.max(F.size("parts")), F.max(squares)).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n_anchors:
        return empty
    if bound * max(low, high, 100) >= 2**62:
        raise ValueError("vectors are too long for scores in 62 bits")
    dims, ps = max(1, dims), primes(max(1, dims), int(bound * (1 + 1e-9)) + 1)  # no product is over the largest square
    tasks = 4 * spark.sparkContext.defaultParallelism
    in_block = max(256, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dims), -(-n // tasks)))
    n_blocks = -(-n_anchors // ANCHOR_ROWS)
    at_once = max(1, ANCHOR_BYTES // (ANCHOR_ROWS * (8 * dims + 256)))

    def pack(t: pa.Table) -> pa.Table:
        return packed(t, dims)

    def pack_anchors(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        lists = t["positives"].combine_chunks()
        best, owner = lists.flatten(), pc.list_parent_indices(lists)
        triples = np.stack([np.asarray(x).astype(np.int64) for x in (owner, best.field("other_id"), best.field("score"))], axis=1)
        return packed(t, dims).append_column("block", t["block"].slice(0, 1)).append_column("positives", [pa.array([triples.tobytes()])])

    of = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    blocks = good.withColumn("block", of(-(-n // in_block))).groupBy("block").applyInArrow(pack, BLOCK)
    blocks = stored(blocks, "vector-blocks")
    picked = good.where(anchor).withColumn("block", of(n_blocks))
    kind = "array<struct<other_id:long,score:long>>"
    schema = f"{BLOCK}, block int, positives binary"
    plain = picked.withColumn("positives", F.expr(f"CAST(array() AS {kind})"))
    plain = plain.groupBy("block").applyInArrow(pack_anchors, schema).drop("positives")
    best = _top(_met(blocks, plain, n_blocks, at_once, _best_rows(ps, positives), FOUND), ("anchor_id",), positives)
    best = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("other_id", "score")).alias("positives"))  # a few for each anchor
    windows = stored(picked.join(best, "id").groupBy("block").applyInArrow(pack_anchors, schema), "windows")
    found = _met(blocks, windows, n_blocks, at_once, _windowed_rows(ps, negatives, low, high), f"{FOUND}, positive_id long, positive_score long")
    found = _top(found, ("anchor_id", "positive_id"), negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_residue_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives below each of five positives, for every hundredth vector; labels of every seventh id are moved on
    by one first, as noise. Edge cases: see :func:`hard_negatives`."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=moved)
