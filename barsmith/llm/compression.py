"""Quality classifier by compression: Zstandard dictionaries are built from good and from bad labelled texts; a text
that the good dictionary helps more is more likely good. The normalised difference of the two compressed sizes, with
the two ratios and the log length, goes through a logistic calibration.

Learned on a bounded sample of labelled rows (PER_CLASS for each label, the least by a hash, of texts up to MAX_BYTES): one half builds the dictionaries, the other calibrates. Every whole text is scored.

Null and empty texts count as a text of no bytes and get the score that the calibration gives it; labels that
contradict each other for one id aren't learned from, nor are null labels; with one label only every score is that
label, with none it is 0.5; repeated rows are learned from once and each get their score; equal scores mean equal
features; very long texts are scored whole; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, least_rows, raw, stored, table

PER_CLASS, MAX_BYTES = 1_600, 50_000
DICTIONARY_BYTES, LEVEL = 65_536, 3
RIDGE, STEPS = 1e-2, 50
GOOD_FROM = 0.7


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the labels that may be learned from."""
    known = labels.where(labels["quality"].isin(0, 1) & labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"]))
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").drop("_most")


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, quality, part, text): rows to learn from; part 0 builds dictionaries, part 1 calibrates."""
    fits = (F.octet_length("text") <= MAX_BYTES) & docs["doc_id"].isNotNull() & ~held_out(docs["doc_id"])
    texts = docs.where(fits).select("doc_id", "text")
    # drawn from hashes, so that the texts themselves are never shuffled to meet their labels
    keys = texts.select("doc_id", F.xxhash64("text").alias("text")).join(labelled(labels), "doc_id")
    few = least_rows(stored(keys, "labelled-keys"), "quality", per_class, 6)
    few = stored(few.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), "quality", (F.col("_rank") % 2).alias("part")), "sample-keys")
    found = texts.join(F.broadcast(few), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_text")))  # 2 * per_class keys at most
    return found.groupBy("doc_id", "quality", "part", "_text").agg(F.first(raw(F.col("text"))).alias("text")).drop("_text")


def build_dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


class Model:
    def __init__(self, good: bytes, bad: bytes):
        self.dictionaries = good, bad
        self.mean, self.scale, self.weights = np.zeros(4), np.ones(4), np.zeros(5)

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        return [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
            for d in self.dictionaries
        ]

    @staticmethod
    def features(text: bytes, compressors: list[zstandard.ZstdCompressor]) -> tuple[float, float, float, float]:
        good, bad = (len(c.compress(text)) for c in compressors)
        n = max(1, len(text))
        return (bad - good) / (bad + good), good / n, bad / n, float(np.log(n))

    def calibrate(self, texts: list[bytes], good: np.ndarray, odds: float) -> None:
        """Logistic regression by Newton steps with a small ridge; odds: of good texts among all labelled ones."""
        c = self.compressors()
        x = np.array([self.features(t, c) for t in texts])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        w = np.zeros(5)
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = x.T @ (x * (p * (1 - p))[:, None]) + RIDGE * np.eye(5)
            step = np.linalg.solve(h, x.T @ (good - p) - RIDGE * w)
            w += step / max(1.0, np.abs(step).max())
        w[0] += np.log(odds * (1 - good.mean()) / good.mean())
        self.weights = w

    def score(self, text: bytes, compressors: list[zstandard.ZstdCompressor]) -> float:
        x = (np.array(self.features(text, compressors)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | float:
    """A model, or a constant score where there are no two classes to learn from."""
    rows = sorted(sample(docs, labels, per_class).collect())  # at most 2 * per_class texts of MAX_BYTES
    by = {(q, part): [bytes(r["text"]) for r in rows if (r["quality"], r["part"]) == (q, part)] for q in (0, 1) for part in (0, 1)}
    if not all(by.values()):
        seen = {r["quality"] for r in rows}
        return float(seen.pop()) if len(seen) == 1 else 0.5
    model = Model(build_dictionary(by[1, 0]), build_dictionary(by[0, 0]))
    number = dict(labelled(labels).groupBy("quality").count().collect())
    good = np.repeat([1.0, 0.0], [len(by[1, 1]), len(by[0, 1])])
    model.calibrate(by[1, 1] + by[0, 1], good, number[1] / number[0])
    return model


def with_quality(docs: DataFrame, model: Model | float) -> DataFrame:
    """``docs`` with score (0 to 1; a column of that name is replaced)."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("score")
    if isinstance(model, float):
        return docs.withColumn("score", F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        compressors = own.compressors()
        for texts in batches:
            yield pd.Series([own.score(bytes(t), compressors) for t in texts], dtype="float64")

    return docs.withColumn("score", score(raw(F.col("text"))))


def op6_zstd_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its quality score; see the module's text for nulls, ties and labels."""
    docs = table(spark, sf_dir, "documents")
    found = with_quality(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))
