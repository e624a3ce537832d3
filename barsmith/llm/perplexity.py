"""Quality rules with an n-gram perplexity: a modified Kneser-Ney model of five bytes, counted by Spark over all texts.

Every text is scored by the model, per byte and per word. In each language, documents whose perplexity lies outside a
band around the language's median are rejected; the band is as wide as chance allows at the document's length, and its
scale is the language's median deviation. Grams, medians and deviations cover all documents.

Five bytes are a short word with its borders or the end of one word and the start of the next: long enough to tell words
and their order from letter junk, and short enough that the table of the grams stays far smaller than the corpus, though
it grows with it without a bound. All orders, the highest too, use continuation counts: in how many different longer
grams a gram is the end. So a passage doesn't become likely by being copied, and copies are judged like other texts (with
occurrences counted at the highest order, many copies fall below the lower edge of the band).

Continuation counts, discounts, weights and interpolated probabilities are joined by Spark from exact codes; no two grams
share an entry. Each order is written as slices of sorted codes with their log probabilities, and each context with the
log weight of the order below; workers map the files, so the model takes no memory of their own and never passes through
the driver. Probabilities follow from counts alone and don't depend on partitions.

Null and empty texts have no words, fail the base rules and are not kept; a null language is a language of its own;
repeated rows change no probability and count in the medians as often as they occur; a very long text is scored whole; a perplexity on the edge of a band is
inside; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, raw, space_words, stored, table
from .mapped import arrays, packed, shipped

LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
#: Half the band, in deviations; the least deviation; the width of a bin of medians.
BAND, LEAST_DEVIATION, BIN = 4.0, 0.3, 0.001
#: Bytes of a gram; those that are counted have one more.
ORDER = 5
#: Before every text, so its first bytes have a context.
PAD = b"\n" * ORDER
#: Codes counted or scored at once in a task (a text alone may have more).
CHUNK = 2_000_000
#: All bytes that are not the first of a character outside ASCII white space.
NOT_WORD_CHARS = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])


def codes(text: bytes, n: int = ORDER) -> np.ndarray:
    """For every byte of a text, the number that it makes with the n - 1 before it."""
    a = np.frombuffer(PAD[: n - 1] + text, dtype=np.uint8)
    out = np.zeros(len(text), dtype=np.int64)
    for k in range(n):
        out = (out << 8) | a[k : k + len(text)]
    return out


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The texts of the column _text, in lists of about CHUNK bytes."""
    held: list[bytes] = []
    size = 0
    for batch in batches:
        for text in batch["_text"]:
            held.append(text.as_py())
            size += len(held[-1])
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def grams(docs: DataFrame) -> DataFrame:
    """(gram): the different codes of ORDER + 1 bytes of all texts. Each task drops its own repeats before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([codes(t, ORDER + 1) for t in texts])))], names=["gram"])

    return docs.select(raw(F.col("text")).alias("_text")).mapInArrow(run, "gram long").distinct()


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """By count (0, 1, 2, 3 or more), from the numbers of grams seen once to four times."""
    if not (n1 and n2 and n3):
        return [0.0, 0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [0.0, *(min(k - 0.1, max(0.05, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]


def fit(docs: DataFrame) -> list[str]:
    """The model of all texts of ``docs`` (text), as the names of its files; the driver gets a row for each order."""
    bounded_batches(docs.sparkSession)
    level, levels = grams(docs), {}
    for k in range(ORDER, 0, -1):
        level = level.groupBy(F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.count("*").alias("c"))
        levels[k] = level = stored(level, "grams") if k >= 4 else level
    seen = [F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    every = [levels[k].agg(*seen).select(F.lit(k).alias("k"), *[F.coalesce(f"n{i}", F.lit(0)) for i in (1, 2, 3, 4)]) for k in levels]
    d = {k: discounts(*n) for k, *n in _union(every).collect()}

    below, tables = None, []
    for k in range(1, ORDER + 1):
        cut = F.element_at(F.array(*[F.lit(x) for x in d[k][1:]]), F.least("c", F.lit(3)).cast("int"))
        own = levels[k].select("gram", (F.col("c") - cut).alias("left"), "c", cut.alias("cut"), F.shiftright("gram", 8).alias("h"))
        context = own.groupBy("h").agg(F.sum("c").alias("total"), *[F.sum((F.least("c", F.lit(3)) == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3)])
        context = context.select("h", "total", ((F.lit(d[k][1]) * F.col("n1") + F.lit(d[k][2]) * F.col("n2") + F.lit(d[k][3]) * F.col("n3")) / F.col("total")).alias("weight"))
        own = own.select("gram", "left", "h", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1).alias("suffix")).join(context, "h")
        own = own.join(below, "suffix") if k > 1 else own.withColumn("q", F.lit(1 / 256))
        own = stored(own.select("gram", (F.col("left") / F.col("total") + F.col("weight") * F.col("q")).alias("p")), "probabilities")
        below = own.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
        tables += [own.select(F.lit(2 * k).alias("kind"), F.col("gram").alias("key"), F.log("p").cast("float").alias("value"))]
        tables += [context.select(F.lit(2 * k + 1).alias("kind"), F.col("h").alias("key"), F.log("weight").cast("float").alias("value"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(b[c].to_numpy() for c in ("kind", "key", "value")) for b in batches if len(b)]
        if rows:
            kind, key, value = (np.concatenate(x) for x in zip(*rows, strict=True))
            for x in np.unique(kind):
                at = kind == x
                blob = packed({"kind": np.array([x], dtype=np.int64), "key": key[at], "value": value[at]})
                yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])

    slices = _union(tables).repartitionByRange("kind", "key").sortWithinPartitions("kind", "key")
    return shipped(slices.mapInArrow(run, "blob binary"), "model")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out


class Model:
    """Reads what :func:`fit` has written: for each order sorted slices of codes and of contexts."""

    def __init__(self, blobs: list[dict[str, np.ndarray]]):
        self.slices: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in sorted(blobs, key=lambda b: int(b["key"][0])):
            self.slices.setdefault(int(b["kind"][0]), []).append((b["key"], b["value"]))

    def find(self, kind: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of sorted keys (0 where unknown), and which are known."""
        value, known = np.zeros(len(wanted), dtype=np.float64), np.zeros(len(wanted), dtype=bool)
        own = self.slices.get(kind, [])
        cuts = [0, *np.searchsorted(wanted, [int(key[0]) for key, _ in own[1:]]).tolist(), len(wanted)]
        for (key, log), a, b in zip(own, cuts[:-1], cuts[1:], strict=False):
            at = np.minimum(np.searchsorted(key, wanted[a:b]), len(key) - 1)
            known[a:b] = key[at] == wanted[a:b]
            value[a:b] = np.where(known[a:b], log[at], 0.0)
        return value, known

    def log_p(self, code: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of the last byte of each of the sorted codes after those before it, backing off where unseen."""
        if not order:
            return np.full(len(code), -np.log(256))
        out, seen = self.find(2 * order, code)
        if not seen.all():
            miss = code[~seen]
            lower, at = np.unique(miss & ((1 << 8 * (order - 1)) - 1), return_inverse=True)
            out[~seen] = self.log_p(lower, order - 1)[at] + self.find(2 * order + 1, miss >> 8)[0]
        return out

    def sums(self, texts: list[bytes]) -> list[float]:
        """The log probability of each text. A sum depends on the text alone."""
        each = [codes(t) for t in texts]
        code, at = np.unique(np.concatenate(each), return_inverse=True)
        logs, out, done = self.log_p(code)[at], [], 0
        for c in each:
            out.append(float(logs[done : done + len(c)].sum()))
            done += len(c)
        return out


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words within windows that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    h = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    _, at, times = np.unique(h, return_inverse=True, return_counts=True)
    if len(times) == n:
        return 0
    step = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(times[at] > 1)
    step[starts] += 1
    step[starts + window] -= 1
    return int((np.cumsum(step) > 0).sum())


def base_features(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = space_words(text)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), len(text.translate(None, NOT_WORD_CHARS)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def scored(docs: DataFrame, model: list[str]) -> DataFrame:
    """doc_id, lang, the base features, n_bytes and log_p (of the whole text) for each row of ``docs``."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(arrays(model))
        for batch in batches:
            sums, rows = [], []
            for texts in chunks(iter([batch])):
                sums += own.sums(texts)
                rows += [(*base_features(t), len(t)) for t in texts]
            found = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], *[pa.array(x, pa.int64()) for x in found], pa.array(sums, pa.float64())], names=["doc_id", "lang", *FEATURES, "n_bytes", "log_p"])

    narrow = docs.select("doc_id", "lang", raw(F.col("text")).alias("_text"))
    types = {f.name: f.dataType.simpleString() for f in narrow.schema}
    return narrow.mapInArrow(run, f"doc_id {types['doc_id']}, lang {types['lang']}, {', '.join(f'{c} long' for c in FEATURES)}, n_bytes long, log_p double")


def medians(df: DataFrame, value: Column, name: str) -> DataFrame:
    """(lang, name): the median of ``value`` in each language to within a bin, from counts of bins."""
    bins = df.select("lang", F.floor(value / F.lit(BIN)).alias("_bin")).groupBy("lang", "_bin").agg(F.count("*").alias("_n"))
    w = W.partitionBy("lang")
    bins = bins.withColumn("_upto", F.sum("_n").over(w.orderBy("_bin"))).withColumn("_all", F.sum("_n").over(w))
    return bins.where("2 * _upto >= _all").groupBy("lang").agg(((F.min("_bin") + 0.5) * F.lit(BIN)).alias(name))


def judged(docs: DataFrame, model: list[str] | None = None, band: float = BAND) -> DataFrame:
    """doc_id, the base features, base_failed, kept, and the two perplexities with their distance from the median."""
    own = stored(scored(docs, model or fit(docs)), "scores")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    own = own.withColumn("base_failed", failed)
    inside = F.lit(True)
    for unit, n in (("byte", "n_bytes"), ("word", "n_words")):
        rate = F.col("log_p") / F.col(n)
        fits = own.where((F.col(n) > 0) & ~F.col("base_failed"))
        own = _same_language(own, medians(fits, rate, f"_{unit}"))
        away = F.abs(rate - F.col(f"_{unit}")) * F.sqrt(n)
        fits = own.where((F.col(n) > 0) & ~F.col("base_failed"))
        own = _same_language(own, medians(fits, away, f"_{unit}_dev"))
        own = own.withColumn(f"{unit}_ppl", F.when(F.col(n) > 0, F.exp(-rate)))
        own = own.withColumn(f"{unit}_away", F.when(F.col(n) > 0, away / F.greatest(F.lit(LEAST_DEVIATION), F.col(f"_{unit}_dev") * 1.4826)))
        inside = inside & (F.coalesce(f"{unit}_away", F.lit(0.0)) <= band)
    return own.select("doc_id", *FEATURES, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "byte_ppl", "word_ppl", "byte_away", "word_away")


def _same_language(df: DataFrame, values: DataFrame) -> DataFrame:
    """Left join with one row for each language."""
    values = values.withColumnRenamed("lang", "_lang")
    return df.join(F.broadcast(values), df["lang"].eqNullSafe(values["_lang"]), "left").drop("_lang")


def op4_kneser_ney_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its base features and verdict; see the module's text for nulls and ties."""
    return judged(table(spark, sf_dir, "documents"))
