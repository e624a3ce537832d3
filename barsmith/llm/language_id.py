"""Language identification, words first: known words score by their log frequency in each language, unseen words by
character n-grams, from the longest down to the first length at which the word has known ones.

Fitted on a bounded sample of labelled rows (PER_LANGUAGE for each language, the least by a hash, of texts up to
MAX_BYTES). Spark counts words, then the n-grams of distinct words; tasks write the log frequencies as arrays sorted by a
64-bit hash, which workers map from files. The driver gets a few rows of totals and the names of the files. The words of
a batch of documents are looked up once each. A document's evidence is the sum over its words; its score is the share of
the winner when the mean evidence of a word is raised to the number of words.

The sample also tells which share of a language's words is known. A text in which far fewer are known than chance allows
is in no learned language: letter junk, or a language never seen. :func:`in_known_language` leaves it out; the prediction
alone doesn't, as it always names the likeliest language.

A null text, or one without a letter, is ``und`` with score 0; so is everything when there is nothing to learn from.
Ties go to the language that sorts first. Null labels aren't learned from; null ids are never held out; repeated rows are
learned from once and each get their result; very long texts are read whole, though not learned from; an empty table
gives no rows; extra columns are carried along by :func:`with_language`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, least_rows, released, stored, table
from .mapped import arrays, packed, shipped

#: Rows of each language that are learned from.
PER_LANGUAGE, MAX_BYTES = 1_500, 100_000
LONGEST = 5
#: A word or n-gram counts as known from so many occurrences in the sample on.
KNOWN = 2
#: Occurrences that every language has of everything known.
SMOOTH = 0.1
#: A text is in no known language where fewer than this share of a language's usual share of words is known, and fewer than so
#: many deviations of chance allow.
LEAST_KNOWN, DEVIATIONS = 0.5, 12.0

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    word = f" {word} "
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text) of the rows to learn from."""
    rows = docs.where(docs["lang"].isNotNull() & (F.octet_length(docs["text"]) <= MAX_BYTES) & ~held_out(docs["doc_id"]))
    return least_rows(rows, "lang", per_language, 8).select("lang", "text")


def counts(rows: DataFrame) -> DataFrame:
    """(lang, n, gram, count); n = 0 for whole words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter = Counter()
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                words.update((lang, w) for w in words_of(text.as_py()))
            langs, names = zip(*words, strict=True) if words else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(words.values(), pa.int64())], names=["lang", "gram", "count"])

    words = rows.mapInArrow(run, "lang string, gram string, count long").groupBy("lang", "gram").agg(F.sum("count").alias("count"))
    words = stored(words, "language-words")
    padded = F.concat(F.lit(" "), "gram", F.lit(" "))

    def of_length(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.struct(n.alias("n"), F.substring(padded, i, n).alias("gram")))

    lengths = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length(padded)))
    each = words.select("lang", F.explode(F.flatten(F.transform(lengths, of_length))).alias("_of"), "count")
    each = each.groupBy("lang", "_of.n", "_of.gram").agg(F.sum("count").alias("count"))
    return words.select("lang", F.lit(0).alias("n"), "gram", "count").unionAll(each.select("lang", "n", "gram", "count"))


class Model:
    """Log frequencies of words and n-grams in files that workers map; itself a few numbers and names.

    known: share of known words, by language; files: from :func:`mapped.shipped`, blobs of one length each, with the
    sorted hashes of words or n-grams and a row of the languages' log frequencies for each."""

    def __init__(self, known: dict[str, float], files: list[str]):
        self.languages = sorted(known)
        self.known = [known[x] for x in self.languages]
        self.files = files

    def opened(self) -> Lookup:
        """In a task."""
        return Lookup(self.languages, arrays(self.files))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[int]]:
        return self.opened().predict(texts)


class Lookup:
    """Scores texts with the mapped arrays of a model."""

    def __init__(self, languages: list[str], blobs: list[dict[str, np.ndarray]]):
        self.languages = languages
        self.slices: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in sorted(blobs, key=lambda b: int(b["key"][0])):
            self.slices.setdefault(int(b["n"][0]), []).append((b["key"], b["logs"].reshape(len(b["key"]), -1)))

    def find(self, n: int, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The row of each of ``names`` (zeros where unknown), and which are known."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, seed=42) for x in names), dtype=np.uint64, count=len(names)).view(np.int64)
        wanted, at = np.unique(hashes, return_inverse=True)
        value, known = np.zeros((len(wanted), len(self.languages))), np.zeros(len(wanted), dtype=bool)
        own = self.slices.get(n, [])
        cuts = [0, *np.searchsorted(wanted, [int(key[0]) for key, _ in own[1:]]).tolist(), len(wanted)]
        for (key, logs), a, b in zip(own, cuts[:-1], cuts[1:], strict=False):
            place = np.minimum(np.searchsorted(key, wanted[a:b]), len(key) - 1)
            known[a:b] = key[place] == wanted[a:b]
            value[a:b][known[a:b]] = logs[place[known[a:b]]]
        return value[at], known[at]

    def evidence(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its log frequency in each language, for an unseen one the mean of its known n-grams of the
        longest length that has any; and which words are known."""
        out, seen = self.find(0, words)
        left = np.flatnonzero(~seen)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            each = [grams(words[i], n) for i in left.tolist()]
            value, known = self.find(n, list(chain.from_iterable(each)))
            owner = np.repeat(np.arange(len(left)), [len(x) for x in each])[known]
            found = np.bincount(owner, minlength=len(left))
            sums = np.stack([np.bincount(owner, weights=v, minlength=len(left)) for v in value[known].T], axis=1)
            out[left[found > 0]] = sums[found > 0] / found[found > 0][:, None]
            left = left[found == 0]
        return out, seen

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[int]]:
        """lang_pred, score, share of known words and number of words of each text."""
        number: dict[str, int] = {}
        each = [[number.setdefault(w, len(number)) for w in words_of(t)] if t and self.languages else [] for t in texts]
        words = list(number)
        letters = np.array([any(c.isalpha() for c in w) for w in words], dtype=bool)  # words may be numbers such as superscripts
        evidence, seen = self.evidence(words)
        langs, scores, known, sizes = [], [], [], []
        for own in each:
            if not own or not letters[own].any():
                langs.append("und")
                scores.append(0.0)
                known.append(0.0)
            else:
                total = evidence[own].sum(axis=0)
                best = int(total.argmax())
                langs.append(self.languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
                known.append(float(seen[own].mean()))
            sizes.append(len(own))
        return langs, scores, known, sizes


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """From ``docs`` (doc_id, text, lang)."""
    bounded_batches(docs.sparkSession)
    rows = sample(docs.select("doc_id", "text", "lang"), per_language).repartition(32, "text")  # bounded
    every = stored(counts(rows), "language-counts")
    languages = sorted(r[0] for r in every.where("n = 0").select("lang").distinct().collect())
    if not languages:
        return Model({}, [])
    own = [f"_{i}" for i in range(len(languages))]
    each = [F.sum(F.when(F.col("lang") == lang, F.col("count")).otherwise(0)).alias(c) for c, lang in zip(own, languages, strict=True)]
    wide = stored(every.groupBy("n", "gram").agg(F.sum("count").alias("_all"), *each), "language-grams")
    known = F.col("_all") >= KNOWN
    sums = [F.sum(F.when(known, F.col(c)).otherwise(0)).alias(f"_known{c}") for c in own] + [F.sum(c).alias(c) for c in own]
    totals = {r["n"]: r for r in wide.groupBy("n").agg(F.sum(known.cast("long")).alias("_size"), *sums).collect()}  # a row for each length
    share = {lang: totals[0][f"_known{c}"] / totals[0][c] for c, lang in zip(own, languages, strict=True)}

    def log(c: str) -> Column:
        every = [SMOOTH * totals[n]["_size"] + totals[n][f"_known{c}"] + 1 for n in range(LONGEST + 1)]
        return F.log((F.col(c) + SMOOTH) / F.element_at(F.array(*map(F.lit, every)), F.col("n") + 1)).cast("float")

    rows = wide.where(known).select("n", F.xxhash64("gram").alias("key"), F.array(*map(log, own)).alias("logs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b["n"].to_numpy(), b["key"].to_numpy(), b["logs"].flatten().to_numpy().reshape(len(b), -1)) for b in batches if len(b)]
        if found:
            n, key, logs = (np.concatenate(x) for x in zip(*found, strict=True))
            for x in np.unique(n):
                blob = packed({"n": np.array([x], dtype=np.int64), "key": key[n == x], "logs": logs[n == x]})
                yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])

    slices = rows.repartitionByRange("n", "key").sortWithinPartitions("n", "key")
    return Model(share, shipped(slices.mapInArrow(run, "blob binary"), "language-model"))


def _predicted(model: Model, text: Column) -> Column:
    @F.pandas_udf("lang_pred string, score double, known double, words long")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = model.opened()
        for texts in released(batches):
            yield pd.DataFrame(dict(zip(("lang_pred", "score", "known", "words"), own.predict(texts.tolist()), strict=True)))

    return predict(text)


def with_language(docs: DataFrame, model: Model, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score under ``names`` (columns of these names are replaced); with four
    names, also the share of known words and the number of words."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("_row"))  # packed, so that no column's name can clash
    found = rows.withColumn("_found", _predicted(model, F.col("_row.text")))
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in names]
    return found.select(*kept, *[F.col("_found")[c].alias(n) for n, c in zip(names, ("lang_pred", "score", "known", "words"), strict=False)])


def in_known_language(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """Rows of ``docs`` with letters, a clear language, and as many known words as texts of that language have. Null and empty
    texts and those without letters go; with nothing learned all rows go; repeated rows are all judged alike; columns of
    any name stay as they are."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("_row"))  # packed, so that no column's name can clash
    found = rows.withColumn("_found", _predicted(model, F.col("_row.text")))
    usual = F.coalesce(F.element_at(F.map_from_arrays(F.array(*map(F.lit, model.languages)), F.array(*[F.lit(float(x)) for x in model.known])), F.col("_found.lang_pred")), F.lit(0.0)) if model.languages else F.lit(0.0)
    short = usual * F.lit(LEAST_KNOWN) - F.col("_found.known")
    chance = F.sqrt(usual * (1 - usual) / F.greatest(F.lit(1), F.col("_found.words")))
    strange = (short > 0) & (usual - F.col("_found.known") > chance * F.lit(DEVIATIONS))
    return found.where((F.col("_found.lang_pred") != "und") & (F.col("_found.score") >= least_score) & ~strange).select("_row.*")


def op8_word_first_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its predicted language; see the module's text for nulls and ties."""
    docs = table(spark, sf_dir, "documents")
    found = with_language(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
