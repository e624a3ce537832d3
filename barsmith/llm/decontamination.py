"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. A document's words are streamed through it; after each word the
automaton knows the longest run, ending there, that occurs in an item. A run of WINDOW words (or a whole item that is
shorter) marks its words as hit. Items are dealt into blocks of bounded size by hash; a task for each block builds its
automaton and leaves it as sorted arrays in the shared folder, which every worker maps. Documents pass through the blocks
in turn within one operator, so neither the plan nor a worker's own memory grows with the number of blocks, and documents
are never shuffled. For each state it is known beforehand which windows and short items end there, so a text takes time
in proportion to its words, however repetitive it is. Words are compared by 64-bit hashes.

Null and empty texts have no words and no hits; repeated rows each get their result; very long texts are read whole;
items that share a window are all named. Items with a null id hit words like others but are in no list and no count. No
items, or items without words, hit nothing; an empty table gives no rows; extra columns are carried along by
:func:`clean_documents`.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, plain_words, raw, released, table
from .mapped import arrays, packed, shipped

WINDOW = 10
#: Bytes of item text in one automaton, on average (an item alone may have more).
BLOCK_BYTES = 2_000_000


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


class Builder:
    """Makes the automaton of several items, given as lists of word numbers. State 0 is the empty run; ``to[s]`` maps
    the next word to a state."""

    def __init__(self, items: list[list[int]]):
        self.to: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words in items:
            at = 0
            for w in words:
                at = self._extend(at, w)

    def _new(self, length: int, to: dict[int, int], link: int) -> int:
        self.to.append(to)
        self.length.append(length)
        self.link.append(link)
        return len(self.to) - 1

    def _split(self, parent: int, word: int, child: int) -> int:
        """The state of exactly parent's longest run plus ``word``, split off ``child`` where that has longer ones."""
        if self.length[child] == self.length[parent] + 1:
            return child
        copy = self._new(self.length[parent] + 1, dict(self.to[child]), self.link[child])
        self.link[child] = copy
        while parent != -1 and self.to[parent].get(word) == child:
            self.to[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.to[last]:  # an earlier item has this run
            return self._split(last, word, self.to[last][word])
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p != -1 and word not in self.to[p]:
            self.to[p][word] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, word, self.to[p][word])
        return new

    def arrays(self, items: list[list[int]], window: int) -> dict[str, np.ndarray]:
        """Transitions by state, and what ends at each state: ``win``, its class of windows (-1: none), and ``short``,
        the first of a chain of short items, longest first; both with the items they stand for."""
        states = len(self.to)
        length, link = np.array(self.length), self.link
        order = np.argsort(length, kind="stable").tolist()
        up = [-1] * states  # the state of the last ``window`` words
        for s in order[1:]:
            up[s] = s if length[link[s]] < window <= length[s] else up[link[s]]
        ends: dict[int, set[int]] = {}
        whole: dict[tuple[int, int], set[int]] = {}  # (state, length) of short items
        for i, words in enumerate(items):
            s = 0
            for k, w in enumerate(words):
                s = self.to[s][w]
                if k + 1 >= window:
                    ends.setdefault(up[s], set()).add(i)
            if 0 < len(words) < window:
                whole.setdefault((s, len(words)), set()).add(i)
        classes = {s: c for c, s in enumerate(ends)}
        short, n_short, next_short, short_items = [-1] * states, [], [], []
        own: dict[int, list[int]] = {}
        for s, n in sorted(whole):
            own.setdefault(s, []).append(n)
        for s in order[1:]:
            at = short[link[s]]
            for n in own.get(s, ()):
                n_short.append(n)
                next_short.append(at)
                short_items.append(sorted(whole[s, n]))
                at = len(n_short) - 1
            short[s] = at
        first = np.cumsum([0, *map(len, self.to)])
        sorted_to = [sorted(t.items()) for t in self.to]
        flat = lambda lists: np.array([x for y in lists for x in y], dtype=np.int32)
        of_class = [sorted(ends[s]) for s in classes]
        return {
            "first": first.astype(np.int32), "word": np.array([w for t in sorted_to for w, _ in t], dtype=np.int32), "to": np.array([s for t in sorted_to for _, s in t], dtype=np.int32),
            "link": np.array(link, dtype=np.int32), "length": length.astype(np.int32), "win": np.array([classes[u] if u >= 0 else -1 for u in up], dtype=np.int32),
            "class_first": np.cumsum([0, *map(len, of_class)]).astype(np.int32), "class_items": flat(of_class),
            "short": np.array(short, dtype=np.int32), "short_n": np.array(n_short, dtype=np.int32), "short_next": np.array(next_short, dtype=np.int32),
            "short_first": np.cumsum([0, *map(len, short_items)]).astype(np.int32), "short_items": flat(short_items),
        }


def built(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> dict[str, np.ndarray]:
    """The arrays of the automaton of ``items`` (name, text), with the hashes of their words and their names."""
    words = [hashes(plain_words(text)) for _, text in items]
    vocabulary = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *words]))
    numbered = [np.searchsorted(vocabulary, w).tolist() for w in words]
    names = np.frombuffer(json.dumps([name for name, _ in items]).encode(), dtype=np.uint8)
    return {"vocabulary": vocabulary, "names": names, **Builder(numbered).arrays(numbered, window)}


class SuffixAutomaton:
    """Reads what :func:`built` has made."""

    def __init__(self, own: dict[str, np.ndarray], window: int = WINDOW):
        self.window, self.vocabulary, self.own = window, own["vocabulary"], own
        self.views = [memoryview(own[k]) for k in ("first", "word", "to", "link", "length", "win", "short", "short_n", "short_next")]

    def spans(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans [start, end) in order of their ends, those that touch joined, in a text given by the hashes of its
        words; and the names of items with a window in it."""
        if not len(words) or not len(self.vocabulary):
            return [], set()
        first, word, to, link, length, win, short, short_n, short_next = self.views
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        numbers = np.where(self.vocabulary[at] == words, at, -1).tolist()
        any_short, window = len(short_n) > 0, self.window
        windows: set[int] = set()
        shorts: set[int] = set()
        spans: list[list[int]] = []
        state = run = 0
        for i, w in enumerate(numbers):
            if w < 0:
                state = run = 0
                continue
            while True:
                if not state:  # the empty run is followed by every word, in order of its number
                    state, run = to[w], 1
                    break
                a, b = first[state], first[state + 1]
                if b - a > 1:
                    a = bisect_left(word, w, a, b)
                if a < b and word[a] == w:
                    state = to[a]
                    run += 1
                    break
                state = link[state]
                run = length[state]
            start = i + 1
            if run >= window:
                windows.add(win[state])
                start -= window
            if any_short:
                k = short[state]
                while k >= 0:
                    if short_n[k] <= run:
                        shorts.add(k)
                        start = min(start, i + 1 - short_n[k])
                    k = short_next[k]
            if start <= i:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return [(a, b) for a, b in spans], self._named(windows, "class") | self._named(shorts, "short")

    def _named(self, groups: set[int], kind: str) -> set[str]:
        if not groups:
            return set()
        names = json.loads(self.own["names"].tobytes())
        first, items = self.own[f"{kind}_first"], self.own[f"{kind}_items"]
        return {names[i] for g in groups for i in items[first[g] : first[g + 1]].tolist()} - {None}


def automata(items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Files with the automata of ``items`` (item_id, text); each block is built by a task."""
    narrow = items.select(F.col("item_id").cast("string").alias("name"), raw(F.col("text")).alias("text")).where("length(text) > 0").distinct()
    held = narrow.agg(F.sum(F.length("text"))).first()[0]
    if not held:
        return []

    def run(rows: pa.Table) -> pa.Table:
        own = built(sorted(zip(rows["name"].to_pylist(), rows["text"].to_pylist(), strict=True), key=lambda x: (x[0] is None, x)), window)
        return pa.table({"blob": pa.array([packed(own)], pa.binary())})

    blocks = narrow.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(-(-held // block_bytes))))
    return shipped(blocks.groupBy("block").applyInArrow(run, "blob binary"), "automata")


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("*",), window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """_row (the columns ``keep`` of ``docs``), _n (words), _hit (words hit), _spans (start and end in turn) and _items."""
    bounded_batches(docs.sparkSession)
    files = automata(items, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [SuffixAutomaton(own, window) for own in arrays(files)]
        for batch in released(batches):
            n, hit, all_spans, all_items = [], [], [], []
            for text in batch["_text"]:
                words = hashes(plain_words(text.as_py()))
                found = [b.spans(words) for b in blocks]
                spans = _joined([s for own, _ in found for s in own])
                n.append(len(words))
                hit.append(sum(b - a for a, b in spans))
                all_spans.append([x for s in spans for x in s])
                all_items.append(sorted(set().union(*[names for _, names in found])))
            out = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(all_spans, pa.list_(pa.int32())), pa.array(all_items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch["_row"], *out], names=["_row", "_n", "_hit", "_spans", "_items"])

    row = F.struct(*keep).alias("_row")  # packed, so that no column's name can clash
    narrow = docs.select(row, raw(docs["text"]).alias("_text"))
    none = [F.lit(0).cast(t).alias(c) for c, t in (("_n", "long"), ("_hit", "long"))] + [F.array().cast(t).alias(c) for c, t in (("_spans", "array<int>"), ("_items", "array<string>"))]
    return narrow.mapInArrow(run, narrow.select("_row", *none).schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (array), contaminated: one row for each row of ``docs``."""
    return scan(docs, items, ("doc_id",), window, block_bytes).select(
        "_row.doc_id", F.col("_n").alias("n_words"), F.col("_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.col("_items").alias("item_ids"), (F.col("_hit") > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[int]) -> str:
    """``text`` without the words of the spans and what stands between them; other characters stay as they are."""
    if not spans:
        return text
    import re

    places = [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010FFFF]+", text)]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_hit: int = 0, max_share: float = 0.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` without those that have more than ``max_hit`` hit words or more than ``max_share`` of their words
    hit; from those within both limits the hit spans are cut. With the limits at 0, every document with a hit goes."""
    hits = scan(docs, items, ("*",), window, block_bytes)
    kept = hits.where((F.col("_hit") <= max_hit) & (F.col("_hit") <= F.col("_n") * F.lit(max_share)))
    if max_hit and max_share:
        cut = F.pandas_udf(lambda t, s: t.combine(s, lambda x, y: x if x is None else cut_spans(x, list(y))), "string")
        text = F.when(F.col("_hit") > 0, cut("_row.text", "_spans")).otherwise(F.col("_row.text"))
        kept = kept.withColumn("_row", F.col("_row").withField("text", text))
    return kept.select("_row.*")


def op3_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its words hit by windows of ``benchmark``; see the module's text for nulls."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated")
