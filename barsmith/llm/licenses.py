"""License scan with a positional index of rare tokens.

Templates of license notices are indexed word by word: a posting is (template, position). How rare a license word is, is
counted over all documents (IDF), and only the rarest positions of each template are in the index. A file's words are looked
up there; postings of a template whose places in the file agree on where it would start, as far as the allowed gaps let
them, make a candidate. A candidate counts if its mandatory key phrases stand in the same stretch and enough of the
template's words do in the template's order.

The index loses nothing: a stretch that covers COVER of a template of n words lacks (1 - COVER) n positions at most, and so
holds AGREE of the (1 - COVER) n + AGREE rarest, each no further from its place than words can be missing or put in.
Phrases that name a license outright are found at every place besides.

Null and empty texts have no words and no labels; repeated rows each get their result; very long texts are read whole;
positions of equal IDF are taken in the template's order; an empty table gives no rows; extra columns play no part. Model and index are bounded by the templates.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, plain_words, raw, table

# Phrases that name a license, with its label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices of common licenses (label, words of the notice, key phrases that must occur).
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("hereby granted free of charge", "without restriction")),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software foundation",)),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("bsd", "licensed under the bsd 3 clause license", ("bsd 3 clause",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("apache", "licensed to the apache software foundation asf under one or more contributor license agreements", ("contributor license agreements",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission notice shall be included", "substantial portions of the software")),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived", "specific prior written permission")),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ("eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty", "will the authors be held liable")),
    ("bsl", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("artistic", "you may distribute this package under the terms of the artistic license 2 0", ("artistic license",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("commons attribution sharealike",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("commons attribution noncommercial",)),
    ("cc-by", "licensed under creative commons attribution 4 0", ("creative commons attribution 4",)),
    ("mpl", "mozilla public license version 2 0", ("mozilla public license",)),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ("without warranty of any kind express or implied", "fitness for a particular purpose and noninfringement")),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("required by applicable law or agreed to in writing",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program", ("affero general public license",)),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", ("gnu general public license along with",)),
    ("mit", "spdx license identifier mit", ("license identifier mit",)),
    ("apache", "spdx license identifier apache 2 0", ("license identifier apache",)),
    ("bsd", "spdx license identifier bsd 3 clause", ("license identifier bsd",)),
    ("bsd", "spdx license identifier bsd 2 clause", ("license identifier bsd",)),
    ("gpl", "spdx license identifier gpl 2 0", ("license identifier gpl",)),
    ("gpl", "spdx license identifier gpl 3 0", ("license identifier gpl",)),
    ("lgpl", "spdx license identifier lgpl 2 1", ("license identifier lgpl",)),
    ("lgpl", "spdx license identifier lgpl 3 0", ("license identifier lgpl",)),
    ("agpl", "spdx license identifier agpl 3 0", ("license identifier agpl",)),
    ("mpl", "spdx license identifier mpl 2 0", ("license identifier mpl",)),
    ("isc", "spdx license identifier isc", ("license identifier isc",)),
    ("epl", "spdx license identifier epl 2 0", ("license identifier epl",)),
    ("cc0", "spdx license identifier cc0 1 0", ("license identifier cc0",)),
    ("unlicense", "spdx license identifier unlicense", ("license identifier unlicense",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", ("waived all copyright",)),
)

#: Rare words that must agree on a start; words that a stretch begins before it (and ends twice as many behind it).
AGREE, SLACK = 2, 2
#: Least share of a template's words found in order of place.
COVER = 0.6


class Index:
    def __init__(self, templates=TEMPLATES):
        self.labels = [t[0] for t in templates]
        self.words = [t[1].encode().split() for t in templates]
        self.keys = [[k.encode() for k in t[2]] for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            for i, w in enumerate(words):
                self.postings[w].append((t, i))
        self.places: list[dict[bytes, list[int]]] = [defaultdict(list) for _ in templates]  # postings by template
        for w, found in self.postings.items():
            for t, i in found:
                self.places[t][w].append(i)
        self.weigh(0, {})

    def weigh(self, n_docs: int, found: dict[bytes, int]) -> None:
        """Sets how rare each word is, from the number of documents that hold it, and with it what is looked up: postings of
        the rarest positions of each template."""
        self.idf = {w: math.log((n_docs + 1) / (found.get(w, 0) + 1)) for w in self.postings}
        self.gaps = [int((1 - COVER) * len(words) + 1e-9) for words in self.words]
        self.rare: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            for i in sorted(range(len(words)), key=lambda i: (-self.idf[words[i]], i))[: self.gaps[t] + AGREE]:
                self.rare[words[i]].append((t, i))

    def candidates(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(template, start) that enough of the file's rare words agree on, of those whose stretch can hold the key phrases."""
        starts: dict[int, list[int]] = defaultdict(list)  # by template: where it would start, for each rare word
        if self.rare.keys().isdisjoint(words):
            return
        for i, w in enumerate(words):
            if w in self.rare:
                for t, at in self.rare[w]:
                    starts[t].append(i - at)
        standing: dict[bytes, list[int]] = {}
        for t, votes in starts.items():
            n, wanted = len(self.words[t]), min(AGREE, len(self.words[t]))
            if len(votes) < wanted:
                continue
            for k in self.keys[t]:
                if k not in standing:
                    standing[k] = places_of(k.split(), words)
            votes.sort()
            key = min(self.keys[t], key=lambda k: len(standing[k]), default=b"")
            first = len(key.split()) - n - 2 * SLACK
            near = {s for p in standing[key] for s in range(p + first, p + SLACK + 1)} if key else {s for v in votes for s in range(v - self.gaps[t] - 2 * SLACK, v + self.gaps[t] + SLACK + 1)}
            for s in sorted(near):
                low = bisect_left(votes, s - SLACK - self.gaps[t])
                if bisect_right(votes, s + 2 * SLACK + self.gaps[t]) - low >= wanted:
                    yield t, s

    def cover(self, stretch: tuple[bytes, ...], t: int) -> float:
        """Share of the template's words that stand in the stretch in the template's order, 0 where a key phrase is missing."""
        line = b" " + b" ".join(stretch) + b" "
        if any(b" " + k + b" " not in line for k in self.keys[t]):
            return 0.0
        ends: list[int] = []  # ends[k]: the earliest place in the template at which k + 1 words in order can end
        for w in stretch:
            for i in reversed(self.places[t].get(w, ())):
                at = bisect_left(ends, i)
                ends[at : at + 1] = [i]
        return len(ends) / len(self.words[t])

    def scan(self, words: list[bytes]) -> tuple[set[str], float]:
        """Labels of the templates found, and the best cover of any candidate. Equal stretches are looked at once."""
        labels, best = set(), 0.0
        seen: dict[tuple[int, tuple[bytes, ...]], float] = {}
        for t, start in self.candidates(words):
            stretch = tuple(words[max(0, start - SLACK) : max(0, start + len(self.words[t]) + 2 * SLACK)])
            c = seen.get((t, stretch))
            if c is None:
                c = seen[t, stretch] = self.cover(stretch, t)
            best = max(best, c)
            if c >= COVER:
                labels.add(self.labels[t])
        return labels, best


def places_of(phrase: list[bytes], words: list[bytes]) -> list[int]:
    """Where a phrase stands, by its first word."""
    found, i = [], -1
    while True:
        try:
            i = words.index(phrase[-1], i + 1)
        except ValueError:
            return found
        if i + 1 >= len(phrase) and words[i + 1 - len(phrase) : i + 1] == phrase:
            found.append(i + 1 - len(phrase))


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase stands."""
    return [(i, label) for phrase, label in PHRASES.items() for i in places_of(phrase.encode().split(), words)]


def word_counts(docs: DataFrame, index: Index) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and how many hold each license word; what is gathered is bounded by the templates."""
    vocabulary = frozenset(index.postings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch["_text"]:
                found[b""] += 1
                found.update(vocabulary.intersection(plain_words(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["w", "n"])

    rows = docs.select(raw(F.col("text")).alias("_text")).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["w"]): r["n"] for r in rows}
    return found.pop(b"", 0), found


def licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    index = Index(templates)
    index.weigh(*word_counts(docs, index))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = []
            for text in batch["_text"]:
                words = plain_words(text.as_py())
                places = phrase_places(words)
                base = {label for _, label in places}
                labels, cover = own.scan(words)
                starts = [i for i, _ in places]
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else min(1.0, cover)))
            found = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(x, t) for x, t in zip(found, types, strict=True)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    narrow = docs.select("doc_id", raw(F.col("text")).alias("_text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op5_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its license phrases and labels; see the module's text for nulls and ties."""
    return licenses(table(spark, sf_dir, "documents"))
