"""The stages on a small table, each against a plain version of what it alone should do."""

import re
from collections import Counter

import corpus_pipeline

from barsmith.llm import language_id

from .test_methods import brute_components

WORDS = re.compile(rb"[a-z0-9\x80-\xff]+")


def windows(text):
    w = WORDS.findall((text or "").encode().lower())
    n = min(10, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def leaks(text, items):
    w = WORDS.findall((text or "").encode().lower())
    return any(tuple(w[k : k + n]) in items for n in range(1, 11) for k in range(len(w) - n + 1))


def whole(rows):
    return Counter(map(tuple, rows))


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = set().union(*[windows(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    before, sizes = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, data).cache()
        assert after.columns[: len(docs.columns)] == docs.columns
        rows, kept = before.collect(), after.collect()
        if name == "language ID":
            found = language_id.with_language(docs, language_id.fit(docs), ("p", "s", "k", "n")).collect()
            certain = [r for r in found if r["p"] != "und" and r["s"] >= corpus_pipeline.LEAST_SCORE]
            assert not whole(kept) - whole(r[: len(docs.columns)] for r in certain)
            assert not whole(r[: len(docs.columns)] for r in certain if r["k"] >= 0.9) - whole(kept)
            clean = [r for r in rows if labels.get(r["doc_id"]) == 1 and (r["text"] or "").strip()]
            assert clean and not whole(clean) - whole(kept)
        elif name == "n-gram Jaccard join":
            component = brute_components([(r["doc_id"], r["text"]) for r in rows])
            assert len(component) == len(rows) > len(kept)
            assert whole(kept) == whole(r for r in rows if component[r["doc_id"]][1] == r["doc_id"])
        elif name == "benchmark decontamination":
            assert whole(kept) == whole(r for r in rows if not leaks(r["text"], items)) != whole(rows)
        elif name == "mixing sources":
            assert set(map(tuple, kept)) <= set(map(tuple, rows)) and max(whole(kept).values()) <= 3
            size = {tuple(r): len((r["text"] or "").encode().split()) for r in rows}
            total, taken = sum(size.values()), sum(size[tuple(r)] for r in kept)
            assert abs(total - taken) <= len({r["source"] for r in rows}) * max(size.values())
        else:
            assert whole(r[: len(docs.columns)] for r in kept) == whole(rows)
            for r in kept:
                sizes.setdefault(r["shard"], []).append((r["slot"], len((r["text"] or "").encode()) + 1))
            assert all(sorted(s for s, _ in x) == list(range(len(x))) for x in sizes.values())
            share, most = sum(b for x in sizes.values() for _, b in x) / 16, max(b for x in sizes.values() for _, b in x)
            assert all(abs(sum(b for _, b in x) - share) <= most for x in sizes.values())
        before = after


def test_run(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and {r["shard"] for r in rows} <= set(range(16))
