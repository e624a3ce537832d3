"""Operators against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.llm import compression, decontamination, html_extraction, jaccard_join, language_id, licenses, mapped, mixing, perplexity, sharding, warc
from barsmith.llm.queries import QUERIES


def near_copies(n_groups=6, size=30, alone=60, seed=3):
    """Texts with groups of near copies, exact copies and passages shared by otherwise different texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 5)))
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(n_groups):
        base = [word() for _ in range(r.choice([30, 80, 200]))]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                t[r.randrange(len(t))] = word()
            out.append(t)
        out += [base] * 5
    for _ in range(alone):
        out.append(passage + [word() for _ in range(r.randint(5, 60))])
    out += [[], ["one"], ["one", "two"], ["one", "two"], ["a", "b", "c", "d", "e"], passage[:12], passage[:11]]
    r.shuffle(out)
    return [(i, " ".join(t).title()) for i, t in enumerate(out)]


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("frequent", "block"), [(8, 2000), (1, 7), (3, 10), (1000, 2000)])
def test_join_finds_all_links(spark, monkeypatch, frequent, block):
    rows = near_copies(seed=frequent)
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    got = jaccard_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_decontamination_equals_brute_force(spark):
    r = random.Random(1)
    text = lambda n: " ".join(r.choice("ab") + r.choice("ab") for _ in range(n))
    items = [(i, text(r.choice([3, 7, 9, 10, 11, 14, 25]))) for i in range(25)]
    docs = [(i, text(r.randint(0, 60)).upper() + ".") for i in range(200)]
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows: dict = {}
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = {}
    for i, t in docs:
        w, hit, names = low(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    names |= found
                    hit |= set(range(k, k + n))
        want[i] = (len(w), len(hit), sorted(names))
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (4_000_000, 100):
        found = decontamination.contamination(d, it, block_bytes=block)
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # for any number of blocks
        got = found.collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["item_ids"])) for r in got} == want
    clean = decontamination.clean_documents(d, it, max_hit=10**6, max_share=1.0)
    assert clean.count() == len(docs)
    assert decontamination.cut_spans("Ab, cd! ef gh.", [1, 3]) == "Ab,  gh."


def test_repetitive_texts_take_linear_time():
    import time

    own = decontamination.built([("a", b"x " * 4000), ("b", b"x y")])
    reader, took = decontamination.SuffixAutomaton(own), []
    for n in (20_000, 80_000):
        words = decontamination.hashes([b"x"] * n + [b"y"])
        began = time.process_time()
        spans, names = reader.spans(words)
        took.append(time.process_time() - began)
        assert spans == [(0, n + 1)] and names == {"a", "b"}
    assert took[1] < 8 * took[0] + 0.5


def test_mix_reaches_its_targets(spark, data):
    rows = QUERIES["op2_pivotal_rounding"](spark, data)
    rows = rows.join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "text"), "doc_id").cache()
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows.collect()}
    assert all(sizes[r["doc_id"]] == r["size"] and r["taken"] <= 3 * r["size"] for r in rows.collect())
    by = {r["source"]: r for r in rows.groupBy("source").agg(F.sum("size").alias("s"), F.first("source_size").alias("ss"), F.first("target").alias("t"), F.sum("taken").alias("n"), F.max("size").alias("most")).collect()}
    total, names = sum(r["s"] for r in by.values()), sorted(by)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_ = {s: 0.0 for s in names}, set(names)
    while open_:  # reshare what stands above a cap until nothing does
        rest = total - sum(3 * by[s]["s"] for s in names if s not in open_)
        target |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > 3 * by[s]["s"]}
        target |= {s: 3.0 * by[s]["s"] for s in over}
        open_ -= over
        if not over:
            break
    for s, r in by.items():
        assert r["ss"] == r["s"] and math.isclose(r["t"], target[s], rel_tol=1e-9)
        assert abs(r["n"] - r["t"]) <= r["most"]
    again = QUERIES["op2_pivotal_rounding"](spark, data)
    assert sorted(again.select("doc_id", "taken").collect()) == sorted(rows.select("doc_id", "taken").collect())


def test_dependent_rounding_is_fair(spark):
    """Over many seeds' worth of units, each chance is met in the mean and sums are kept."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w " * 7).alias("text"), (F.col("id") % 4).cast("string").alias("source"))
    taken = F.sum((F.col("whole") * F.col("m") + F.col("extra")) * F.col("size"))
    got = mixing.copies(docs).groupBy("source").agg(taken.alias("n"), F.first("target").alias("t")).collect()
    assert all(abs(r["n"] - r["t"]) <= 7 for r in got)


def test_repeated_rows_share_the_chance(spark):
    """A row that stands 3,000 times: its source is within one row of the target, in the operator and in the mix."""
    rows = [(0, "ten words of text " * 2 + "and two", "a")] * 3000 + [(i, f"w{i} x", "a") for i in range(1, 201)] + [(1000 + i, "some more words here", "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7).withColumn("copies", F.lit("x"))
    sums = mixing.copies(docs).groupBy("source").agg(F.sum((F.col("whole") * F.col("m") + F.col("extra")) * F.col("size")).alias("n"), F.first("target").alias("t")).collect()
    assert sums and all(abs(r["n"] - r["t"]) <= 10 for r in sums)
    mixed = mixing.mixed_documents(docs).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n"), F.max("copies").alias("c")).collect()
    assert {(r["source"], r["n"], r["c"]) for r in mixed} == {(r["source"], r["n"], "x") for r in sums}


def test_targets_of_many_sources(spark):
    """Filling up by weight, in ranges, equals sharing out again until nobody is above a cap."""
    r = random.Random(9)
    sizes = [(f"host-{i}", r.choice([0, 1, 5, 50, 5000]), 1) for i in range(500)] + [(None, 70, 1)]
    got = {x["source"]: x["target"] for x in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long, n long")).collect()}
    own, names = {s: c for s, c, _ in sizes}, [*sorted(s for s, *_ in sizes if s), None]
    weight, total, target, open_ = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(own.values()), {}, set(names)
    while True:
        rest, share = total - sum(3 * own[s] for s in names if s not in open_), sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / share > 3 * own[s]}
        if not over:
            break
        open_ -= over
    target = {s: rest * weight[s] / share if s in open_ else 3.0 * own[s] for s in names}
    assert got.keys() == target.keys() and all(math.isclose(got[s], target[s], rel_tol=1e-9, abs_tol=1e-9) for s in names)


def test_shards_are_even_and_gapless(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    many = docs.unionByName(docs.where("doc_id < 3").withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("_n"))
    rows = sharding.shard_assignment(many).collect()
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in range(16):
        own = [r for r in rows if r["shard"] == s]
        assert abs(sum(r["size"] for r in own) - total / 16) <= most
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    full = sharding.shard_records(many).groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in full} == Counter(r["shard"] for r in rows)


def test_crowded_ranges_are_subdivided(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    units = sharding._units(docs)
    plan = sharding.Plan(units)
    sums = units.groupBy(sharding._range_of(plan.cuts)).agg(F.sum(F.col(sharding.SIZE) * F.col(sharding.TIMES)).alias("b")).collect()
    assert max(r["b"] for r in sums) < 4 * plan.total / 256


def brute_kneser_ney(texts, order):
    """p(byte after context) of an interpolated modified Kneser-Ney model of continuation counts, from dictionaries."""
    longer = {(b"\n" * order + t)[i : i + order + 1] for t in texts for i in range(len(t))}
    counts = [Counter() for _ in range(order)] + [Counter(g[1:] for g in longer)]
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    cut = []
    for c in counts:
        n = Counter(c.values())
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            cut.append([0, *(min(k - 0.1, max(0.05, k - (k + 1) * y * n[k + 1] / n[k])) for k in (1, 2, 3))])
        else:
            cut.append([0, 0.5, 1.0, 1.5])
    of = [{} for _ in counts]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            of[k].setdefault(g[:-1], []).append(c)

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 256
        own = of[k].get(gram[:-1])
        if own is None:
            return p(gram[1:])
        c = counts[k].get(gram, 0)
        return (c - cut[k][min(c, 3)]) / sum(own) + sum(cut[k][min(x, 3)] for x in own) / sum(own) * p(gram[1:])

    return p


def model_of(docs):
    files = docs.sparkSession.sparkContext.parallelize([perplexity.fit(docs)], 1).map(mapped.arrays)
    return perplexity.Model([{k: np.array(v) for k, v in b.items()} for b in files.first()])


def test_kneser_ney_equals_brute_force(spark):
    r = random.Random(6)
    texts = ["".join(r.choice("abcd e\u00e9") for _ in range(r.randint(0, 200))) for _ in range(40)] + ["", None, "abra"]
    model = model_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    p = brute_kneser_ney([(t or "").encode() for t in texts], perplexity.ORDER)
    unseen = [bytes(r.choice(b"abcdezq \n") for _ in range(30)) for _ in range(10)]
    for t in [(t or "").encode() for t in texts] + unseen:
        padded = perplexity.PAD[1:] + t
        want = sum(math.log(p(padded[i : i + perplexity.ORDER])) for i in range(len(t)))
        assert math.isclose(model.sums([t])[0], want, rel_tol=1e-5, abs_tol=1e-5)
    for context in (b"abcd", b"zzzz", perplexity.PAD[1:]):
        every = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)])
        assert math.isclose(np.exp(model.log_p(every)).sum(), 1, rel_tol=1e-4)


def test_slices_of_a_large_model_stay_on_disk(tmp_path):
    """2^24 entries are mapped, not read: a worker's own memory hardly grows, and lookups are right across slices."""
    import subprocess
    import sys

    script = f"""
import numpy as np, sys
from barsmith.llm import mapped, perplexity
def own():  # memory of the process that no file backs, in MB
    return int(next(x for x in open('/proc/self/status') if x.startswith('RssAnon')).split()[1]) / 1024
before = own()
model = perplexity.Model([b for k in range(4) for b in mapped.unpacked(f'{tmp_path}/{{k}}')])
at = np.arange(0, 1 << 26, 999)
value, known = model.find(12, at)
assert (known == (at % 4 == 0)).all() and (value[known] == (at[known] // 4 % 1000)).all()
print(own() - before)
"""
    n = 1 << 22
    for k in range(4):
        key = np.arange(k * n, (k + 1) * n, dtype=np.int64)
        (tmp_path / str(k)).write_bytes(mapped.packed({"kind": np.array([12]), "key": key * 4, "value": (key % 1000).astype(np.float32)}) + b"\n")
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True)
    assert float(out.stdout) < 100


def test_base_features():
    text = "one two three four five six seven eight # one two three four five six seven eight\n\nx\nx \nx".encode()
    n, chars, symbols, dup, rep = perplexity.base_features(text)
    assert (n, symbols, dup, rep) == (20, 1, 1, 16)
    assert chars == sum(len(w) for w in text.decode().split())
    r = random.Random(2)
    for _ in range(50):
        words = [r.choice("ab") for _ in range(r.randint(0, 60))]
        seen: dict = {}
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        hit = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
        assert perplexity.base_features(" ".join(words).encode())[4] == len(hit)


def test_bands_keep_clean_texts_and_reject_junk(spark, data):
    large = data.replace("0.001", "0.1")
    got = QUERIES["op4_kneser_ney_bands"](spark, large).join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").where("NOT base_failed")
    share = {r["quality"]: r["kept"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.99 and share[0] < 0.2


def test_classifiers_on_held_out_rows(spark, data):
    large = data.replace("0.001", "0.1")
    got = QUERIES["op6_zstd_dictionaries"](spark, large).join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.96
    got = QUERIES["op8_word_first_backoff"](spark, large).join(spark.read.parquet(f"{large}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_sample_is_not_cut(spark):
    docs = spark.range(4400).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    assert {r["lang"]: r["count"] for r in language_id.sample(docs).groupBy("lang").count().collect()} == {"en": 1500, "de": 1500}


def test_unseen_words_back_off(spark):
    rows = [(i, "walking talking thinking", "en") for i in range(40)] + [(100 + i, "gehen sprechen denken", "de") for i in range(40)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    langs, scores, known, words = model.predict(["walking", "drinking", "lenken", "123", None, "walking drinking"])
    assert langs == ["en", "en", "de", "und", "und", "en"] and scores[3:5] == [0.0, 0.0]
    assert known == [1.0, 0.0, 0.0, 0.0, 0.0, 0.5] and words == [1, 1, 1, 0, 0, 2]


def counted_languages(rows):
    """Occurrences by length and language (n = 0: words), counted from (lang, text) one text at a time."""
    seen = {}
    for lang, text in rows:
        for w in language_id.words_of(text):
            seen.setdefault((0, w), Counter())[lang] += 1
            for n in range(1, language_id.LONGEST + 1):
                for g in language_id.grams(w, n):
                    seen.setdefault((n, g), Counter())[lang] += 1
    known = {k: v for k, v in seen.items() if sum(v.values()) >= language_id.KNOWN}
    total = {}
    for (n, _), v in known.items():
        for lang in {lang for lang, _ in rows}:
            total[n, lang] = total.get((n, lang), 1) + v[lang] + language_id.SMOOTH
    return known, total


def brute_language(known, total, languages, text):
    """One word at a time."""
    out = [0.0] * len(languages)
    for w in language_id.words_of(text):
        for n in [0, *range(language_id.LONGEST, 0, -1)]:
            own = [known[n, g] for g in ([w] if not n else language_id.grams(w, n)) if (n, g) in known]
            if own:
                for i, lang in enumerate(languages):
                    out[i] += sum(math.log((c[lang] + language_id.SMOOTH) / total[n, lang]) for c in own) / len(own)
                break
    return languages[max(range(len(out)), key=out.__getitem__)], 1 / sum(math.exp(x - max(out)) for x in out)


def test_language_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language_id.fit(docs)
    known, total = counted_languages([tuple(r) for r in language_id.sample(docs).collect()])
    rows = [r for r in language_id.with_language(docs, model).collect() if r["lang_pred"] != "und"]
    assert len(rows) > 100
    for r in rows:
        lang, score = brute_language(known, total, model.languages, r["text"])
        assert lang == r["lang_pred"] and math.isclose(score, r["score"], rel_tol=1e-3)


def test_texts_in_no_known_language_go(spark, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(3)
    junk = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(400)) for _ in range(50)]
    other = [" ".join(r.choice("sjohpj kreqt vuundp zytahr mixqoluk pelzzon takvuri weofjin".split()) + r.choice("qxzjk") for _ in range(60)) for _ in range(50)]
    more = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(junk + other)], "doc_id long, text string, lang string")
    kept = language_id.in_known_language(docs.unionByName(more), language_id.fit(docs), 0.5)
    assert kept.where("doc_id >= 1000000").count() == 0
    labels = spark.read.parquet(f"{data.replace('0.001', '0.1')}/labels.parquet").where("quality = 1")
    clean = docs.where(F.length("text") > 0).join(labels, "doc_id")
    assert clean.join(kept.select("doc_id"), "doc_id", "left_anti").count() == 0


def test_license_places_and_templates():
    index = licenses.Index()
    index.weigh(10, {})
    words = "x released under the mit license and the mit license again".split()
    words = [w.encode() for w in words]
    assert [i for i, _ in licenses.phrase_places(words)] == [4, 8]
    assert index.scan(words)[0] == {"mit"}
    bsd = licenses.plain_words(b"Redistribution and use in source and binary forms, with or without modification, are hereby permitted provided that the following conditions are met:")
    assert index.scan(bsd)[0] == {"bsd"}
    assert index.scan([w for w in bsd if w != b"binary"])[0] == set()  # a key phrase is missing
    assert index.scan(b"Licensed under CC BY-NC 4.0".lower().replace(b"-", b" ").replace(b".", b" ").split())[0] == {"cc-by-nc"}


def test_scrambled_notices_are_refused():
    index = licenses.Index()
    bsd = next(t for t in licenses.TEMPLATES if t[0] == "bsd")
    words, r = bsd[1].split(), random.Random(2)
    keys = [k.split() for k in bsd[2]]
    rest = [w for w in words if not any(w in k for k in keys)]
    for _ in range(20):
        r.shuffle(rest)
        mixed = rest[: len(rest) // 2] + keys[1] + rest[len(rest) // 2 :] + keys[0]
        assert index.scan([w.encode() for w in mixed])[0] == set()
    assert index.scan([w.encode() for w in words])[0] == {"bsd"}


def test_licenses_equal_brute_force(spark, data):
    """Base columns and labels of whole documents, with notices planted in some: every start of every template is tried."""
    r = random.Random(4)
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    for i, (k, t) in enumerate(docs):
        if i % 3 == 0:
            words = (t or "").split()
            for _ in range(r.randint(1, 4)):
                notice = [w for w in r.choice(licenses.TEMPLATES)[1].split() if r.random() > 0.05]
                at = r.randint(0, len(words))
                words[at:at] = notice
            docs[i] = (k, " ".join(words))
    want = {}
    for k, t in docs:
        words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()]
        base, labels = {x for _, x in places}, set()
        for label, notice, keys in licenses.TEMPLATES:
            own = notice.encode().split()
            line = b" " + b" ".join(words) + b" "
            if any(b" " + x.encode() + b" " not in line for x in keys):
                continue
            for s in range(-licenses.SLACK, len(words)):
                stretch = words[max(0, s - 2) : max(0, s + len(own) + 4)]
                here = b" " + b" ".join(stretch) + b" "
                if all(b" " + x.encode() + b" " in here for x in keys):
                    row = [0] * (len(own) + 1)  # longest common subsequence
                    for w in stretch:
                        row = [0, *row[1:]]
                        last = list(row)
                        for j, o in enumerate(own):
                            row[j + 1] = last[j] + 1 if o == w else max(last[j + 1], row[j])
                    if row[-1] >= 0.6 * len(own):
                        labels.add(label)
        starts = [i for i, _ in places]
        want[k] = (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)))
    got = licenses.licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in got} == want and sum(bool(w[5]) for w in want.values()) > 40


def test_document_counts_change_the_candidates_and_no_label():
    r = random.Random(8)
    prose = "the of and license software public copyright this under general with without use free notice any as is version".split()
    texts = []
    for _ in range(150):
        words = [r.choice(prose) for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(words))
            words[at:at] = [w for w in r.choice(licenses.TEMPLATES)[1].split() if r.random() > 0.1]
        texts.append([w.encode() for w in words])
    found, tried = [], []
    for seed in range(3):
        index, draw = licenses.Index(), random.Random(seed)
        index.weigh(1000, {w: draw.randint(0, 1000) for w in index.postings} if seed else {})
        found.append([index.scan(t)[0] for t in texts])
        tried.append([sorted(index.candidates(t)) for t in texts])
    assert found[0] == found[1] == found[2] and sum(map(bool, found[0])) > 60
    assert tried[0] != tried[1] != tried[2]


def test_recall_of_mutated_notices():
    """Words lost, put in and changed in one of ten places, key phrases left whole."""
    r, index, right, n = random.Random(9), licenses.Index(), 0, 0
    for label, notice, keys in licenses.TEMPLATES * 5:
        words = notice.split()
        kept = {i for k in keys for i in range(len(words)) for j in range(len(k.split())) if words[i - j : i - j + len(k.split())] == k.split() and i >= j}
        out = []
        for i, w in enumerate(words):
            x = r.random() if i not in kept else 1
            out += [] if x < 0.04 else [w, "indeed"] if x < 0.07 else ["other"] if x < 0.1 else [w]
        around = [f"w{r.randint(0, 99)}" for _ in range(40)]
        n += 1
        right += label in index.scan([w.encode() for w in [*around, *out, *around]])[0]
    assert right >= 0.95 * n, (right, n)


@pytest.mark.parametrize(("line", "label"), [
    ("// SPDX-License-Identifier: MIT", "mit"), ("# SPDX-License-Identifier: Apache-2.0", "apache"), ("/* SPDX-License-Identifier: BSD-3-Clause */", "bsd"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl"), ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("Licensed under Creative Commons Attribution 4.0", "cc-by"), ("Mozilla Public License Version 2.0", "mpl"), ("SPDX-License-Identifier: MPL-2.0", "mpl"),
])
def test_tags_and_short_notices(line, label):
    assert label in licenses.Index().scan(licenses.plain_words(line.encode()))[0]


def test_all_licenses_of_one_long_text():
    index = licenses.Index()
    prose = [b"w%d" % i for i in range(300)]
    words = [w for t in licenses.TEMPLATES for w in (*prose, *t[1].encode().split())]
    for weights in ({}, {b"gnu": 9, b"mit": 9, b"lesser": 9}):
        index.weigh(10, weights)
        assert index.scan(words) == ({t[0] for t in licenses.TEMPLATES}, 1.0)


PAGE = """<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body><header>Site</header><nav><ul><li>menu</ul></nav>
<div class="cookie-notice"><p>We use cookies, as all do, and we say so.</p></div><div id="main"><div class="sidebar"><p>More, from, here.</p></div>
<div class="story"><h1>Head &amp; line</h1><p>First, with commas, and long enough to count as text.<p>Second one, too, <a href="x">a link</a> inside it &eacute;.<ul><li>one<li>two</ul></div></div>
<section id="comments"><p>A reader, with many, many, many commas, says much about it.</p></section><form><p>Your mail, please</p></form><footer>foot</footer></body></html>"""


def test_html_keeps_the_article_only():
    assert html_extraction.main_text(PAGE) == "Head & line\nFirst, with commas, and long enough to count as text.\nSecond one, too, a link inside it é.\none\ntwo"


def test_html_keeps_the_title_of_an_entry():
    page = """<body><div class="header">Site</div><div class="post"><div class="post-header"><h1>Title, here</h1></div><div class="post-body">
    <p>Text one, long, and long again, for points.</p><p>Text two.</p></div><div class="post-meta">by me</div></div><div class="related-posts"><p>Other, things, to, read.</p></div></body>"""
    assert html_extraction.main_text(page) == "Title, here\nText one, long, and long again, for points.\nText two."


@pytest.mark.parametrize("name", ["site-content no-sidebar", "post with-promo", "entry-content share-enabled", "article hidden-xs", "pageWithSidebar", "wrapper-comments"])
def test_html_is_not_misled_by_layout_names(name):
    text = "A text, long enough, with commas, to be read as the article of this page."
    page = f'<body><nav>menu</nav><div class="{name}"><h1>Head</h1><p>{text}</p><div class="sidebar"><p>Other, things.</p></div></div></body>'
    want = ["Head", text, "Other, things."] if name == "wrapper-comments" else ["Head", text]
    assert html_extraction.main_text(page).split("\n") == want


def test_html_of_a_page_of_noise_is_empty():
    assert html_extraction.main_text('<body><div class="sidebar"><p>Other, things, to, read, here, and there.</p></div><nav>menu</nav></body>') == ""


def test_hostile_pages_take_linear_time():
    import time

    pages = ["<blockquote>x, y" * 8000, "<a " * 20_000, "<div>" * 4000 + "<p>x" * 8000, "</b>" * 20_000 + "<i>" * 20_000 + "</b>" * 20_000, "<title>" * 20_000, "<ul><li>x" * 6000, "<a href='x" * 20_000]
    for page in pages:
        began = time.process_time()
        html_extraction.main_text(page)
        warc.title_of(page)
        list(warc.links_of(page))
        assert time.process_time() - began < 2, page[:20]


def test_odd_charsets_are_read_as_utf8():
    for name in ("idna", "undefined", "punycode", "rot13", "no-such", "hex", "utf-16"):
        rows = warc.derived(None, "u", None, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={name}\r\n\r\n", "<p>caf\u00e9 \u4e2d.</p>".encode(), None, None)
        assert [r[0] for r in rows] == ["metadata", "conversion"]
        if name in ("undefined", "rot13", "no-such", "hex"):
            assert rows[1][-1] == "caf\u00e9 \u4e2d."


def test_conversions_equal_brute_force(spark, data):
    """The text of whole pages by a plain parser, and the links by another expression."""
    import html.parser

    class Plain(html.parser.HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.hidden = [""], []

        def handle_starttag(self, tag, attrs):
            if tag in ("head", "script", "style", "noscript", "textarea", "title", "iframe", "svg"):
                self.hidden.append(tag)
            if tag in html_extraction.BLOCKS:
                self.blocks.append("")
            if tag == "br":
                self.handle_data(" ")

        def handle_endtag(self, tag):
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
            if tag in html_extraction.BLOCKS:
                self.blocks.append("")

        def handle_data(self, text):
            if not self.hidden:
                self.blocks[-1] += text

    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r["page_id"]: r["block"] for r in warc.derivatives(warc.responses(pages), keep=("page_id",)).where("record_type = 'conversion'").collect()}
    for r in pages.collect():
        p = Plain()
        p.feed(r["html"] or "")
        p.close()
        assert got[r["page_id"]] == "\n".join(b for b in (" ".join(x.split()) for x in p.blocks) if b)


def test_html_equals_the_articles_of_the_pages(spark, data):
    import html

    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h\d|div|li|ul)[^>]*>", article)]
        assert html_extraction.main_text(r["html"]) == "\n".join(b for b in want if b)


def test_warc_round_trip(spark, data, tmp_path):
    records = warc.derivatives(warc.responses(spark.read.parquet(f"{data}/pages.parquet")), keep=("page_id",)).cache()
    warc.write_warc(records, f"{tmp_path}/w")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    found, at = {}, 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        block = raw[end + 4 : end + 4 + n]
        assert raw[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
        assert head["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        found[head["WARC-Record-ID"]] = (head, block.decode())
        at = end + 8 + n
    rows = records.collect()
    assert len(found) == len(rows)
    for r in rows:
        head, block = found[r["record_id"]]
        assert block == r["block"] and head["WARC-Refers-To"] == r["refers_to"] and head["WARC-Concurrent-To"] == r["linked_to"]
        assert found[r["linked_to"]][0]["WARC-Refers-To"] == r["refers_to"]


def test_compression_prefers_the_nearer_dictionary():
    good, bad = [b"the cat sat on the mat and looked at the moon %d" % i for i in range(200)], [b"### $$$ %%%% @@@ !!! %d" % i for i in range(200)]
    model = compression.Model(compression.build_dictionary(good, 4096), compression.build_dictionary(bad, 4096))
    model.calibrate(good[:50] + bad[:50], np.repeat([1.0, 0.0], 50), 1.0)
    c = model.compressors()
    assert model.score(b"the cat sat on the mat and looked at the moon 999", c) > 0.7 > 0.3 > model.score(b"### $$$ %%%% @@@ !!! 999", c)
