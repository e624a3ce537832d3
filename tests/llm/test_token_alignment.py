"""Aligned tokens against a plain loop over whole texts."""

import functools
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barsmith.llm import token_alignment as ta

A, B = f"{ta.FOLDER}/byte_bpe_50k.json", f"{ta.FOLDER}/piece_bpe_32k.model"
PIECES = ["the", " cat", "  ", "\n", "\n\n", " ", "\t", "é", "日本", "😀", "123", ".", "...", "'s", "<s>", "<|endoftext|>", "<0x41>", "▁", "\x00", " ", " ", "A", "ing", "-", "\r\n", "deutschland", " über", "é", "\x85", "\x1c"]


@functools.cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown}
    rest = [b for b in range(256) if b not in shown]
    back |= {chr(256 + k): b for k, b in enumerate(rest)}
    return a, {i: bytes(back.get(c, 0) for c in w) for w, i in a.get_vocab().items()}, sentencepiece.SentencePieceProcessor(model_file=B)


def whole_tokens(text):
    """(ids, ends) of both, or None."""
    a, bytes_a, b = libraries()
    raw = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts_a = [bytes_a[i] for i in ids_a]
    parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not text or b"".join(parts_a) != raw or b"".join(parts_b) != raw:
        return None
    ends = []
    for parts in (parts_a, parts_b):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        ends.append(out)
    return ids_a, ends[0], ids_b, ends[1]


def brute(texts):
    """Rows without ids, by loops."""
    each, held = [], Counter()
    for text in texts:
        found = whole_tokens(text or "")
        if found is None:
            each.append(None)
            continue
        ids_a, ends_a, ids_b, ends_b = found
        links = [(x, y) for i, x in enumerate(ids_a) for j, y in enumerate(ids_b) if max(([0] + ends_a)[i], ([0] + ends_b)[j]) < min(ends_a[i], ends_b[j])]
        cut, groups = sorted(set(ends_a) & set(ends_b)), []
        for low, high in zip([0, *cut], cut):
            groups.append("|".join(",".join(str(x) for x, e in zip(ids, ends) if low < e <= high) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
        each.append((ids_a, ids_b, groups, links))
        held.update(set(links))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for found in each:
        if found is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            ids_a, ids_b, groups, links = found
            out.append((len(ids_a), len(ids_b), len(groups), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def texts(n, seed=1, longest=60):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_ids_are_those_of_the_libraries():
    t = ta.tokenizers(A, B)
    none = 0
    for text in texts(3_000):
        want, b = whole_tokens(text), t.ids_b(text)
        assert t.ids_a(" " + text).tolist() == libraries()[0].encode(" " + text, add_special_tokens=False).ids, text
        if text and want is None:
            none += 1
            assert b is None
        elif text:
            assert b.tolist() == want[2], text
    assert 100 < none < 2_900


@pytest.mark.parametrize("size", [1, 3, 10, 50])
def test_any_order_of_composition_gives_the_whole(size):
    t, r, open_ends = ta.tokenizers(A, B), random.Random(size), 0
    for text in texts(400, seed=size):
        want = whole_tokens(text)
        pieces = [ta.piece(*x, t) for x in ta.ranges(text, size)]
        open_ends += sum(len(p.suffix.a) + len(p.suffix.b) > 0 for p in pieces)
        while len(pieces) > 1:
            k = r.randrange(len(pieces) - 1)
            pieces[k : k + 2] = [ta.composed(*pieces[k : k + 2], t)]
        done = ta.whole(pieces[0], t) if pieces else None
        assert (done is None) == (want is None)
        if want:
            n_a, n_b, straight = ta.aligned(text, t)
            assert (pieces[0].n_a, pieces[0].n_b) == (n_a, n_b) == (len(want[0]), len(want[2]))
            assert (done.text, done.n, done.pairs.tolist(), done.times.tolist()) == (straight.text, straight.n, straight.pairs.tolist(), straight.times.tolist())
    assert open_ends > 20


def test_tokens_of_one_side_alone_stay_open():
    t = ta.tokenizers(A, B)
    import numpy as np

    x = ta.Tokens(np.array([5, 6]), np.array([2, 4]), np.array([7]), np.array([3]))
    y = ta.Tokens(np.array([8]), np.array([9]), np.array([9, 10]), np.array([6, 9]))
    f = ta.composed(ta.fragment(x, t), ta.fragment(y, t), t)
    assert f.cut and ta.whole(f, t).text == "5,6,8|7,9,10" and ta.whole(f, t).times.sum() == 5


@pytest.mark.parametrize(("long_bytes", "chunk", "few"), [(65_536, 16_384, 500_000), (40, 7, 500_000), (200, 64, 0)])
def test_documents(spark, long_bytes, chunk, few):
    rows = [(i if i % 9 else None, t) for i, t in enumerate([*texts(60, seed=5), *texts(3, seed=6, longest=900), None, "", "plain words only", "plain words only", "x" * 3_000, " ", "a "])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "pairs", "count", "n_a", "piece")})
    got = ta.alignment(docs, A, B, long_bytes, chunk, few).collect()
    want = [((i or 0), *x) for (i, _), x in zip(rows, brute([t for _, t in rows]), strict=True)]
    assert sorted(((r["doc_id"] or 0), *r[1:]) for r in got) == sorted(want)


def test_empty_table_and_text_ids(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert ta.alignment(none, A, B).count() == 0
    one = spark.createDataFrame([("k", "a few words " * 50)], "doc_id string, text string")
    assert [r["doc_id"] for r in ta.alignment(one, A, B, 100, 50).collect()] == ["k"]
