"""Alignment of two tokenizers' tokens by an associative monoid of fragments.

Two token sequences of one text are cut where tokens of both end at one byte. A piece of the text yields a fragment: an
open prefix (tokens up to the first common end), closed groups (as text, with their linked pairs of ids) and an open
suffix (tokens after the last common end). Two neighbouring fragments compose: the suffix of the one and the prefix of
the other may close new groups between them. Composition is associative, so the fragments of a very long text are made by
different tasks and put together by a tree of groupings.

Texts are cut where tokenizers can't join: A before white space behind other characters, B before a space behind what is
neither space nor its mark (no piece of B may hold such a place; this is checked). The two cuts of a range differ where
lines end, and then groups stay open at the range's ends.

How many documents hold a pair of ids linked is summed in Spark from the distinct pairs of each document. A table of
counts that is small enough is broadcast to the documents' pairs, a larger one meets them in a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, stored, table

FOLDER = "/opt/tokenizers"
#: Texts of more bytes are cut into ranges of CHUNK characters.
LONG_BYTES, CHUNK = 65_536, 16_384
#: Fragments of a text that one task composes in a round.
ARITY = 8
#: Tables of pairs with so many rows at most are broadcast (about 50 MB).
FEW_PAIRS = 500_000
#: A pair of ids is one number: the id of A times this, plus the id of B.
SHIFT = 2**20

MARK = "▁"
_CUT_A, _CUT_B = re.compile(r"(?<=\S)[\x20\t\n\r]"), re.compile(rf"(?<=[^\s{MARK}]) ")
#: Fixed value: what A cuts a text into before anything is merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizers:
    """Ids of both tokenizers, the bytes of each id, and the ids' decimals with what follows them in a list of groups."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        known = {entry: bytes(byte_of[c] for c in entry) for entry in model["vocab"] if all(c in byte_of for c in entry)}
        # single bytes come first, then what merges make, in their order; the encoder gives ranks
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        ranked = [*byte_of, *made]
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={known[e]: k for k, e in enumerate(ranked)}, special_tokens={})
        self.id_of = np.array([model["vocab"][e] for e in ranked], np.int64)
        self.bytes_a = [b""] * (1 + max(model["vocab"].values()))
        for entry, i in model["vocab"].items():
            self.bytes_a[i] = known.get(entry, entry.encode())
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(x != MARK and y == MARK for p in pieces for x, y in zip(p, p[1:])):
            raise ValueError("pieces that go on behind a word can't be cut at words")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.lone_space = self.b.piece_to_id(MARK)
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in xs]) for xs in (self.bytes_a, self.bytes_b))
        ends = ",|", ",;"
        self.shown = [f"{i}{end}" for xs, both in zip((self.bytes_a, self.bytes_b), ends) for end in both for i in range(len(xs))]

    def ids_a(self, text: str) -> np.ndarray:
        return self.id_of[self.a.encode_ordinary(text)]  # byte-level: always gives the bytes back

    def ids_b(self, text: str) -> np.ndarray | None:
        """``text`` with a space before it; None where the ids' bytes are others."""
        ids = self.b.encode(text, num_threads=1) if text else [self.lone_space]
        return np.array(ids, np.int64) if b"".join(map(self.bytes_b.__getitem__, ids)) == b" " + text.encode() else None


@cache
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


NO_IDS = np.zeros(0, np.int64)


def _none() -> np.ndarray:
    return NO_IDS


@dataclass
class Tokens:
    """Ids of both sides and the bytes where they end, counted from the beginning of the text."""

    a: np.ndarray = field(default_factory=_none)
    a_ends: np.ndarray = field(default_factory=_none)
    b: np.ndarray = field(default_factory=_none)
    b_ends: np.ndarray = field(default_factory=_none)

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(x) for x in zip(self.arrays(), other.arrays(), strict=True)))

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_ends, self.b, self.b_ends

    def between(self, low: int, high: int | None) -> Tokens:
        """Those that end behind ``low`` and not behind ``high``."""
        out = []
        for ids, ends in ((self.a, self.a_ends), (self.b, self.b_ends)):
            i = np.searchsorted(ends, low, "right")
            j = len(ends) if high is None else np.searchsorted(ends, high, "right")
            out += [ids[i:j], ends[i:j]]
        return Tokens(*out)


@dataclass
class Closed:
    """Closed groups: their text, how many they are, and how often each pair of ids is linked."""

    text: str = ""
    n: int = 0
    pairs: np.ndarray = field(default_factory=_none)
    times: np.ndarray = field(default_factory=_none)

    def __add__(self, other: Closed) -> Closed:
        if not self.n or not other.n:
            return self if self.n else other
        pairs, at = np.unique(np.concatenate([self.pairs, other.pairs]), return_inverse=True)
        times = np.bincount(at, np.concatenate([self.times, other.times])).astype(np.int64)
        return Closed(f"{self.text};{other.text}", self.n + other.n, pairs, times)


@dataclass
class Fragment:
    """``cut``: the piece holds a common end; without one all its tokens stand in ``prefix``."""

    ok: bool
    n_a: int
    n_b: int
    cut: bool
    prefix: Tokens
    closed: Closed
    suffix: Tokens


def _met(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of two rising sequences without repeats: what both hold, and what either does."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    again = both[1:] == both[:-1]
    return both[1:][again], both[np.concatenate([[True], ~again])] if len(both) else both


def groups(x: Tokens, t: Tokenizers) -> Closed:
    """Groups of tokens whose last ends are common."""
    if not len(x.a):
        return Closed()
    common, ends = _met(x.a_ends, x.b_ends)
    order = np.empty(len(x.a) + len(x.b), np.int64)
    upto = [np.searchsorted(side, common, "right") for side in (x.a_ends, x.b_ends)]  # tokens up to each group's end
    sizes = [np.diff(u, prepend=0) for u in upto]
    for side, ids, before in ((0, x.a, upto[1] - sizes[1]), (1, x.b, upto[0])):  # tokens of the other side ahead of a group's
        kind = 2 * len(t.bytes_a) * side + ids
        kind[upto[side] - 1] += len((t.bytes_a, t.bytes_b)[side])  # the last of its group
        order[np.arange(len(ids)) + np.repeat(before, sizes[side])] = kind
    text = "".join([t.shown[k] for k in order.tolist()])
    links = x.a[np.searchsorted(x.a_ends, ends)] * SHIFT + x.b[np.searchsorted(x.b_ends, ends)]  # one for each end of either
    links.sort()
    first = np.flatnonzero(np.concatenate([[True], links[1:] != links[:-1]]))
    return Closed(text[:-1], len(common), links[first], np.diff(first, append=len(links)))


def fragment(x: Tokens, t: Tokenizers, ok: bool = True) -> Fragment:
    common, _ = _met(x.a_ends, x.b_ends)
    if not len(common):
        return Fragment(ok, len(x.a), len(x.b), False, x, Closed(), Tokens())
    first, last = common[0], common[-1]
    return Fragment(ok, len(x.a), len(x.b), True, x.between(-1, first), groups(x.between(first, last), t), x.between(last, None))


def composed(x: Fragment, y: Fragment, t: Tokenizers) -> Fragment:
    """The fragment of both pieces; associative, and a fragment without tokens changes nothing."""
    middle = fragment((x.suffix if x.cut else x.prefix) + y.prefix, t)
    if x.cut:
        closed = x.closed + (groups(middle.prefix, t) + middle.closed if middle.cut else Closed()) + y.closed
        suffix = y.suffix if y.cut else middle.suffix if middle.cut else middle.prefix
        prefix, cut = x.prefix, True
    else:
        prefix, closed, cut = middle.prefix, middle.closed + y.closed, middle.cut
        suffix = y.suffix if y.cut else middle.suffix
    return Fragment(x.ok and y.ok, x.n_a + y.n_a, x.n_b + y.n_b, cut, prefix, closed, suffix)


def whole(x: Fragment, t: Tokenizers) -> Closed | None:
    """Groups of a fragment that is a whole text; None where the tokens don't give the text's bytes."""
    if not x.ok or len(x.suffix.a) or len(x.suffix.b) or not x.cut:
        return None
    return groups(x.prefix, t) + x.closed


def tokens(text_a: str, text_b: str | None, from_a: int, from_b: int, t: Tokenizers) -> Tokens | None:
    """Tokens of a range: ``text_a`` begins at the byte ``from_a``; ``text_b`` (None: no tokens of B) begins behind the space
    at ``from_b``. None where B doesn't give the bytes back."""
    a, b = t.ids_a(text_a), NO_IDS if text_b is None else t.ids_b(text_b)
    return None if b is None else Tokens(a, from_a + t.lengths_a[a].cumsum(), b, from_b + t.lengths_b[b].cumsum())


def piece(text_a: str, text_b: str | None, from_a: int, from_b: int, t: Tokenizers) -> Fragment:
    found = tokens(text_a, text_b, from_a, from_b, t)
    return fragment(found, t) if found else Fragment(False, 0, 0, False, Tokens(), Closed(), Tokens())


def aligned(text: str, t: Tokenizers) -> tuple[int, int, Closed] | None:
    """Numbers of tokens and groups of a text in one piece: it has no open ends."""
    found = tokens(" " + text, text, 0, 0, t)
    return found and (len(found.a), len(found.b), groups(found, t))


def ranges(text: str, size: int) -> Iterator[tuple[str, str | None, int, int]]:
    """Ranges of about ``size`` characters as they are tokenised: text of A (the first with the added space), text of B without
    its space (None: nothing), and the bytes of space + text where they begin."""

    def cuts(form: re.Pattern) -> list[int]:
        out = [0]
        for low in range(size, len(text), size):
            m = form.search(text, low)
            out.append(m.start() if m else len(text))
        return [*out, len(text)]

    def offsets(at: list[int]) -> list[int]:
        sizes = [len(text[i:j].encode()) for i, j in zip(at, at[1:])]
        return [0, *np.cumsum([1, *sizes]).tolist()[1:]]  # the first begins with the added space

    at_a, at_b = cuts(_CUT_A), cuts(_CUT_B)
    off_a, off_b = offsets(at_a), offsets(at_b)
    for k, (i, j, m, n) in enumerate(zip(at_a, at_a[1:], at_b, at_b[1:])):
        if i < j or m < n:
            yield " " * (k == 0) + text[i:j], (text[m + (k > 0) : n] if m < n else None), off_a[k], off_b[k]


LISTS = [f"{side}_{part}" for side in ("prefix", "suffix") for part in ("a", "a_ends", "b", "b_ends")]
FRAGMENT = f"row long, piece int, ok boolean, n_a long, n_b long, cut boolean, text string, n long, pairs array<long>, times array<long>, {', '.join(f'{c} array<long>' for c in LISTS)}"
DIGEST = "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _fragment_row(row: int, k: int, f: Fragment) -> dict:
    lists = (*f.prefix.arrays(), *f.suffix.arrays())
    return {"row": row, "piece": k, "ok": f.ok, "n_a": f.n_a, "n_b": f.n_b, "cut": f.cut, "text": f.closed.text, "n": f.closed.n, "pairs": f.closed.pairs, "times": f.closed.times} | dict(zip(LISTS, lists, strict=True))


def _read_fragment(x: dict) -> Fragment:
    n = lambda c: np.array(x[c], np.int64)
    halves = [Tokens(*(n(c) for c in LISTS[k : k + 4])) for k in (0, 4)]
    return Fragment(x["ok"], x["n_a"], x["n_b"], x["cut"], halves[0], Closed(x["text"], x["n"], n("pairs"), n("times")), halves[1])


def _digest_row(row: int, found: tuple[int, int, Closed] | None) -> dict:
    if found is None:
        return {"row": row, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "pairs": NO_IDS, "times": NO_IDS}
    n_a, n_b, done = found
    return {"row": row, "n_a": n_a, "n_b": n_b, "n_groups": done.n, "n_links": int(done.times.sum()), "groups_sha256": hashlib.sha256(done.text.encode()).hexdigest(), "pairs": done.pairs, "times": done.times}


def _with_id(doc_id: pa.Array, rest: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_id, *rest.columns], ["doc_id", *rest.schema.names])


def _arrow_type(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}[kind]


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [(c.split()[0], _arrow_type(c.split()[1])) for c in schema.split(", ")]

    def column(c: str, kind: pa.DataType) -> pa.Array:
        values = [r[c] for r in rows]
        if not pa.types.is_list(kind):
            return pa.array(values, kind)
        flat = np.concatenate(values) if values else NO_IDS
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat.astype(np.int64)), type=kind)

    return pa.RecordBatch.from_arrays([column(c, kind) for c, kind in fields], [c for c, _ in fields])


def digests(docs: DataFrame, path_a: str, path_b: str, long_bytes: int = LONG_BYTES, chunk: int = CHUNK) -> DataFrame:
    """doc_id and DIGEST of each document; ``row`` tells documents of one id apart."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b)
        for whole_batch in batches:
            for b in (whole_batch.slice(k, 200) for k in range(0, max(1, len(whole_batch)), 200)):
                found = [_digest_row(r, aligned(x, t) if x else None) for r, x in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True)]
                yield _with_id(b.column("doc_id"), _batch(found, DIGEST))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
        for b in batches:
            for k, (r, x) in enumerate(zip(b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True)):
                found = list(ranges(x, chunk))
                columns = [[r] * len(found), range(len(found)), *zip(*found, strict=True)]
                out = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["row", "piece", "text_a", "text_b", "from_a", "from_b"])
                yield _with_id(b.column("doc_id").take(pa.array([k] * len(found))), out)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b)
        for whole_batch in batches:
            for b in (whole_batch.slice(k, 20) for k in range(0, max(1, len(whole_batch)), 20)):
                yield _batch([_fragment_row(x["row"], x["piece"], piece(x["text_a"], x["text_b"], x["from_a"], x["from_b"], t)) for x in b.to_pylist()], FRAGMENT)

    def joined(rows: pa.Table) -> tuple[dict, Fragment, Tokenizers]:
        t = tokenizers(path_a, path_b)
        each = rows.sort_by("piece").to_pylist()
        f = _read_fragment(each[0])
        for x in each[1:]:
            f = composed(f, _read_fragment(x), t)
        return each[0], f, t

    def compose(rows: pa.Table) -> pa.Table:
        first, f, _ = joined(rows)
        return pa.Table.from_batches([_batch([_fragment_row(first["row"], first["piece"] // ARITY, f)], FRAGMENT)])

    def finish(rows: pa.Table) -> pa.Table:
        first, f, t = joined(rows)
        done = whole(f, t)
        return pa.Table.from_batches([_batch([_digest_row(first["row"], done and (f.n_a, f.n_b, done))], DIGEST)])

    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > long_bytes
    doc_id = f"doc_id {dict(docs.dtypes)['doc_id']}"
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    numbered = lambda rows, k: rows.withColumn("row", F.monotonically_increasing_id() * 2 + k)
    pieces = numbered(docs.where(is_long), 1).mapInArrow(cut, f"{doc_id}, row long, piece int, text_a string, text_b string, from_a long, from_b long")
    pieces = stored(pieces, "ranges")  # of the long texts only
    most = pieces.agg(F.max("piece")).first()[0]
    out = numbered(docs.where(~is_long), 0).mapInArrow(short, f"{doc_id}, {DIGEST}")
    if most is None:
        return out
    tree = pieces.drop("doc_id").repartition("row", "piece").mapInArrow(leaves, FRAGMENT)
    while most >= ARITY:  # a round for each power of ARITY that the longest text has pieces
        node = F.floor(F.col("piece") / ARITY).alias("node")
        tree = tree.groupBy("row", node).applyInArrow(compose, FRAGMENT)
        most //= ARITY
    tree = tree.groupBy("row").applyInArrow(finish, DIGEST)
    return out.unionByName(pieces.where("piece = 0").select("doc_id", "row").join(tree, "row"))


def alignment(docs: DataFrame, path_a: str, path_b: str, long_bytes: int = LONG_BYTES, chunk: int = CHUNK, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document: the numbers of its tokens, of
    groups between common ends and of links (pairs of overlapping tokens), of links whose pair of ids is linked in as many
    documents as any pair of the A id (ties count), the sum of those numbers of documents over the links, and the hash of
    the groups as text.

    ``path_a`` is a byte-level BPE of the tokenizers library, ``path_b`` a sentencepiece model; all workers must see both.
    A text is encoded with a space before it. Null and empty texts, and those that a tokenizer doesn't give back byte for byte,
    have no tokens: zeros and an empty hash. Repeated rows are documents of their own; ids may be null or repeat; very long
    texts are spread over tasks; other columns are not looked at; an empty table gives no rows."""
    bounded_batches(docs.sparkSession)
    full = stored(digests(docs, path_a, path_b, long_bytes, chunk), "digests")
    held = full.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    held = stored(held, "pairs")
    a = lambda: F.floor(F.col("pair") / SHIFT)
    best = held.groupBy(a().alias("a")).agg(F.max("count").alias("best"))
    counts = held.join(best, a() == F.col("a")).select("pair", "count", (F.col("count") == F.col("best")).alias("is_best"))
    counts = F.broadcast(counts) if held.count() <= few_pairs else counts
    linked = full.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = linked.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    found = full.drop("pairs", "times").join(sums, "row", "left")
    more = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *more, "groups_sha256")


def op12_fragment_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the tokens of two public tokenizers over all documents; edge cases: see :func:`alignment`."""
    return alignment(table(spark, sf_dir, "documents"), f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model")
