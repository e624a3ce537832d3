"""Personal data by anchor expansion.

One Aho-Corasick automaton finds what personal data can't do without: at-signs, schemes, pairs of digits, plus signs before
a digit and words that announce an identifier. From each anchor a small local parser finds where the value begins and
ends and checks it (parts of addresses, numbers of digits, check digits). Text without anchors is passed over once and
parsed nowhere, and each parser moves forwards only, so the time is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

#: Kinds in the order of their places in a list of spans; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "login", "iban", "account", "ssn", "secret")
BASE = 4

#: Words that announce an identifier, in lower case; they also count capitalised and in capitals.
CUES = {
    "iban": ("iban",),
    "account": ("account number", "account no", "acct", "kontonummer", "konto-nr", "numéro de compte", "número de cuenta"),
    "ssn": ("ssn", "social security number", "social security"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access key"),
}

Span = tuple[int, int, int]  # start, kind's place, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"://([A-Za-z0-9._%+-]+:[^\s:/@]+)@[A-Za-z0-9-]")
_IBAN = re.compile(r":?[\x20]?([A-Z]{2}[0-9]{2}([\x20]?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"[.:#]{0,2}[\x20]?([0-9]([\x20-]?[0-9]){5,19})")
_SSN = re.compile(r"[.:#]?[\x20]?([0-9]{3}-[0-9]{2}-[0-9]{4})")
_SECRET = re.compile(r"[\x20]?[=:][\x20]?[\"']?([A-Za-z0-9_+/.-]{16,})")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """The sum of the digits, every second from the right doubled (and its digits added), ends in 0."""
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def iban_holds(value: str) -> bool:
    """Letters as 10 to 35, the first four characters last: the number leaves 1 modulo 97."""
    value = value.replace(" ", "")
    return len(value) >= 15 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _only_digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


class Parser:
    """Spans of one kind in one text, from its anchors in order; ``done`` is where the last match of the pattern ended."""

    def __init__(self, text: str, found: list[Span]):
        self.text, self.found = text, found
        self.done = [0] * len(KINDS)

    def add(self, kind: int, start: int, end: int) -> None:
        self.found.append((start, kind, end))

    def email(self, at: int) -> None:
        low = self.done[0]
        m = _DOMAIN.match(self.text, at + 1)
        if m is None or at < low:
            return
        start = at
        while start > low and self.text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            self.done[0] = m.end()
            self.add(0, start, m.end())

    def ip(self, at: int) -> None:
        """``at`` is a digit before a dot and a digit."""
        low = start = self.done[1]
        if at < low:
            return
        start = at
        while start > low and "0" <= self.text[start - 1] <= "9":
            start -= 1
        m = _IP.match(self.text, start)
        if m:
            self.done[1] = m.end()
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                self.add(1, start, m.end())

    def card(self, at: int) -> None:
        """``at`` is a digit before another, with at most one space or hyphen between them."""
        if at < self.done[2]:
            return
        m = _CARD.match(self.text, at)
        self.done[2] = m.end()
        digits = _only_digits(m.group()) if m.end() - at <= 37 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            self.add(2, at, m.end())

    def phone(self, at: int) -> None:
        m = _PHONE.match(self.text, at)
        if m and 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            self.add(3, at, m.end())

    def login(self, at: int) -> None:
        """A name and a password between a scheme and its host."""
        m = _LOGIN.match(self.text, at)
        if m:
            self.add(4, m.start(1), m.end(1))

    def value(self, kind: str, at: int) -> None:
        """What follows a cue that ends before ``at``."""
        k = KINDS.index(kind)
        m = {"iban": _IBAN, "account": _ACCOUNT, "ssn": _SSN, "secret": _SECRET}[kind].match(self.text, at)
        if m is None or m.start(1) < self.done[k]:
            return
        start, end = m.span(1)
        if kind == "iban":  # the longest that holds and ends with a group: words in capitals may follow
            ends = [e for e in range(end, start + 14, -1) if e == end or self.text[e] == " "]
            end = next((e for e in ends if iban_holds(self.text[start:e])), 0)
        if not end or kind == "secret" and not _only_digits(m.group(1)):  # a word is no secret
            return
        self.done[k] = end
        self.add(k, start, end)


@cache
def automaton() -> ahocorasick.Automaton:
    """Anchors: what parser they start, and how far the last character is from where it begins."""
    found: dict[str, list[tuple[str, int]]] = {"@": [("email", 0)], "://": [("login", 2)]}
    for a in "0123456789":
        found["+" + a] = [("phone", 1)]
        for b in "0123456789":
            found[f"{a}.{b}"] = [("ip", 2)]
            for gap in ("", " ", "-"):
                found[a + gap + b] = [("card", len(gap) + 1)]
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue[0].upper() + cue[1:], cue.title(), cue.upper()}:
                found.setdefault(form, []).append((kind, -1))
    out = ahocorasick.Automaton()
    for word, kinds in found.items():
        out.add_word(word, kinds)
    out.make_automaton()
    return out


def spans(text: str) -> list[Span]:
    """All spans of a text by start, then kind: (start, place in KINDS, end), code points, end exclusive. The base kinds are
    what their patterns match from left to right without overlap, failing matches left out."""
    found: list[Span] = []
    parser = Parser(text, found)
    base: dict[str, Callable[[int], None]] = {"email": parser.email, "ip": parser.ip, "card": parser.card, "phone": parser.phone, "login": parser.login}
    for end, kinds in automaton().iter(text):
        for kind, back in kinds:
            if kind in base:
                base[kind](end - back)
            else:
                parser.value(kind, end + 1)
    return sorted(found)


def listed(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def masked(text: str, found: list[Span]) -> str:
    """The text with each span (overlapping ones together) replaced by the kind of the first."""
    out, at = [], 0
    for a, k, b in found:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, masks: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans), and with ``masks`` ``masked_text``, for each
    document. Null texts are read as empty: no span, the hash of the empty string (and an empty masked text). Very long texts
    take linear time; repeated rows give equal rows; other columns, whatever their names, are not looked at; an empty table
    gives no rows. Spans of different kinds may overlap, and a span that two kinds share is listed for both."""
    bounded_batches(docs.sparkSession)
    counts = tuple(f"n_{k}" for k in KINDS[:BASE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            each = [spans(t) for t in texts]
            base = [[s for s in found if s[1] < BASE] for found in each]
            columns = {"doc_id": batch.column("doc_id")}
            columns |= {c: pa.array([sum(s[1] == k for s in found) for found in base], pa.int64()) for k, c in enumerate(counts)}
            columns["base_sha256"] = pa.array([hashlib.sha256(listed(found).encode()).hexdigest() for found in base], pa.string())
            columns["spans"] = pa.array([listed(found) for found in each], pa.string())
            columns["n_spans"] = pa.array([len(found) for found in each], pa.int64())
            if masks:
                columns["masked_text"] = pa.array([masked(t, found) for t, found in zip(texts, each, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string, n_spans long"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema + ", masked_text string" * masks)


def op11_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; edge cases: see :func:`personal_data`."""
    return personal_data(table(spark, sf_dir, "documents"))
