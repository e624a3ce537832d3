"""Personal data against the patterns themselves and SQL."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from barsmith.llm import pii
from barsmith.llm.queries import QUERIES

EMAIL, IP, CARD, PHONE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def checks(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    fits = {
        0: lambda m: True, 1: lambda m: all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m.split(".")),
        2: lambda m: 12 <= len(digits(m)) <= 19 and checks(digits(m)), 3: lambda m: 9 <= len(digits(m)) <= 15,
    }
    return sorted((m.start(), k, m.end()) for k, p in enumerate((EMAIL, IP, CARD, PHONE)) for m in re.finditer(p, text) if fits[k](m.group()))


def texts(n, seed=1):
    r = random.Random(seed)
    pieces = ["@", ".", "-", " ", "+", "(", ")", "1", "2", "25", "255", "256", "1.2.3.4", "10.0.0.1", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 010-9999", "a", "b.c", "x_y", "é", "日", "😀", "\n", "ann@mail.example.com", "%", "00", "%%%", "79927398713"]
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_base_equals_the_patterns():
    seen = [0] * 4
    for t in texts(20_000) + ["1.2.3.4.5.6.7.8", "1.2.3..4.5.6.7", "a@b@c.d", "a@b.c@d.e", "a@b.c_d@e.f", "+1+22 33 444555", "9" * 6000 + ".1.2.3", "0000.00.0255.1", "4111-1111-1111-1111 4111", "0" * 12]:
        want = brute(t)
        assert [s for s in pii.spans(t) if s[1] < pii.BASE] == want, t
        for _, k, _ in want:
            seen[k] += 1
    assert all(n > 200 for n in seen)


@pytest.mark.parametrize(("text", "kind", "value"), [
    ("write to mailto:ann.lee+x@mail.example.org.", "email", "ann.lee+x@mail.example.org"), ("see ftp://bob:pa55w0rd@host.example/x", "login", "bob:pa55w0rd"),
    ("IBAN: DE89 3704 0044 0532 0130 00 PLEASE", "iban", "DE89 3704 0044 0532 0130 00"), ("Iban GB82WEST12345698765432.", "iban", "GB82WEST12345698765432"),
    ("Account Number: 0012-345 678, thanks", "account", "0012-345 678"), ("SSN 123-45-6789", "ssn", "123-45-6789"), ("Social security number: 123-45-6789", "ssn", "123-45-6789"),
    ('token = "99dbebab99ab99999d99eeaaf9ac999e9999f999" x', "secret", "99dbebab99ab99999d99eeaaf9ac999e9999f999"), ("API KEY: AbC0123456789xyzQ", "secret", "AbC0123456789xyzQ"),
])
def test_values_behind_cues(text, kind, value):
    assert [text[a:b] for a, k, b in pii.spans(text) if pii.KINDS[k] == kind] == [value]


@pytest.mark.parametrize("text", ["the token was taken", "password: see-the-chapter-on-passwords", "IBAN: DE88 3704 0044 0532 0130 00", "ssn 12-345-6789", "https://example.com/a:b", "at 10.30 on 2024-01-15, 3.14159", "account number pending", "a @ b . c", "version 1.2.3"])
def test_clean_texts_stay_clean(text):
    assert pii.spans(text) == []


def test_long_texts_take_linear_time():
    import time

    for piece in ("a", "@", "1", "1.", "1 ", "+1", "a@", "a@b.c", "token=", "://a:b", "IBAN AA11"):
        took = []
        for n in (20_000, 160_000):
            t = piece * n
            began = time.process_time()
            pii.spans(t)
            took.append(time.process_time() - began)
        assert took[1] < 30 * took[0] + 0.5, (piece, took)


def test_rows_and_edges(spark):
    rows = [(1, "ann@mail.example.com 10.0.0.1"), (1, "ann@mail.example.com 10.0.0.1"), (2, None), (3, ""), (None, "é +1 (555) 010-9999"), (4, "x " * 100_000 + "a@b.c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n_email", "spans", "masked_text", "base_sha256")})
    got = pii.personal_data(docs, masks=True).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert sorted((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["spans"]) for r in got) == [
        (0, 0, 0, 0, 1, "phone:2:19"), (1, 1, 1, 0, 0, "email:0:20,ip:21:29"), (1, 1, 1, 0, 0, "email:0:20,ip:21:29"), (2, 0, 0, 0, 0, ""), (3, 0, 0, 0, 0, ""), (4, 1, 0, 0, 0, "email:200000:200005"),
    ]
    by = {r["doc_id"]: r for r in got}
    assert by[2]["base_sha256"] == by[3]["base_sha256"] == none and by[1]["base_sha256"] == hashlib.sha256(b"email:0:20,ip:21:29").hexdigest()
    assert by[1]["masked_text"] == "[EMAIL] [IP]" and by[2]["masked_text"] == "" and by[4]["masked_text"] == "x " * 100_000 + "[EMAIL]"
    assert pii.personal_data(docs.limit(0)).count() == 0
    overlapping = "4111111111111111@mail.example.com"
    assert pii.masked(overlapping, pii.spans(overlapping)) == "[EMAIL]"


#: Matches of a pattern with their places: what stands between matches has the lengths that lead up to each.
PLACES = """
SELECT r, {kind} AS kind, '{name}' AS name, list_sum([len(x) FOR x IN gaps[:k]]) + coalesce(list_sum([len(x) FOR x IN m[: k - 1]]), 0) AS start, m[k] AS value
FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS gaps FROM d), unnest(range(1, len(m) + 1)) u(k)
"""
BASE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
places AS ({places}),
tried AS (SELECT *, start + len(value) AS until, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM places),
good AS (
  SELECT * FROM tried WHERE kind = 0
    OR kind = 1 AND len([p FOR p IN string_split(value, '.') IF len(ltrim(p, '0')) > 3 OR TRY_CAST(ltrim(p, '0') AS INTEGER) > 255]) = 0
    OR kind = 2 AND len(digits) BETWEEN 12 AND 19 AND list_sum([CASE WHEN (len(digits) - i) % 2 = 0 THEN CAST(digits[i] AS INTEGER) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(digits[i] AS INTEGER) + 1] END FOR i IN range(1, len(digits) + 1)]) % 10 = 0
    OR kind = 3 AND len(digits) BETWEEN 9 AND 15),
each AS (SELECT r, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
  string_agg(name || ':' || CAST(start AS BIGINT) || ':' || CAST(until AS BIGINT), ',' ORDER BY start, kind) AS s FROM good GROUP BY r)
SELECT doc_id, coalesce(n_email, 0), coalesce(n_ip, 0), coalesce(n_card, 0), coalesce(n_phone, 0), sha256(coalesce(s, '')) FROM d LEFT JOIN each USING (r)
"""


def test_base_columns_equal_sql(spark):
    folder = "/root/testdata/sf0.01"
    places = " UNION ALL ".join(PLACES.format(kind=k, name=pii.KINDS[k], pattern=p) for k, p in enumerate((EMAIL, IP, CARD, PHONE)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(BASE_SQL.replace("{places}", places)).fetchall()
    got = QUERIES["op11_anchor_expansion"](spark, folder).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r["n_email"] + r["n_phone"] for r in got) > 10
