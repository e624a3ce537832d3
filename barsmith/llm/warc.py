"""WARC derivatives: for every response record a metadata record and, where its body is text, a plain-text conversion
record, linked to the response and to each other and carrying the source's headers and digests.

A derived record refers to its response (WARC-Refers-To) and names the other derived record (linked_to). Identifiers
are hashes of the response's identifier and the record's type, so reruns give the same records. Digests are SHA-1 in
base 32, as is usual in WARC files; digests that a response brings along are kept, missing ones are computed.

A null or empty body gives an empty conversion; a null target or date stays null and is left out of the written
header; a null record identifier is replaced by one made from target and body, so repeated rows, which each give their
records, give equal identifiers (bring identifiers along where they must differ); an unknown or unusable charset is read
as UTF-8; very long bodies are converted whole; an empty table gives none; extra columns, such as a row's id, are carried
along under ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, raw, table
from .html_extraction import ATTRIBUTE, TOKEN, after_raw_text, all_text

HTML, TEXT = ("text/html", "application/xhtml+xml"), ("text/plain",)
HALF = re.compile("[\ud800-\udfff]")
TITLE, TITLE_END = re.compile(r"<title[^<>]*>", re.I), re.compile(r"</title\s*>", re.I)
# Elements that link to something, and the attribute that says to what.
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src"}
DERIVED = "record_type string, record_id string, refers_to string, linked_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_headers string, source_block_digest string, source_payload_digest string, block string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    h = hashlib.md5("\n".join(parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Raw pages (page_id, url, html) as response records with an HTTP header; the page's id is kept."""
    body = raw(F.col("html"))
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", F.lit(None).cast("string").alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), header.alias("http_headers"), body.alias("payload"), F.lit(None).cast("string").alias("block_digest"), F.lit(None).cast("string").alias("payload_digest"))


def header_value(headers: str, name: str) -> str:
    found = re.search(rf"^{re.escape(name)}:[ \t]*(.*?)[ \t]*\r?$", headers, re.I | re.M)
    return found[1] if found else ""


def decoded(payload: bytes, content_type: str) -> str:
    charset = re.search(r"charset=\"?([\w.:-]+)", content_type, re.I)
    try:
        text = payload.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, ValueError):  # unknown names, and codecs that aren't for text or raise at any byte
        return payload.decode("utf-8", "replace")
    if HALF.search(text):  # some codecs make halves of a pair: pairs are joined, lone halves replaced
        text = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


def title_of(page: str) -> str:
    """What stands in the first title that is closed, else nothing."""
    found = TITLE.search(page)
    end = TITLE_END.search(page, found.end()) if found else None
    return " ".join(page[found.end() : end.start()].split()) if found and end else ""


def links_of(page: str) -> Iterator[tuple[str, str, str]]:
    """(element, attribute, target) of every link outside comments and scripts, tag by tag."""
    pos = 0
    while m := TOKEN.search(page, pos):
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name or m[1] or m[4]:
            continue
        if name in LINKS:
            for k, x, y, z in ATTRIBUTE.findall(m[3] if m[2] else m[6]):
                if k.lower() == LINKS[name]:
                    yield name, LINKS[name], " ".join((x or y or z).split())
                    break
        pos = after_raw_text(page, name, pos)


def derived(source_id: str | None, uri: str | None, date: str | None, headers: str | None, payload: bytes | None, block: str | None, body: str | None) -> list[tuple]:
    """The records of one response, in the order of DERIVED."""
    headers, payload = headers or "", payload or b""
    source_id = source_id or record_id("response", uri or "", digest(payload))
    block, body = block or digest(headers.encode() + payload), body or digest(payload)
    kind = header_value(headers, "content-type")
    mime = kind.split(";")[0].strip().lower()
    page = decoded(payload, kind) if mime in HTML + TEXT or not mime else ""
    metadata_id, conversion_id = record_id("metadata", source_id), record_id("conversion", source_id)
    has_text = not mime or mime in HTML + TEXT

    lines = [f"source-{'status' if not i else 'header'}: {x}" for i, x in enumerate(headers.splitlines()) if x]
    lines += [f"source-block-digest: {block}", f"source-payload-digest: {body}"]
    if mime in HTML or not mime:
        if title := title_of(page):
            lines.append(f"title: {title}")
        lines += [f"outlink: {target} {name}/@{at}" for name, at, target in links_of(page)]
    made = [("metadata", metadata_id, conversion_id if has_text else None, "application/warc-fields", "".join(f"{x}\r\n" for x in lines))]
    if has_text:
        made.append(("conversion", conversion_id, metadata_id, "text/plain; charset=utf-8", page if mime in TEXT else all_text(page)))
    return [(t, own, source_id, other, uri, date, ct, len(b.encode("utf-8", "replace")), digest(b.encode("utf-8", "replace")), headers, block, body, b) for t, own, other, ct, b in made]


def derivatives(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Metadata and conversion records of response ``records`` (record_id, target_uri, warc_date, http_headers, payload,
    block_digest, payload_digest), with the columns of ``keep`` before them."""
    bounded_batches(records.sparkSession)
    columns = ("record_id", "target_uri", "warc_date", "http_headers", "payload", "block_digest", "payload_digest")
    narrow = records.select(*[F.col(c).alias(f"_keep_{c}") for c in keep], *columns)
    kept = [(f"_keep_{c}", c, narrow.schema[f"_keep_{c}"].dataType.simpleString()) for c in keep]
    names = [n.split()[0] for n in DERIVED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = [], []
            for i, row in enumerate(zip(*[batch[c].to_pylist() for c in columns], strict=True)):
                own = derived(*row)
                found += own
                owner += [i] * len(own)
            values = list(zip(*found, strict=True)) or [[]] * len(names)
            out = [batch[k].take(pa.array(owner, pa.int32())) for k, _, _ in kept]
            out += [pa.array(v, pa.int64() if n == "content_length" else pa.string()) for n, v in zip(names, values, strict=True)]
            yield pa.RecordBatch.from_arrays(out, names=[*[c for _, c, _ in kept], *names])

    return narrow.mapInArrow(run, ", ".join([*[f"{c} {kind}" for _, c, kind in kept], DERIVED]))


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def written(records: DataFrame) -> DataFrame:
    """``records`` of :func:`derivatives` as ``record``: the bytes of a WARC file, as UTF-8 text."""
    fields = (
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "linked_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"),
        ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    )
    head = [_field(n, F.col(c).cast("string")) for n, c in fields]
    return records.select(F.concat(F.lit("WARC/1.1\r\n"), *head, F.lit("\r\n"), "block", F.lit("\r\n\r\n")).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """One WARC file for each partition of ``records``, by Spark's text writer."""
    ended = F.expr("substring(record, 1, length(record) - 1)")  # the writer adds the last line feed
    written(records).select(ended).write.text(path)


def op1_linked_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and the conversion record of every row of ``pages``; see the module's text for nulls."""
    return derivatives(responses(table(spark, sf_dir, "pages")), keep=("page_id",))
