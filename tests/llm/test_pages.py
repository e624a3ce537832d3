"""Pages that go against the usual marks of what is and what is no article; charsets that make no text."""

import encodings.aliases
import html
import re

import pytest

from barsmith.llm import html_extraction, warc

TEXT = [f"Paragraph {k} of the article, long enough, with commas, to be read as prose by anyone who looks at it here." for k in range(1, 5)]
PARAGRAPHS = "".join(f"<p>{t}</p>" for t in TEXT)
OTHER = "<p>Another text of some length, with commas, too, which is not what this page is about at all, as you see.</p>"


@pytest.mark.parametrize(("page", "want"), [
    (f"<form id='aspnetForm' action='x'><div id='page'><nav>menu</nav><div>{PARAGRAPHS}</div></div><input><label>Your name</label><button>Go</button></form>", TEXT),
    (f"<form><header>Site</header><article><h1>Head</h1>{PARAGRAPHS}</article><div class='sidebar'>{OTHER}</div></form>", ["Head", *TEXT]),
    (f"<div class='right-sidebar'><h1>Head</h1>{PARAGRAPHS}</div>", ["Head", *TEXT]),
    (f"<div class='share-page-content widget-content'><h1>Head</h1>{PARAGRAPHS}</div><div class='widget'>stray</div>", ["Head", *TEXT]),
    (f"<article><h1>Head</h1>{PARAGRAPHS}<article class='comment'>{OTHER}</article><div class='comments'>{OTHER * 9}</div></article>", ["Head", *TEXT]),
    (f"<article><h1>Head</h1>{PARAGRAPHS}<form><p>Write to us, whoever you are, and tell us at length what you think of all this, please do.</p></form></article>", ["Head", *TEXT]),
    (f"<div class='story'><h1>Head</h1>{PARAGRAPHS}</div><section id='comments'>{OTHER * 30}</section>", ["Head", *TEXT]),
    (f"<div class='cookie-notice'>{OTHER * 2}</div><div class='story'>{PARAGRAPHS}</div>", TEXT),
    (f"<div class='cookie-notice'><div>{TEXT[0]}</div></div>", []),
    ("<form><input><p>Search the site.</p></form>", []),
    ("", []),
])
def test_what_is_left_of_a_page(page, want):
    found = html_extraction.main_text(f"<html><body>{page}</body></html>")
    assert found.split("\n") == want if want else found == ""


@pytest.mark.parametrize("name", ["div class='content'", "div class='page-body'", "div", "section class='story'", "div class='post sidebar-right'", "form", "div class='main-widget'"])
def test_pages_without_an_article(spark, data, name):
    """The texts of the given pages are what stands in their articles; here the article is called otherwise."""
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    right = 0
    for r in pages:
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h\d|div|li|ul)[^>]*>", article)]
        page = r["html"].replace("<article>", f"<{name}>").replace("</article>", f"</{name.split()[0]}>")
        right += html_extraction.main_text(page) == "\n".join(b for b in want if b)
    assert right >= 0.9 * len(pages), (right, len(pages))


CODECS = sorted({*encodings.aliases.aliases.values(), "idna", "punycode", "undefined", "unicode_escape", "raw_unicode_escape", "utf_7", "utf_8_sig", "utf_16_be", "utf_32", "rot13", "hex", "no-such"})


def test_any_charset_gives_text(spark):
    payload = "<html><title>T \\ud800 \\U0001f600</title><a href='x'>caf\u00e9</a> +2AA-+2D3eAA- \\x41 \\</html>".encode() + bytes(range(256))
    rows = [(k, None, f"http://x/{c}", "d", f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={c}\r\n\r\n", bytearray(payload), None, None) for k, c in enumerate(CODECS)]
    df = spark.createDataFrame(rows, "page_id long, record_id string, target_uri string, warc_date string, http_headers string, payload binary, block_digest string, payload_digest string")
    got = warc.derivatives(df, keep=("page_id",)).collect()
    assert len(CODECS) > 90 and len(got) == 2 * len(CODECS)
    assert all("\ud800" not in (r["block"] or "") for r in got)


def test_halves_of_pairs_are_joined_or_replaced():
    assert warc.decoded(b"+2AA- +2D3eAA-", "text/html; charset=utf-7") == "\ufffd \U0001f600"
    assert warc.decoded(b"\\ud83d\\ude00 \\ud800", "text/plain; charset=raw_unicode_escape") == "\U0001f600 \ufffd"
