"""Nulls, empty texts and tables, repeated rows, ties, very long texts and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from barsmith.llm import compression, decontamination, html_extraction, jaccard_join, language_id, licenses, mixing, perplexity, sharding, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma, delta! " * 20_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it all", "en", "a", 10),
    (1, "the quick brown fox jumps over the lazy dog and runs away from it all", "en", "a", 10),
    (2, None, None, None, None), (3, "", "en", "b", 0), (None, "le chien et le chat sont dans la maison avec les enfants", "fr", "b", 3),
    (4, LONG, "en", "a", len(LONG)), (5, "### $$$ 123", "en", None, 5), (6, "le chien est dans la rue et le chat aussi", "fr", "b", 3), (6, "another text under one id, quite different", "en", "b", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in ("score", "shard", "slot", "component_id", "copies", "_text", "label", "n")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs away"), (2, None), (3, ""), (4, "gamma delta"), (None, "chien et")], "item_id long, text string")


def test_mixing(docs, empty):
    got = mixing.copies(docs)
    assert got.agg(F.sum("m")).first()[0] == len(ROWS)
    assert got.where("whole + CAST(extra > 0 AS int) > 3 OR whole < 0 OR extra < 0 OR extra > m").count() == 0
    assert got.where("source IS NULL").count() == 2
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.copies(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_sharding(docs, empty):
    rows = sharding.shard_assignment(docs, 4)
    assert rows.count() == len(ROWS)
    assert rows.select("shard", "slot").distinct().count() == len(ROWS)
    full = sharding.shard_records(docs, 4)
    assert full.columns[-2:] == ["shard", "slot"] and full.count() == len(ROWS) and len(full.columns) == len(docs.columns)
    assert sharding.shard_assignment(empty).count() == 0 and sharding.shard_records(empty).count() == 0


def test_decontamination(docs, empty, items):
    got = {r["doc_id"]: r for r in decontamination.contamination(docs, items).collect()}
    assert got[1]["n_hit"] == 10 + 1 and got[1]["item_ids"] == ["1"]
    assert got[2]["n_words"] == 0 and not got[2]["contaminated"] and got[3]["n_items"] == 0
    assert got[4]["n_hit"] == 40_000  # a short item is a window of its own
    assert got[None]["n_hit"] == 2 and got[None]["n_items"] == 0
    unnamed = decontamination.contamination(docs, items.where("item_id IS NULL").unionByName(items.where("item_id = 1").withColumn("text", F.lit("Maison AVEC")))).where("doc_id IS NULL").first()
    assert (unnamed["n_hit"], unnamed["n_items"], unnamed["item_ids"]) == (4, 1, ["1"])  # a null id hits, without a name
    kept = decontamination.clean_documents(docs, items)
    assert kept.columns == docs.columns and kept.where("doc_id IN (1, 4) OR doc_id IS NULL").count() == 0 and kept.count() == len(ROWS) - 4
    assert decontamination.clean_documents(docs, items.limit(0)).count() == len(ROWS)
    assert decontamination.contamination(empty, items).count() == 0


def test_perplexity(docs, empty):
    got = perplexity.judged(docs)
    assert got.count() == len(ROWS)
    assert got.where("doc_id IN (2, 3)").agg(F.max(F.col("kept").cast("int"))).first()[0] == 0
    assert perplexity.judged(empty).count() == 0


def test_licenses(docs, empty):
    got = licenses.licenses(docs)
    assert got.count() == len(ROWS) and got.where("labels <> '' OR n_base > 0").count() == 0
    assert got.where("first_word IS NULL").count() == len(ROWS)
    assert licenses.licenses(empty).count() == 0


def test_compression(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (6, 1, None), (6, 0, None), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = compression.fit(docs, labels)
    got = compression.with_quality(docs, model)
    assert got.count() == len(ROWS) and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert compression.fit(docs, labels.limit(0)) == 0.5 and compression.fit(empty, labels) == 0.5
    assert compression.with_quality(empty, 0.5).count() == 0


def test_jaccard(docs, empty):
    got = jaccard_join.similarity_classes(docs)
    assert got.count() == len(ROWS)
    assert {r["n_shingles"] for r in got.where("doc_id IN (2, 3)").collect()} == {0}
    assert got.where("doc_id = 1 AND component_id = 1").count() == 2
    kept = jaccard_join.deduplicated(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 6").count() == 2
    assert kept.count() == len(ROWS) - 1
    assert jaccard_join.similarity_classes(empty).count() == 0 and jaccard_join.deduplicated(empty).count() == 0


def test_language(docs, empty):
    model = language_id.fit(docs)
    got = language_id.with_language(docs, model)
    und = {r["doc_id"] for r in got.where("lang_pred = 'und'").collect()}
    assert und == {2, 3, 5} and got.where("lang_pred = 'und' AND score <> 0").count() == 0
    assert got.where("lang_pred NOT IN ('en', 'fr', 'und')").count() == 0
    none = language_id.fit(empty)
    assert language_id.with_language(docs, none).where("lang_pred <> 'und'").count() == 0
    assert language_id.with_language(empty, none).count() == 0


def test_known_language(docs, empty):
    model = language_id.fit(docs)
    kept = language_id.in_known_language(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.where("doc_id IN (2, 3, 5)").count() == 0
    assert kept.where("doc_id = 1").count() == 2 and kept.where("doc_id IS NULL").count() == 1
    none = language_id.fit(empty)
    assert language_id.in_known_language(docs, none, 0.0).count() == 0
    assert language_id.in_known_language(empty, model, 0.0).count() == 0 and language_id.in_known_language(empty, none, 0.0).count() == 0


PAGES = [(1, "http://x/", None), (2, None, ""), (3, "u", "<p>a<p>b &lt;c&gt; &#233;"), (3, "u", "<p>a<p>b &lt;c&gt; &#233;"), (None, "v", "plain < text"), (4, "w", "<div>" * 3000 + "deep" + "<p>x" * 5000)]


def test_html(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("text", F.lit(0))
    got = html_extraction.extracted(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(PAGES)
    assert {(r["text"], r["n_chars"]) for r in got.where("page_id IN (1, 2)").collect()} == {("", 0)}
    assert {r["text"] for r in got.where("page_id = 3").collect()} == {"a\nb <c> é"}
    assert got.where("page_id = 4").first()["n_chars"] > 9000
    assert html_extraction.extracted(pages.limit(0)).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("block", F.lit(0))
    got = warc.derivatives(warc.responses(pages), keep=("page_id",))
    assert got.count() == 2 * len(PAGES)
    assert got.where("record_type = 'conversion' AND page_id = 1").first()["block"] == ""
    assert got.where("page_id = 3 AND record_type = 'conversion'").first()["block"] == "a\nb <c> é"
    assert got.where("record_id = refers_to").count() == 0
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0
