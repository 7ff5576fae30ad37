"""Queries on documents and pages as files, over cases that the small tables don't have, beside their SQL."""

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.plans import registry

PAGES = ["<p>a &amp b &eacute; &#233; &amp;lt; &copy</p>", "<title>cut at &am</title><p>&quot;x&quot; y &middot; &copy; z</p>", "<script>&amp;</script>", ""]
TEXTS = [("en", "One line.  Two\twords \n\n\n\n end "), ("de", " \n "), ("de", ""), ("es", "x"), ("fr", "y"), ("it", "z " * 7000), (None, "no language"), ("en", "zwei\r\nZeilen")]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, *x) for i, x in enumerate(TEXTS)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def beside_sql(spark, name, folder, monkeypatch):
    def connect(folder):
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
        return con

    monkeypatch.setattr(oracle, "connect", connect)
    oracle.compare(registry.queries()[name](spark, folder), registry.oracle_sql()[name], folder)


def test_status_of_pages_with_cut_references(spark, folder, monkeypatch):
    beside_sql(spark, "extraction_status", folder, monkeypatch)


def test_visible_text_of_pages_with_cut_references(spark, folder, monkeypatch):
    rows = registry.queries()["html_visible_text"](spark, folder)
    assert {r.page_id: r.visible for r in rows.collect()}[0] == "a &amp b &eacute; &#233; &lt; &copy"


@pytest.mark.parametrize("name", ["plan_segments", "segment_table", "split_oversized", "sentence_units"])
def test_sentences_are_worked_out_once(spark, data, name):
    plan = registry.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("；;]") == 1


def test_bounded_text_is_normalised_once(spark):
    df = spark.createDataFrame([("a  b \n\n\n\n c",), (None,), ("x",)], "t string").select(T.bounded_text(F.col("t"), 4).alias("b"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count(r"(?U)[^\S") == 1
    assert [(r.b.text, r.b.truncated) if r.b.text is not None else None for r in df.collect()] == [("a b", True), None, ("x", False)]


def test_status_reads_every_text_whole(spark, tmp_path, monkeypatch):
    """Texts of every language, beyond 12000 bytes and 250000 characters, and pages with long tags, closed or not."""
    texts = [("es", "x y"), ("fr", "é" * 7000), ("en", "z " * 150_000), ("de", " \n "), (None, "a")]
    pages = ["<p>a</p>" * 3000, "<p>x</p> 1 <b " + "w " * 20_000, "<p>x</p><img alt=" + "w " * 20_000 + ">y", "<i>" * 5000]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r.origin, r.id): (r.method, r.status, r.text_characters, r.error) for r in registry.queries()["extraction_status"](spark, str(tmp_path)).collect()}
    assert [rows["document", i] for i in range(3)] == [("plain-text", "extracted", n, None) for n in (3, 7000, 299_999)]
    assert rows["document", 3] == ("plain-text", "manual-review-required", 0, None)
    assert [rows["page", i][1:] for i in range(4)] == [("extracted", 3000 * 3 - 2, None), ("extracted", len("x\n1 <b ") + 39_999, None), ("extracted", 3, None), ("manual-review-required", 0, None)]
    beside_sql(spark, "extraction_status", str(tmp_path), monkeypatch)
