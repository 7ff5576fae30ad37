"""Every operator over the odd tables: no crash, every row accounted for, defined results."""

import fixtures
import pytest
from pyspark.sql import functions as F

from weftline.llm import ann, lm_trie, media, mixing, packing, quality, secret_scan, simhash, toxicity, url_filter

N = len(fixtures.ROWS)
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(params=["odd", "clash", "none"])
def docs(spark, request):
    return fixtures.none(spark) if request.param == "none" else fixtures.odd(spark, request.param == "clash")


def rows(df):
    got = df.collect()
    return len(got), got


def labels(spark, empty=False):
    return spark.createDataFrame([] if empty else [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (7, 0, 1), (8, 1, 0)], LABELS)


def test_lm(docs):
    n, got = rows(lm_trie.lm_digest(docs))
    assert n == docs.count()
    for r in got:
        assert r.n_tokens >= 1 and r.score <= 1e-9 and r.base_score <= 1e-9
        if r.doc_id in (3, 4, 5):
            assert r.n_tokens == 1
    whole = lm_trie.score(docs, lm_trie.train(docs))
    assert whole.count() == docs.count() and len(set(whole.columns)) == len(whole.columns)


def test_urls(spark):
    captures = spark.createDataFrame([(1, "http://a.b.com/x/y?q", 100), (1, "http://a.b.com/x/y?q", 100), (2, None, 5), (3, "no url", 5), (4, "https://u@B.com:80", None), (5, "http://b.com/", 86_400 * 3)], "page_id long, url string, fetched_at long")
    entries = spark.createDataFrame([("b.com", 50, "block"), ("a.b.com", 90, "allow"), ("a.b.com", 100, "off"), ("b.com", 86_400 * 2, "off"), ("b.com", 86_400 * 2 + 5, "block"), (None, 1, "block"), ("x", None, "block"), ("b.com", 50, "allow")], "key string, effective_at long, action string")
    n, got = rows(url_filter.filter_urls(captures, entries))
    assert n == 6
    by = {r.page_id: r for r in got}
    assert (by[1].verdict, by[1].matched_key, by[1].listed_at) == ("block", "b.com", 50)
    assert by[2].verdict == by[3].verdict == by[4].verdict == "unlisted" and by[4].host == "b.com"
    assert (by[5].verdict, by[5].listed_at) == ("block", 86_400 * 2 + 5)
    assert url_filter.filter_urls(captures.limit(0), entries).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(captures, entries.limit(0)).collect()} == {"unlisted"}


def test_secrets(docs):
    n, got = rows(secret_scan.secret_digest(docs))
    assert n == docs.count()
    for r in got:
        assert (r.n_assign, r.spans[:6]) == ((1, "assign") if r.doc_id == 7 else (0, ""))
    assert secret_scan.find_secrets(docs).count() == n
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns
    assert "hunter22xyz" not in "".join(r.text or "" for r in clean.collect())


def test_mixing(docs):
    out = mixing.replicate(docs, mixing.temperature_rates(docs))
    assert out.columns[-2:] == ["copy_no", "shuffle_key"] and len(set(out.columns)) == len(out.columns)
    n, got = rows(out)
    again = sorted((r.doc_id or -1, r.copy_no, r.shuffle_key) for r in mixing.replicate(docs.repartition(3), mixing.temperature_rates(docs)).collect())
    assert again == sorted((r.doc_id or -1, r.copy_no, r.shuffle_key) for r in got)


def test_packing(docs):
    n, got = rows(packing.pack_documents(docs))
    assert len({r.doc_id for r in got}) == len({r.doc_id for r in docs.select("doc_id").collect()})
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_simhash(docs):
    n, got = rows(simhash.simhash_digest(docs))
    assert n == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    if n:
        assert by[1][0].component_id == by[2][0].component_id == 1 and len(by[2]) == 2
        assert by[3][0].fingerprint == "0" * 16 and by[3][0].component_id == by[4][0].component_id == by[5][0].component_id == 3
    kept = sorted(r.doc_id or 0 for r in simhash.deduplicated(docs).collect())
    assert kept == ([0, 1, 3, 6, 7, 8] if n else [])


def test_toxicity_and_quality(spark, docs):
    for module, digest in ((toxicity, toxicity.toxicity_digest), (quality, quality.quality_digest)):
        for empty in (False, True):
            n, got = rows(digest(docs, labels(spark, empty)))
            assert n == docs.count()
            assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)
    kept = toxicity.without_toxic(docs.drop("score", "predicted"), labels(spark, True))
    assert kept.count() == docs.count()


def test_nearest(spark):
    inf = float("inf")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [1.0, inf]), (50, [1.0, 0.0]), (51, [0.0, 1.0]), (52, [1.0, 1.0, 1.0]), (100, []), (None, [1.0, 0.0]), (51, [0.0, 1.0])], "vec_id long, embedding array<float>")
    n, got = rows(ann.nearest_digest(vectors))
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert [x[1] for x in sorted(by[0])] == [1, 2, 50, 51, 51]
    assert [x[1] for x in sorted(by[50])] == [0, 1, 2, 51, 51]
    assert set(by) == {0, 50}
    assert ann.nearest_digest(vectors.limit(0)).count() == 0


def test_media(docs):
    n, got = rows(media.media_digest(docs))
    assert n == docs.count()
    for r in got:
        text = next((t or "").encode() for i, t, *_ in fixtures.ROWS if i == r.doc_id)
        assert (r.n_bytes, r.payload_bytes) == (len(text), max(576, -(-len(text) // 576) * 576))
    junk = docs.select("doc_id", F.lit(bytearray(b"\xff\xd8 not an image")).alias("media"))
    assert {r.thumb for r in media.inspect(junk).collect()} <= {None}


def test_target_weights(spark):
    """Sources meet given weights on average; a source without a weight, or with a negative one, gets no copies."""
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('x', 10) as text", "'en' as lang", "case when id < 2000 then 'a' when id < 2900 then 'b' else 'c' end as source", "10L as n_chars")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("d", 5.0), ("c", -1.0)], "source string, weight double")
    rates = {r.source: r.rate for r in mixing.weight_rates(docs, weights).collect()}
    assert rates == {"a": pytest.approx(0.25 * 30000 / 20000), "b": pytest.approx(0.75 * 30000 / 9000), "c": 0.0}
    counts = {r.source: r["count"] for r in mixing.replicate(docs, mixing.weight_rates(docs, weights)).groupBy("source").count().collect()}
    assert set(counts) == {"a", "b"} and counts["a"] == pytest.approx(750, rel=0.15) and counts["b"] == pytest.approx(2250, rel=0.1)
    large = mixing.replicate(docs.limit(50), spark.createDataFrame([("a", 1000.0)], "source string, rate double"))
    assert large.count() == pytest.approx(50_000, rel=0.02)
