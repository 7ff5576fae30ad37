"""The language model keeps n-grams that were seen once."""

import math

import pytest

from weftline.llm import lm_trie


def test_seen_once(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_trie.score(docs, lm_trie.train(docs)).collect()}
    step = lambda p: 10 ** (-lm_trie.STEP * math.ceil(-math.log10(p) / lm_trie.STEP - 1e-9))
    half, quarter, unigram = step(0.5), step(0.25), lambda n: (n + 0.1) / (7 + 0.1 * 7)
    pair = lambda n: half + (1 - half) * unigram(n)
    first = quarter + (1 - 2 * quarter) * unigram(1)
    triple = lambda n: half + (1 - half) * pair(n)
    assert got[1] == pytest.approx(math.log10(first * triple(1) ** 2 * triple(2)), rel=1e-9)
    assert got[2] == pytest.approx(math.log10(first * triple(1) * triple(2)), rel=1e-9)
