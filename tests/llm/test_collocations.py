"""Phrases against counts over all windows; the index against plain suffixes; odd tables. The query has SQL (test_oracle.py)."""

import re
from collections import Counter

import fixtures
import numpy as np
import pytest

from weftline.llm import collocations


def plain_counts(rows, least, depth):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lower = "".join(c.lower() if c < "\x80" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang or "und"] += len(words)
            for m in range(1, depth + 1):
                f.update((lang or "und", tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    return n, {k: v for k, v in f.items() if v >= least}


def plain_collocations(rows, least, depth, most, cover):
    n, f = plain_counts(rows, least, depth)
    out = []
    for (lang, p), a in f.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if len(p) < 2 or any(lg == lang and len(q) > len(p) and 100 * b >= cover * a and inside(q) for (lg, q), b in f.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(own[:most], 1)]
    return sorted(ranked)


def texts(seed, rows=60):
    rng = np.random.default_rng(seed)
    words = ["a", "b", "Cc", "d d", "É", "é", "w\x1cx", "z"]
    text = lambda: "".join(rng.choice(words) + str(rng.choice([" ", "  ", "\t", ". ", "\n", " ! "], p=[0.6, 0.1, 0.1, 0.08, 0.06, 0.06])) for _ in range(rng.integers(0, 60)))
    return [(["en", "de", None][rng.integers(3)], text()) for _ in range(rows)]


@pytest.mark.parametrize("cover", [100, 60])
@pytest.mark.parametrize("shard_words", [40, 2_000_000])
def test_against_windows(spark, monkeypatch, shard_words, cover):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard_words)
    rows = texts(shard_words + cover)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.collocations(docs, least=4, depth=4, most=25, cover=cover).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(rows, 4, 4, 25, cover)


@pytest.mark.parametrize("depth", [2, 3, 5, 7])
def test_index_orders_suffixes(depth):
    rng = np.random.default_rng(depth)
    tokens = np.r_[rng.integers(0, 5, 300), 0].astype(np.int32)
    order = collocations.suffix_order(tokens, depth)
    around = np.r_[tokens, tokens].tolist()
    keys = [around[i : i + depth] for i in order.tolist()]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(tokens)))


def test_long_text_is_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_WORDS", 1000)
    monkeypatch.setattr(collocations, "SLICE", 64)
    rows = [("en", "one two three. " * 3000 + "four five " * 1500)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = collocations.collocations(docs, least=100, depth=3).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(rows, 100, 3, 2000, 100)


def test_ranks_in_salted_parts(spark):
    rows = spark.range(1000).selectExpr("if(id % 3 = 0, 'b', 'a') lang", "id % 50 score", "cast(id as string) phrase")
    order = ["score desc", "phrase"]
    from pyspark.sql import functions as F

    got = collocations.top_ranked(rows, "lang", [F.desc("score"), F.asc("phrase")], 40, room=120).collect()
    assert len(got) == 80 and {r["rank"] for r in got} == set(range(1, 41))
    plain = rows.selectExpr("*", f"row_number() over (partition by lang order by {', '.join(order)}) rank").where("rank <= 40").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain))


@pytest.mark.parametrize("clash", [False, True])
def test_odd_tables(spark, clash):
    docs = fixtures.odd(spark, clash)
    rows = [(r[2], r[1]) for r in fixtures.ROWS]
    got = collocations.collocations(docs, least=2, depth=3, most=50).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(rows, 2, 3, 50, 100)
    assert collocations.collocations(fixtures.none(spark)).count() == 0
