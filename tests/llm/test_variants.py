"""Spelling variants against all pairs of words, on the given documents and on odd tables."""

import re
import zlib
from collections import Counter, defaultdict

import fixtures
import pytest

from weftline.llm import queries, variants
from weftline.sources.tables import table


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def plain_variants(words):
    near, by = defaultdict(set), defaultdict(set)
    for w in words:  # words one edit apart share the word or one of its deletions
        for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by[v].add(w)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_edit(a, b)}
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda v: (-words[v], v))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def as_dict(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_query(spark, data):
    docs = [(r.doc_id, r.text) for r in table(spark, data, "documents").select("doc_id", "text").collect()]
    assert as_dict(queries.queries()["op13_spelling_variants"](spark, data)) == plain_variants(plain_counts(docs))


def test_chains_ties_and_crowds(spark):
    words = {"chainword": 1, "chainwort": 10, "chainwart": 100, "chainwarts": 1000, "tieword": 1, "tiewords": 10, "ttieword": 10, "aaaaaaa": 3, "aaaaaaaa": 3, "aaaaaaaaa": 30, "äöüßéèê": 5, "äöüßéèëê": 50}
    words |= {f"prefixes{chr(97 + i)}{chr(97 + j)}": 1 + i for i in range(20) for j in range(20)}
    got = as_dict(variants.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain_variants(words)
    assert got["chainword"][1] == "chainwarts" and got["tieword"][0] == "tiewords" and got["prefixesaa"][3] == 38


@pytest.mark.parametrize("clash", [False, True])
def test_odd_tables(spark, clash):
    docs = fixtures.odd(spark, clash).drop("n")
    expected = plain_counts([(r[0], r[1]) for r in fixtures.ROWS])
    assert as_dict(variants.variant_digest(docs)) == plain_variants(expected)
    assert variants.variant_digest(fixtures.none(spark)).count() == 0


def test_long_runs(spark):
    text = "Ab" * 700_000 + " " + "ab" * 700_000 + " abababab"
    got = variants.word_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), every=0).collect()
    assert sorted((len(r.word), r.n) for r in got) == [(8, 1), (1_400_000, 2)]
