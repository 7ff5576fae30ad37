"""The pipeline's near-copy stage against all pairs."""

import glob
import random

import corpus_pipeline
import numpy as np

from weftline.llm import near_copies
from weftline.session import Kept, shared_dir
from weftline.sources.tables import table


def least_of_each(docs):
    """Smallest id of each component of all pairs with a similarity of 0.8 or more."""
    words = [(i, t.encode().lower().split()) for i, t in docs]
    sets = [(i, set(zip(*[w[k:] for k in range(5)])) if len(w) > 5 else {tuple(w)} if w else set()) for i, w in words]
    root = {i: i for i, _ in sets}
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if 5 * len(a & b) >= 4 * len(a | b) and (a or not b):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return sorted({r for r in root.values()})


def planted():
    """Texts with copies in which words are replaced, from nearly the same to well below the bound, and a crowd of near copies."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(50_000)}"
    texts = []
    for copies, length, most in [(1, rng.randrange(60, 400), 12) for _ in range(60)] + [(60, 300, 9)]:
        base = [word() for _ in range(length)]
        texts.append(base)
        for _ in range(copies):
            t = list(base)
            for at in rng.sample(range(length), rng.randrange(1, most)):
                t[at] = word()
            texts.append(t)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_planted_copies(spark):
    docs = planted()
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert kept.columns == ["doc_id", "text"]
    assert sorted(r.doc_id for r in kept.collect()) == least_of_each(docs)


def test_shingles():
    a = near_copies.shingles(b"A b c d e f g")
    assert len(a) == 3 and (a == near_copies.shingles(b"a B c d e F g")).all() and len(np.unique(near_copies.bands(a))) == near_copies.BANDS
    assert len(near_copies.shingles(b"a b")) == 1 and len(near_copies.shingles(None)) == 0


def plain_roots(edges):
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {k: low if r == high else r for k, r in root.items()}
    return {k: r for k, r in root.items() if k != r}


def test_stars_in_one_task_and_in_many(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 320), rng.randrange(200, 320)) for _ in range(90)] + [(7, 7), (1, 0)]
    df = spark.createDataFrame(edges, "u long, v long")
    for few in (0, 10, 1000):
        got = near_copies.stars(df, Kept(spark), few).collect()
        assert {r.u: r.root for r in got} == plain_roots(edges) and len({r.u for r in got}) == len(got)
    assert near_copies.stars(df.limit(0), Kept(spark)).count() == 0


def test_few_jobs_and_nothing_left(spark, data):
    tracker, group = spark.sparkContext.statusTracker(), "near-copies"
    docs = table(spark, data, "documents")
    before = set(glob.glob(f"{shared_dir(spark)}/kept-*/*"))
    spark.sparkContext.setJobGroup(group, group)
    out = near_copies.deduplicated(docs)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 120
    assert len(set(glob.glob(f"{shared_dir(spark)}/kept-*/*")) - before) <= 1  # the rows to leave out, which the result reads
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == least_of_each([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
