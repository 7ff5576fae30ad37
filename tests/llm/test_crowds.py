"""Crowds of near copies whose members are near to their common body rather than to each other."""

import random

import numpy as np
from test_near_copies import least_of_each

from weftline.llm import near_copies
from weftline.session import Kept


def crowd(members, length=150, most=5, seed=11):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(length)]
    texts = [base]
    for _ in range(members):
        t = list(base)
        for at in rng.sample(range(length), rng.randrange(1, most)):
            t[at] = f"w{rng.randrange(10**6)}"
        texts.append(t)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_parity_never_tells_more_apart_than_differs():
    rng = np.random.default_rng(3)
    for size in (0, 1, 7, 150, 5000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.r_[a[: size * 9 // 10], rng.integers(0, 1 << 63, size // 10, dtype=np.uint64)])
        differ = int(np.bitwise_count((near_copies.parity(a) ^ near_copies.parity(b)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b)) and (differ - len(np.setxor1d(a, b))) % 2 == 0


def test_a_crowd_by_rare_shingles_alone(spark):
    docs = crowd(120)
    sets = {i: near_copies.shingles(t.encode()) for i, t in docs}
    ids = {i: near_copies.set_id(s) for i, s in sets.items()}
    kept = Kept(spark)
    rows = [(ids[i], s.view(np.int64).tolist(), near_copies.parity(s).tolist()) for i, s in sets.items()]
    table = kept.write(spark.createDataFrame(rows, "sid long, shingles array<long>, bits array<long>"))
    left = kept.write(spark.createDataFrame([(s, s) for s in ids.values()], "sid long, root long"))
    made = []
    whole = near_copies.meeting
    near_copies.meeting = lambda *a: made.append(whole(*a)) or made[-1]
    try:
        star = near_copies.by_rare_shingles(None, left, table, kept)
    finally:
        near_copies.meeting = whole
    root = {i: i for i in ids.values()} | {r.u: r.root for r in star.collect()}
    assert len(set(root.values())) == len(least_of_each(docs))
    pairs = [kept.rows(t) for t in made]
    assert pairs[0] <= 30 * len(docs) and pairs[1] <= 2 * len(docs)
    kept.drop_all()


def test_nothing_left_is_nothing_to_do(spark):
    kept = Kept(spark)
    table = kept.write(spark.createDataFrame([], "sid long, shingles array<long>, bits array<long>"))
    left = kept.write(spark.createDataFrame([], "sid long, root long"))
    assert near_copies.by_rare_shingles(None, left, table, kept) is None
