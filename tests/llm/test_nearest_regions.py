"""Regions and near-ties of the nearest-neighbour search, against brute force."""

import numpy as np
import pytest

from weftline.llm import ann


def brute(rows, queries, k):
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    out = {}
    for i, x in queries:
        s = ann.cosines(np.repeat(np.array([x], float), len(v), axis=0), v)
        s[ids == i] = -np.inf
        order = np.lexsort((ids, -s))[:k]
        out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, [float(y) for y in x], "mine", 1) for i, x in rows], "vec_id long, embedding array<double>, region string, score int")


def test_multiples(spark):
    """Scores that differ by rounding alone still order as the measure says."""
    rng = np.random.default_rng(0)
    base = rng.normal(size=16)
    rows = [(i, base * (1 + i / 7)) for i in range(40)] + [(40 + i, rng.normal(size=16)) for i in range(60)]
    queries = rows[:1] + rows[50:51]
    assert got(ann.nearest(table(spark, rows), table(spark, queries), 5)) == brute(rows, queries, 5)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_regions(spark, spread):
    """Clusters and a cloud, in many regions, with a crowd of equal vectors that fills a region alone."""
    rng = np.random.default_rng(int(spread * 100))
    centres = rng.normal(size=(12, 8))
    rows = [(i, centres[i % 12] + spread * rng.normal(size=8)) for i in range(600)] + [(600 + i, centres[0]) for i in range(200)]
    queries = rows[::20]
    assert got(ann.nearest(table(spark, rows), table(spark, queries), 5, shard_rows=50, block_rows=16)) == brute(rows, queries, 5)


def test_regions_left_out():
    """Among clusters far apart a query meets few regions; each region that holds something near is among them."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    v = centres[rng.integers(0, 30, 3000)] + 0.05 * rng.normal(size=(3000, 16))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    tree = ann.regions(unit[:1000], 24, np.random.default_rng(1))
    homes = ann.at_home(tree, unit)
    cosine = unit[:100] @ unit.T
    kth = np.sort(cosine, axis=1)[:, -6]
    visits = {(int(q), region) for rows, region in ann.within(tree, unit[:100], np.arange(100), ann.reach(kth, 1.0)) for q in rows}
    assert len(visits) < 0.5 * 100 * len(set(homes.tolist()))
    assert all((q, homes[j]) in visits for q in range(100) for j in np.flatnonzero(cosine[q] >= kth[q]))


def test_very_large_and_very_small_components(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 2e200]), (2, [1e-200, 1e-200]), (3, [3.0, 1.0]), (4, [5e-324, 0.0]), (5, [0.0, 0.0]), (6, [-1e308, 1e308])]
    plain = [(0, [1.0, 0.0]), (1, [1.0, 2.0]), (2, [1.0, 1.0]), (3, [3.0, 1.0]), (4, [1.0, 0.0]), (6, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, want = got(ann.nearest(df, df, 3)), brute(plain, plain, 3)
    assert {q: [i for i, _ in near] for q, near in found.items()} == {q: [i for i, _ in near] for q, near in want.items()}
    assert all(abs(a - b) < 1e-12 for q in want for (_, a), (_, b) in zip(found[q], want[q], strict=True))
