"""Windows on hot keys: keys cut into ranges against plain Python, a third of all rows under one key."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import frames, intervals as I


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    keys = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, "c"])) for _ in range(3000)]
    places = rng.sample(range(100_000), len(keys))
    return [(k, p, rng.choice([None, 1.0, 2.0, 2.0, 5.0, float(rng.randrange(100))]), rng.choice(["x", "x", "x", "y", None]), float(p), float(p + rng.randrange(1, 90))) for k, p in zip(keys, places, strict=True)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, p long, v double, s string, a double, b double").repartition(5).cache()


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("most", [100, 10**6])
def test_frames(df, rows, most):
    wanted = {"place": frames.Frame("place"), "lag": frames.Frame("previous", F.col("v")), "lead": frames.Frame("next", F.struct("s")), "top": frames.Frame("max_before", F.col("v")), "sum": frames.Frame("sum_before", F.col("v"))}
    got = {r.p: r for r in frames.with_frames(df, ["k"], ["p"], wanted, most).collect()}
    assert len(got) == len(rows)
    for own in by_key(rows).values():
        for i, r in enumerate(own):
            before = [x[2] for x in own[:i] if x[2] is not None]
            g = got[r[1]]
            assert (g.k, g.place, g.lag) == (r[0], i + 1, own[i - 1][2] if i else None)
            assert (g.lead if g.lead is None else (g.lead.s,)) == ((own[i + 1][3],) if i + 1 < len(own) else None)
            assert g.top == max(before, default=None) and (g["sum"] == pytest.approx(sum(before)) if before else g["sum"] is None)


def test_a_range_at_most_in_a_task(spark, df, monkeypatch):
    """The hot key's rows are in many (key, range) groups, none of which is much larger than a range."""
    written = []
    write = frames.Kept.write
    monkeypatch.setattr(frames.Kept, "write", lambda self, d: written.append(write(self, d)) or written[-1])
    frames.with_frames(df, ["k"], ["p"], {"place": frames.Frame("place")}, 200).count()
    sizes = [r["count"] for r in written[1].groupBy("k", "__range").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 200 and sum(sizes) > df.count() * 0.9


@pytest.mark.parametrize("most", [50, 10**6])
def test_operators(df, rows, most):
    groups = by_key(rows)
    runs, gaps, steps, marks, falls, pairs, opens = {}, {}, set(), set(), set(), set(), set()
    for k, own in groups.items():
        best, at = (0, 0, None), 0
        for i in range(1, len(own) + 1):
            if i == len(own) or own[i][3] != own[at][3]:
                best = max(best, (i - at, -at, own[at][3]), key=lambda x: x[:2])
                at = i
        runs[k] = (best[2], best[0])
        covered = gap = 0.0
        for r in sorted(own, key=lambda r: (r[4], r[5])):
            gap, covered = max(gap, r[4] - covered), max(covered, min(r[5], 99_000.0))
        gaps[k] = max(gap if own else 0, 99_000.0 - covered)
        top = None
        for i, r in enumerate(own):
            if i and abs(r[4] - own[i - 1][5]) > 0.05:
                steps.add((r[1], "overlap" if r[4] < own[i - 1][5] else "gap"))
            if i and None not in (r[2], own[i - 1][2]) and r[2] < own[i - 1][2]:
                falls.add(r[1])
            if r[2] is not None:
                if top is not None and r[2] <= top:
                    marks.add(r[1])
                top = r[2] if top is None else max(top, r[2])
            if i:
                pairs.add((own[i - 1][1], own[i - 1][3], r[3]))
            if (i == 0) != (r[3] == "y"):
                opens.add((r[1], i + 1))
    assert {r.k: (r.run_value, r.run_length) for r in I.longest_run(df, ["k"], ["p"], "s", most).collect()} == runs
    in_time = df.where("a < 99000")
    got = {r.k: r.max_gap for r in I.max_gap(in_time, ["k"], F.col("a"), F.col("b"), F.lit(99_000.0), most=most).collect()}
    gaps_in_time = {k: g for k, g in gaps.items()}
    assert got.keys() == gaps_in_time.keys() and all(got[k] == pytest.approx(gaps_in_time[k]) or max(r[4] for r in groups[k]) >= 99_000 for k in got)
    assert {(r.p, r.status) for r in I.neighbours(df, ["k"], ["p"], F.col("a"), F.col("b"), most=most).collect()} == steps
    assert {r.p for r in I.not_strictly_increasing(df, ["k"], ["p"], "v", most).collect()} == marks
    assert {r.p for r in I.decreasing(df, ["k"], ["p"], "v", most).collect()} == falls
    assert {(r.p, r.s, r.next_value) for r in I.adjacent_pairs(df, ["k"], "p", "s", most).collect()} == pairs
    assert {(r.p, r.place) for r in I.first_row_rule(df, ["k"], "p", "s", ["y"], most).collect()} == opens


@pytest.mark.parametrize("most", [2, 100])
def test_exact_sequence(spark, most):
    rows = [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 1, "b"), (2, 0, "a"), (3, 0, "a"), (3, 1, "b"), (3, 2, "c"), (3, 3, "c"), (4, 0, None), (4, 1, "b"), (4, 2, "c"), (None, 5, "c"), (None, 4, "b"), (None, 3, "a")]
    got = I.exact_sequence(spark.createDataFrame(rows, "k int, p int, s string"), ["k"], "p", "s", ["a", "b", "c"], most).collect()
    assert {r.k: r.matches for r in got} == {1: True, 2: False, 3: False, 4: False, None: True}
