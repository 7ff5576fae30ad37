"""Levels of recordings in blocks, and points and spans in bins of time, against plain Python."""

import random

from pyspark.sql import functions as F

from weftline.operators import intervals as I, levels


def test_blocks_as_one_array(spark):
    rng = random.Random(3)
    rows = [(k, i, [float(rng.randrange(-32768, 32768)) for _ in range(n)]) for k, sizes in {"a": [100, 0, 7, 400], "b": [1], "silent": [0, 0]}.items() for i, n in enumerate(sizes)] + [("null", 0, None), ("quiet", 0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "k string, i int, s array<double>")
    whole = spark.createDataFrame([(k, [x for r in rows if r[0] == k for x in r[2] or []]) for k in {r[0] for r in rows}], "k string, s array<double>")
    got = {r.k: r[1:] for r in levels.block_levels(df.repartition(3), ["k"], F.col("s")).collect()}
    assert got == {r.k: (r.n_samples, r.rms_dbfs, r.peak_dbfs, r.clipped_ratio) for r in levels.audio_levels(whole, F.col("s")).collect()}


def test_points_and_spans(spark):
    rng = random.Random(6)
    points = [(i, "hot" if rng.random() < 0.5 else "x", rng.uniform(-50, 200)) for i in range(400)]
    spans = [(i, "hot" if rng.random() < 0.5 else "x", a, a + rng.choice([0.0, 0.5, 10.0, 10.0, 90.0])) for i, a in enumerate(rng.uniform(-60, 200) for _ in range(200))]
    spans += [(900, "x", 5.0, 1.0), (901, "hot", 10.0, 20.0), (902, "hot", 20.0, 30.0)]
    p = spark.createDataFrame(points, "p int, k string, at double")
    s = spark.createDataFrame(spans, "s int, k string, a double, b double")
    t = s.select(F.col("s").alias("t"), "k", F.col("a").alias("c"), F.col("b").alias("d"))
    for width in (7.0, 10.0, 1000.0):
        got = [(r.p, r.s) for r in I.points_in_spans(p, s, ["k"], "at", "a", "b", width).collect()]
        assert sorted(got) == sorted((i, j) for i, k, at in points for j, own, a, b in spans if k == own and a <= at < b)
        got = [(r.s, r.t) for r in I.overlapping_spans(s, t, ["k"], "a", "b", "c", "d", width).collect()]
        real = [x for x in spans if x[3] > x[2]]
        assert sorted(got) == sorted((i, j) for i, k, a, b in real for j, own, c, d in real if k == own and max(a, c) < min(b, d))
