"""Value functions, checks and intervals on inline rows: a row that passes and one that fails."""

import pytest
from pyspark.sql import Row, functions as F

from weftline.functions import values as V
from weftline.operators import checks as C, intervals as I, levels, listing as L


def value(spark, column, **cells):
    return spark.createDataFrame([Row(**cells)]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, ok", [("2024-01-02T03:04:05+08:00", True), ("2024-01-02T03:04:05Z", True), ("2024-01-02T03:04:05", False), ("x", False)])
def test_timestamps(spark, text, ok):
    assert value(spark, V.valid_ts(F.col("t")), t=text) is ok


@pytest.mark.parametrize("text, ok", [("2026-02-28", True), ("2026-02-30", False), ("2026-2-3", False), ("2026-02-28T00:00:00Z", False)])
def test_days(spark, text, ok):
    assert value(spark, V.valid_day(F.col("t")), t=text) is ok


@pytest.mark.parametrize("url, ok, origin", [("https://Example.com:443/a", True, "https://example.com"), ("http://u@h/", False, "http://h"), ("ftp://h/", False, "ftp://h"), ("http://h:8080", True, "http://h:8080"), ("not a url", False, None)])
def test_urls(spark, url, ok, origin):
    assert value(spark, V.valid_http_url(F.col("u")), u=url) is ok
    assert value(spark, V.url_origin(F.col("u")), u=url) == origin


def test_shapes(spark):
    assert value(spark, V.ratio_matches(F.col("r"), F.lit(1080), F.lit(1920)), r="9:16") is True
    assert value(spark, V.ratio_matches(F.col("r"), F.lit(1080), F.lit(1920)), r="9/16") is False
    assert value(spark, V.frame_rate(F.col("r")), r="30000/1001") == pytest.approx(29.97, abs=0.01)
    assert value(spark, V.same_rate(F.col("r"), 25), r="30/1") is False
    box = F.struct(F.lit(10).alias("x"), F.lit(10).alias("y"), F.lit(80).alias("width"), F.lit(80).alias("height"))
    assert value(spark, V.box_in_canvas(box, F.lit(100), F.lit(100), F.lit(10)), a=1) is True
    assert value(spark, V.box_in_canvas(box, F.lit(100), F.lit(100), F.lit(11)), a=1) is False
    assert value(spark, V.rotation(F.lit(-90)), a=1) == 270


def test_paths_ids_layers(spark):
    assert value(spark, V.safe_rel_path(F.col("p"), "out"), p="out/a.png") is True
    for bad in ("/out/a", "out/../a", "in/a", ""):
        assert value(spark, V.safe_rel_path(F.col("p"), "out"), p=bad) is False
    assert value(spark, V.valid_id_array(F.col("a")), a=["x", "y"]) is True
    for bad in (["x", "x"], ["x", "　"]):
        assert value(spark, V.valid_id_array(F.col("a")), a=bad) is False
    assert value(spark, V.layered(F.lit(0), F.lit(4)), a=1) == 0
    assert value(spark, V.layered(F.lit(0), F.lit(4), zero_is_unset=True), a=1) == 4


def test_gap_run_order(spark):
    rows = spark.createDataFrame([("a", 0.0, 2.0, "x"), ("a", 6.06, 8.0, "x"), ("b", 0.0, 20.0, "y")], "g string, s double, e double, k string")
    gap = {r.g: r.max_gap for r in I.max_gap(rows, ["g"], F.col("s"), F.col("e"), F.lit(10.0)).collect()}
    assert gap == {"a": pytest.approx(4.06), "b": 0.0}
    none = {r.g: r.max_gap for r in I.max_gap(rows, ["g"], F.col("s"), F.col("e"), F.lit(10.0), F.col("k") == "y").collect()}
    assert none == {"a": 10.0, "b": 0.0}
    steps = {(r.status, round(r.seconds, 2)) for r in I.neighbours(rows, ["g"], ["s"], F.col("s"), F.col("e")).collect()}
    assert steps == {("gap", 4.06)}
    runs = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabbbcca")], "g int, i int, v string")
    assert I.longest_run(runs, ["g"], ["i"], "v").first()[:] == (1, "b", 3)
    marks = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 3, 2, 2, 4])], "g int, i int, v int")
    assert [r.i for r in I.not_strictly_increasing(marks, ["g"], ["i"], "v").orderBy("i").collect()] == [2, 3]
    assert [r.i for r in I.decreasing(marks, ["g"], ["i"], "v").collect()] == [2]
    pairs = spark.createDataFrame([(1, "a", "a"), (1, "z", "b")], "g int, from_id string, to_id string")
    assert {r.status for r in I.check_adjacent(runs, pairs, ["g"], "i", "v").collect()} == {"missing", "not_adjacent"}


def test_listing_windows(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 15:59:59", "2024-01-01 15:59:59"), (2, "2024-01-01 16:00:00", "2024-01-01 17:00:00"), (3, None, None)], "id int, s string, e string").withColumns({c: F.col(c).cast("timestamp") for c in "se"})
    now = F.lit("2024-01-01 18:00:00").cast("timestamp")
    assert [r.id for r in L.time_filter(rows, F.col("s"), F.col("e"), now, date="2024-01-02").collect()] == [2]
    assert [r.id for r in L.time_filter(rows, F.col("s"), F.col("e"), now, time_range="next7").collect()] == [2]
    assert {r.id for r in L.time_filter(rows, F.col("s"), F.col("e"), now, date_from="2024-01-01", date_to="2024-01-02").collect()} == {1, 2}
    with pytest.raises(ValueError):
        L.time_filter(rows, F.col("s"), F.col("e"), now, date="2024-01-02", time_range="next7")
    with pytest.raises(ValueError):
        L.time_filter(rows, F.col("s"), F.col("e"), now, date_from="2023-01-01", date_to="2024-01-02")
    assert L.page(rows, [F.col("id")], number=9).count() == 0
    assert L.page_totals(rows, number=9).first()[:] == (3, 9, 20, False)


def test_levels(spark):
    rows = spark.createDataFrame([("a", [0, 0]), ("b", [32767, -32767]), ("c", [])], "id string, s array<int>")
    got = {r.id: (r.rms_dbfs, r.clipped_ratio) for r in levels.audio_levels(rows, F.col("s")).collect()}
    assert got == {"a": (float("-inf"), 0.0), "b": (0.0, 1.0) if got["b"][0] == 0 else (-0.0, 1.0), "c": (None, None)}
    drift = spark.createDataFrame([(1, -20.0), (1, -24.1), (2, float("-inf"))], "g int, rms_dbfs double")
    assert {r.g: r.ok for r in levels.level_drift(drift, ["g"]).collect()} == {1: False, 2: False}


def test_rows_guard_and_quarantine(spark):
    df = spark.range(5)
    assert C.assert_max_rows(df, 5) is df
    with pytest.raises(ValueError):
        C.assert_max_rows(df, 4)
    good, bad = C.split_quarantine(df.withColumn("error", F.when(F.col("id") == 2, "no")))
    assert good.count() == 4 and bad.first().id == 2 and good.columns == ["id"]
