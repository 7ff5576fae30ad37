"""Runs, gaps and orders inside groups. A group may hold a third of all rows: see ``frames``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weftline.operators.frames import HOT_ROWS, Frame, with_frames


def longest_run(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, most: int = HOT_ROWS) -> DataFrame:
    """Each group's longest run of one value in a row, ``run_value`` and ``run_length``; of equal runs the first. Null is a value."""
    seen = with_frames(df, group, order, {"__at": Frame("place"), "__last": Frame("previous", F.struct(F.col(value).alias("v")))}, most)
    begins = seen.where(F.col("__last").isNull() | ~F.col("__last.v").eqNullSafe(F.col(value)))
    # a run is as long as it is from its beginning to the next one's, or to the end
    ends = with_frames(begins.select(*group, value, "__at"), group, ["__at"], {"__next": Frame("next", F.col("__at"))}, most)
    sizes = seen.groupBy(*group).agg(F.max("__at").alias("__size"))
    best = F.max(F.struct("__n", (-F.col("__at")).alias("f"), F.col(value).alias("v"))).alias("b")
    last = ends.where("__next is null").withColumn("__keep", F.lit(True))
    whole = ends.where("__next is not null").withColumn("__n", F.col("__next") - F.col("__at"))
    tail = last.alias("l").join(sizes.alias("s"), _same(group), "inner").select(*[F.col(f"l.{c}") for c in (*group, value, "__at")], (F.col("s.__size") - F.col("l.__at") + 1).alias("__n"))
    runs = whole.select(*group, value, "__at", "__n").unionByName(tail)
    return runs.groupBy(*group).agg(best).select(*group, F.col("b.v").alias("run_value"), F.col("b.__n").alias("run_length"))


def _same(group: Sequence[str]) -> Column:
    out = F.lit(True)
    for g in group:
        out = out & F.col(f"l.{g}").eqNullSafe(F.col(f"s.{g}"))
    return out


def max_gap(df: DataFrame, group: Sequence[str], start: Column, end: Column, duration: Column, counts: Column | None = None, most: int = HOT_ROWS) -> DataFrame:
    """Each group's longest part of [0, duration] that no interval covers, as ``max_gap``.

    Intervals are clamped to [0, duration]. Where ``counts`` is given, intervals for which it isn't true cover nothing; a group
    without intervals that count has the whole duration.
    """
    lo = F.least(F.greatest(start, F.lit(0.0)), duration)
    hi = F.greatest(F.least(end, duration), lo)
    on = F.lit(True) if counts is None else F.coalesce(counts, F.lit(False))
    rows = df.select(*group, duration.alias("__d"), F.when(on, lo).alias("__lo"), F.when(on, hi).alias("__hi"))
    covered = with_frames(rows, group, [F.asc_nulls_last("__lo"), F.asc("__hi")], {"__before": Frame("max_before", F.col("__hi"))}, most)
    gaps = covered.withColumn("__gap", F.greatest(F.col("__lo") - F.coalesce("__before", F.lit(0.0)), F.lit(0.0)))
    tail = F.max("__d") - F.coalesce(F.max("__hi"), F.lit(0.0))
    return gaps.groupBy(*group).agg(F.greatest(F.max("__gap"), tail).alias("max_gap"))


def neighbours(df: DataFrame, group: Sequence[str], order: Sequence[str], start: Column, end: Column, tolerance: float = 0.05, most: int = HOT_ROWS) -> DataFrame:
    """Neighbours that overlap (error) or leave a gap (warning) by more than the tolerance, as ``status`` and ``seconds``."""
    rows = with_frames(df, group, order, {"__end": Frame("previous", end)}, most).withColumn("__step", start - F.col("__end")).where(F.abs("__step") > tolerance)
    return rows.withColumn("status", F.when(F.col("__step") < 0, "overlap").otherwise("gap")).withColumn("seconds", F.abs("__step")).drop("__step", "__end")


def not_strictly_increasing(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, most: int = HOT_ROWS) -> DataFrame:
    """Rows whose value isn't above all earlier ones; a row that fails doesn't raise the mark, as it can't be the largest."""
    return with_frames(df, group, order, {"previous_max": Frame("max_before", F.col(value))}, most).where(F.col(value) <= F.col("previous_max"))


def decreasing(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, most: int = HOT_ROWS) -> DataFrame:
    """Rows whose value is below that of the row before."""
    return with_frames(df, group, order, {"previous": Frame("previous", F.col(value))}, most).where(F.col(value) < F.col("previous"))


def exact_sequence(df: DataFrame, group: Sequence[str], order: str, value: str, expected: Sequence[str], most: int = HOT_ROWS) -> DataFrame:
    """Each group with whether its values, in order (ties by value), are exactly ``expected``, as ``matches``.

    Rows are compared by place and the hits counted, so no group is held as a list.
    """
    placed = with_frames(df, group, [order, value], {"__at": Frame("place")}, most)
    hit = F.col(value) == F.get(F.array(*map(F.lit, expected)), F.col("__at").cast("int") - 1)
    return placed.groupBy(*group).agg(((F.count(F.lit(1)) == len(expected)) & (F.count_if(hit) == len(expected))).alias("matches"))


def first_row_rule(df: DataFrame, group: Sequence[str], order: str, value: str, opening: Sequence[str], most: int = HOT_ROWS) -> DataFrame:
    """Rows that break the rule that the first row of a group, and no other, has an opening value; with ``place`` from 1."""
    rows = with_frames(df, group, [order], {"place": Frame("place")}, most)
    opens = F.coalesce(F.col(value).isin(*opening), F.lit(False))
    return rows.where((F.col("place") == 1) != opens)


def adjacent_pairs(df: DataFrame, group: Sequence[str], order: str, value: str, most: int = HOT_ROWS) -> DataFrame:
    """Each row but a group's last, with the value after it as ``next_value``."""
    rows = with_frames(df, group, [order], {"__next": Frame("next", F.struct(F.col(value).alias("v")))}, most)
    return rows.where(F.col("__next").isNotNull()).withColumn("next_value", F.col("__next.v")).drop("__next")


def check_adjacent(sequence: DataFrame, pairs: DataFrame, group: Sequence[str], order: str, item: str) -> DataFrame:
    """Neighbours in ``sequence`` against declared ``pairs`` (group, from_id, to_id): ``missing``, ``not_adjacent``, ``duplicate``."""
    there = adjacent_pairs(sequence, group, order, item).select(*group, F.col(item).alias("from_id"), F.col("next_value").alias("to_id"))
    keys = [*group, "from_id", "to_id"]
    told = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    status = F.when(F.col("__n").isNull(), "missing").when(F.col("__there").isNull(), "not_adjacent").when(F.col("__n") > 1, "duplicate")
    return there.withColumn("__there", F.lit(True)).join(told, keys, "full_outer").select(*keys, status.alias("status")).where("status is not null")


def points_in_spans(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Points joined with the spans of their key that hold them, [start, end).

    Time is cut into bins of ``width``; a span is copied to the bins it touches and a point is in one, so that points and spans of a
    crowded key meet in many tasks and only where they are near. Columns of spans must have other names, the keys apart.
    """
    binned = points.withColumn("__bin", F.floor(F.col(at) / width))
    copied = spans.where(F.col(end) > F.col(start)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return binned.join(copied, [*keys, "__bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bin")


def overlapping_spans(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str, end: str, other_start: str, other_end: str, width: float) -> DataFrame:
    """Spans of both tables that overlap, by key. Both are copied to the bins they touch; a pair is reported by the bin in which the
    later of the two begins."""
    copied = lambda df, a, b: df.where(F.col(b) > F.col(a)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))
    met = copied(left, start, end).join(copied(right, other_start, other_end), [*keys, "__bin"])
    later = F.greatest(start, other_start)
    return met.where((F.col("__bin") == F.floor(later / width)) & (later < F.least(end, other_end))).drop("__bin")
