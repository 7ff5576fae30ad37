"""Values from the rows before and after a row, in the order of its key, where one key may hold a third of all rows.

A window puts a key into one task. So keys of more than ``most`` rows are cut into ranges of about a quarter of that: every range is worked on by
itself and reduced to a summary (its size, first and last value, largest value, sum), the summaries of a key are scanned, and each
range is finished with what the ranges before it, or the next one, leave. All other keys go through a plain window. Both ways give
the same values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from weftline.session import Kept

#: Rows of a key above which it is cut into ranges, and rows of summaries that are broadcast.
HOT_ROWS, FEW = 1_000_000, 100_000


@dataclass(frozen=True)
class Frame:
    """What is wanted of a row's neighbours: ``place`` (from 1), ``previous`` or ``next`` value of the rows beside it, ``max_before`` or
    ``sum_before`` over all earlier rows (null where there is none that has a value)."""

    kind: str
    value: Column | None = None


def _over(frame: Frame, by: WindowSpec) -> Column:
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    return {
        "place": lambda: F.row_number().over(by).cast("long"),
        "previous": lambda: F.lag(frame.value).over(by),
        "next": lambda: F.lead(frame.value).over(by),
        "max_before": lambda: F.max(frame.value).over(before),
        "sum_before": lambda: F.sum(frame.value).over(before),
    }[frame.kind]()


def _same(group: Sequence[str], left: str, right: str) -> Column:
    """Whether the keys of both sides are the same; a null key is one like others."""
    out = F.lit(True)
    for g in group:
        out = out & F.col(f"{left}.{g}").eqNullSafe(F.col(f"{right}.{g}"))
    return out


def with_frames(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], frames: Mapping[str, Frame], most: int = HOT_ROWS) -> DataFrame:
    """``df`` with a column for each of ``frames``, by key ``group`` and ``order``. Rows that tie in the order are in any order.

    Names with ``__frame``, ``__range``, ``__v_`` and ``__c_`` in front are taken.
    """
    plain = lambda rows: rows.withColumns({name: _over(f, Window.partitionBy(*group).orderBy(*order)) for name, f in frames.items()})
    kept = Kept(df.sparkSession)
    hot_keys = kept.write(df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most))
    if not kept.rows(hot_keys):
        kept.drop_all()
        return plain(df)
    ranges = -(-4 * hot_keys.agg(F.sum("__n")).first()[0] // most)
    keys = F.broadcast(hot_keys) if kept.rows(hot_keys) <= FEW else hot_keys
    rows, keys = df.alias("__rows"), keys.alias("__keys")
    cool = rows.join(keys, _same(group, "__rows", "__keys"), "left_anti")
    hot = rows.join(keys, _same(group, "__rows", "__keys"), "left_semi")
    return plain(cool).unionByName(_ranged(hot, group, order, frames, ranges, kept))


def _ranged(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], frames: Mapping[str, Frame], ranges: int, kept: Kept) -> DataFrame:
    """The frames of rows whose keys are cut into so many ranges. Every (key, range) is a window of its own."""
    dealt = df.repartitionByRange(ranges, *[F.col(g) for g in group], *order).withColumn("__range", F.spark_partition_id())
    inside = Window.partitionBy(*group, "__range").orderBy(*order)
    values = {f"__v_{n}": f.value for n, f in frames.items() if f.value is not None}
    done = kept.write(dealt.withColumns(values).withColumns({n: _over(Frame(f.kind, F.col(f"__v_{n}") if f.value is not None else None), inside) for n, f in frames.items()} | {"__frame_at": F.row_number().over(inside)}))
    reduced = {"place": lambda v: F.count(F.lit(1)), "previous": lambda v: F.max_by(F.struct(v), "__frame_at"), "next": lambda v: F.min_by(F.struct(v), "__frame_at"), "max_before": F.max, "sum_before": F.sum}
    summaries = done.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__size"), *[reduced[f.kind](F.col(f"__v_{n}") if f.value is not None else None).alias(f"__c_{n}") for n, f in frames.items()])
    scanned = Window.partitionBy(*group).orderBy("__range")
    earlier = scanned.rowsBetween(Window.unboundedPreceding, -1)
    scan = {"place": lambda c: F.sum(c).over(earlier), "previous": lambda c: F.lag(c).over(scanned), "next": lambda c: F.lead(c).over(scanned), "max_before": lambda c: F.max(c).over(earlier), "sum_before": lambda c: F.sum(c).over(earlier)}
    carried = kept.write(summaries.select(*group, "__range", "__size", *[scan[f.kind](F.col(f"__c_{n}")).alias(f"__c_{n}") for n, f in frames.items()]))
    few = F.broadcast(carried) if kept.rows(carried) <= FEW else carried
    met = done.alias("__rows").join(few.alias("__sums"), _same([*group, "__range"], "__rows", "__sums"), "left")

    def finished(name: str, frame: Frame) -> Column:
        own, carry = F.col(f"__rows.{name}"), F.col(f"__sums.__c_{name}")
        if frame.kind == "place":
            return own + F.coalesce(carry, F.lit(0))
        if frame.kind == "previous":
            return F.when(F.col("__rows.__frame_at") == 1, carry[f"__v_{name}"]).otherwise(own)
        if frame.kind == "next":
            return F.when(F.col("__rows.__frame_at") == F.col("__sums.__size"), carry[f"__v_{name}"]).otherwise(own)
        if frame.kind == "max_before":
            return F.greatest(own, carry)
        return F.coalesce(own + carry, own, carry)

    return met.select(*[F.col(f"__rows.{c}") for c in df.columns], *[finished(n, f).alias(n) for n, f in frames.items()])
