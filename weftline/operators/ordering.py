"""A rank over a whole table without putting it into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.session import settled


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with its place, from 1, in a total order. Equal rows have different places.

    Rows are dealt by ranges and sorted there; a place is the place in the range plus the sizes of the ranges before, of which
    there are as many as partitions.
    """
    keyed = df.withColumn("__key", F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)]))
    dealt = settled(keyed.repartitionByRange("__key").withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__key"))
    return dealt.withColumn("__in", inside).join(F.broadcast(sizes), "__part").withColumn(name, (F.col("__in") + F.col("__before")).cast("long")).drop("__key", "__part", "__in", "__before")
