"""Levels of sample arrays and drift inside sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.values import dbfs

FULL, CLIP = 32768.0, 32767.0


def audio_levels(df: DataFrame, samples: Column, full: float = FULL, clip: float = CLIP, places: int = 3) -> DataFrame:
    """``df`` with n_samples, rms_dbfs, peak_dbfs (negative infinity for silence) and clipped_ratio; nulls for no samples."""
    values = F.transform(samples, lambda x: x.cast("double"))
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x)
    peak = F.aggregate(values, F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x)))
    some = lambda c: F.when(n > 0, c)
    return df.select("*", n.cast("long").alias("n_samples"), some(F.round(dbfs(F.sqrt(total / n), full), places)).alias("rms_dbfs"), some(F.round(dbfs(peak, full), places)).alias("peak_dbfs"),
                     some(F.size(F.filter(values, lambda x: F.abs(x) >= clip)) / n).alias("clipped_ratio"))


def level_drift(levels: DataFrame, group: Sequence[str], level: str = "rms_dbfs", limit: float = 4.0) -> DataFrame:
    """Largest less smallest finite level of each group; infinite where none is finite. ``ok`` within the limit."""
    finite = F.when((F.abs(level) < float("inf")) & ~F.isnan(level), F.col(level))
    drift = F.coalesce(F.round(F.max(finite) - F.min(finite), 3), F.lit(float("inf")))
    return levels.groupBy(*group).agg(drift.alias("drift")).withColumn("ok", F.col("drift") <= limit)


def block_levels(blocks: DataFrame, recording: Sequence[str], samples: Column, full: float = FULL, clip: float = CLIP, places: int = 3) -> DataFrame:
    """``audio_levels`` of each recording whose samples come as blocks, rows with an array each, in any order.

    A block is reduced to its sums where it is read, and sums are merged, so that no recording is ever one array or one task.
    """
    values = F.transform(samples, lambda x: x.cast("double"))
    parts = blocks.select(
        *recording, F.greatest(F.size(values), F.lit(0)).cast("long").alias("__n"), F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x).alias("__squares"),
        F.aggregate(values, F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x))).alias("__peak"), F.size(F.filter(values, lambda x: F.abs(x) >= clip)).alias("__clipped"))
    n = F.sum("__n")
    some = lambda c: F.when(n > 0, c)
    return parts.groupBy(*recording).agg(
        n.alias("n_samples"), some(F.round(dbfs(F.sqrt(F.sum("__squares") / n), full), places)).alias("rms_dbfs"), some(F.round(dbfs(F.max("__peak"), full), places)).alias("peak_dbfs"),
        some(F.sum(F.when(F.col("__n") > 0, F.col("__clipped"))) / n).alias("clipped_ratio"))
