"""Exact duplicates by content hash, manifests and asset lists. Only hashes, positions and ids are shuffled, never contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def duplicate_groups(df: DataFrame, digest: str, position: str, key: str) -> DataFrame:
    """Hashes of more than one row: ``members`` and ``first_id``, the id of the first by position. Rows without a hash are in no group."""
    return df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count(F.lit(1)).alias("members"), F.min_by(key, F.struct(position, key)).alias("first_id")).where("members > 1")


def mark_duplicates(df: DataFrame, digest: str, position: str, key: str) -> DataFrame:
    """``df`` with ``exact_duplicate``: another row with the same content comes first.

    The first of each content comes from a partial aggregation and is joined back, so a content with very many copies is
    neither sorted nor held in one task.
    """
    first = df.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("__d")).agg(F.min(F.struct(F.col(position).alias("p"), F.col(key).alias("k"))).alias("__f"))
    joined = df.join(first, F.col(digest) == F.col("__d"), "left")
    return joined.withColumn("exact_duplicate", F.coalesce(F.struct(F.col(position).alias("p"), F.col(key).alias("k")) > F.col("__f"), F.lit(False))).drop("__d", "__f")


def asset_targets(df: DataFrame, digest: str, position: str, key: str) -> DataFrame:
    """``df`` with ``target_id``: the id under which the content is copied once, that of its first row. A row without a hash is its
    own target."""
    first = df.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("__d")).agg(F.min_by(key, F.struct(position, key)).alias("__t"))
    return df.join(first, F.col(digest) == F.col("__d"), "left").withColumn("target_id", F.coalesce("__t", F.col(key))).drop("__d", "__t")


def summary(df: DataFrame, group: str, category: str, digest: str) -> DataFrame:
    """Counts of each group: items, supported and unsupported ones, members of duplicate groups, those groups, and items by category
    as ``category:n`` in order of the names."""
    size = df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count(F.lit(1)).alias("__n"))
    again = F.col("__n") > 1
    # by category and content first, so that what meets in a group is small however many rows it has
    cells = df.groupBy(group, category, digest).agg(F.count(F.lit(1)).alias("__rows")).join(size, digest, "left")
    kinds = cells.groupBy(group, category).agg(F.sum("__rows").alias("__rows")).groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", category, F.col("__rows").cast("string")))), " ").alias("categories"))
    rows = lambda when, name: F.coalesce(F.sum(F.when(when, F.col("__rows"))), F.lit(0)).alias(name)
    counts = cells.groupBy(group).agg(F.sum("__rows").alias("total"), rows(F.col(category) != "unsupported", "supported"), rows(F.col(category) == "unsupported", "unsupported"), rows(again, "in_duplicate_groups"), F.count_distinct(F.when(again, F.col(digest))).alias("duplicate_groups"))
    return counts.join(kinds, group)
