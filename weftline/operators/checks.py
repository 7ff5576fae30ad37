"""Checks that turn any table into violations, and checks between tables.

A check returns rows of what is wrong, so that the audit of a record is a union of checks. Keys are lists of column names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.text import is_blank

SEVERITIES = ("error", "warning")
VIOLATION = ("entity_id", "rule_id", "severity", "path", "detail")


def violation(df: DataFrame, rule: str, entity: Column, path: Column | str = "", detail: Column | str = "", severity: Column | str = "error") -> DataFrame:
    """Rows of ``df`` as violations."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(entity.cast("string").alias("entity_id"), F.lit(rule).alias("rule_id"), as_column(severity).alias("severity"), as_column(path).cast("string").alias("path"), as_column(detail).cast("string").alias("detail"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def outside_domain(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Rows whose value isn't one of ``allowed``; null isn't."""
    return df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def outside_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).between(low, high), F.lit(False)))


def missing_when(df: DataFrame, condition: Column, column: str) -> DataFrame:
    """Rows where the condition holds and the text is blank."""
    return df.where(condition & is_blank(F.col(column)))


def demoted(condition: Column) -> Column:
    """Severity of a row that an exception note excuses."""
    return F.when(condition, "warning").otherwise("error")


def not_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that stand in more than one row, with ``n``; null keys are values too."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def not_exactly_one(df: DataFrame, group: Sequence[str], condition: Column) -> DataFrame:
    """Groups in which the condition doesn't hold for exactly one row, with ``n``."""
    return df.groupBy(*group).agg(F.count_if(condition).alias("n")).where("n <> 1")


def too_few_distinct(df: DataFrame, group: Sequence[str], value: str, least: int, when: Column) -> DataFrame:
    """Groups with fewer different values than ``least``, of those where the aggregate condition ``when`` holds."""
    return df.groupBy(*group).agg(F.count_distinct(value).alias("n_distinct"), when.alias("__when")).where(F.col("__when") & (F.col("n_distinct") < least)).drop("__when")


def missing_members(df: DataFrame, group: Sequence[str], value: str, required: Sequence[str]) -> DataFrame:
    """Groups that lack some of ``required``, with the ``missing`` ones in order."""
    need = F.array(*map(F.lit, required))
    return df.groupBy(*group).agg(F.array_sort(F.array_except(need, F.collect_set(F.when(F.col(value).isin(*required), F.col(value))))).alias("missing")).where(F.size("missing") > 0)


def without_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    return parents.join(children.select(F.col(child_key).alias("__k")), F.col(parent_key) == F.col("__k"), "left_anti")


def not_uniform(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Groups of more than one row that don't share one value in each column, nulls left aside; with the numbers of values."""
    counts = [F.count_distinct(c).alias(f"n_{c}") for c in columns]
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *counts).where("n > 1").where(reduce(Column.__or__, [F.col(f"n_{c}") > 1 for c in columns])).drop("n")


def broken_references(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose reference names no parent. Filter ``parent`` first where only some may be named."""
    return child.join(parent.select(F.col(parent_key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")


def broken_array_references(child: DataFrame, ids: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` for each element of the array ``ids`` that names no parent, in ``ref``."""
    return broken_references(child.withColumn("ref", F.explode(ids)), "ref", parent, parent_key)


def key_differences(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side alone, with ``status`` missing or unexpected."""
    a, b = (df.select(*keys).distinct().withColumn(m, F.lit(True)) for df, m in ((expected, "__e"), (actual, "__a")))
    return a.join(b, list(keys), "full_outer").where("__e is null or __a is null").select(*keys, F.when(F.col("__a").isNull(), "missing").otherwise("unexpected").alias("status"))


def unequal(a: DataFrame, b: DataFrame, keys: Sequence[str], left: str, right: str, tolerance: float) -> DataFrame:
    """Rows of both tables that meet on the keys and differ by more than the tolerance; a null on one side differs."""
    x, y = F.col(left), F.col(right)
    return a.join(b, list(keys)).where(F.coalesce(F.abs(x - y) > tolerance, x.isNotNull() | y.isNotNull()))


def incomplete_grid(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells that should be there once: missing ones with n = 0, repeated ones with their n."""
    return expected.join(actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), list(keys), "left").select(*keys, F.coalesce("__n", F.lit(0)).cast("long").alias("n")).where("n <> 1")


def inconsistent(a: DataFrame, b: DataFrame, on: Column, left: Column, right: Column) -> DataFrame:
    """Joined rows of two records of one job that should agree and don't; null agrees with null alone."""
    return a.join(b, on).where(~left.eqNullSafe(right))


def snapshot_differences(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys that are missing now, new, or changed."""
    a, b = old.select(key, F.col(digest).alias("__old"), F.lit(1).alias("__a")), new.select(key, F.col(digest).alias("__new"), F.lit(1).alias("__b"))
    status = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "added").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status")).where("status is not null")


def outside_interval(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, duration: str) -> DataFrame:
    """Points that aren't in [0, duration) of their parent."""
    return points.join(spans, list(keys)).where(~F.coalesce((F.col(at) >= 0) & (F.col(at) < F.col(duration)), F.lit(False)))


def not_within(inner: DataFrame, outer: DataFrame, keys: Sequence[str], start: str, length: str, duration: str, tolerance: float = 0.0) -> DataFrame:
    """Inner intervals that reach beyond [0, duration] of their parent."""
    return inner.join(outer, list(keys)).where(~F.coalesce((F.col(start) >= 0) & (F.col(start) + F.col(length) <= F.col(duration) + tolerance), F.lit(False)))


def assert_max_rows(df: DataFrame, most: int) -> DataFrame:
    """``df``, or ValueError if it has more rows than ``most``; reads no more than it must."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def split_quarantine(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows, without the error column, and bad rows."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())
