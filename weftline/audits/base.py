"""Rules of one table, evaluated together in one pass over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.text import is_blank

#: A rule: its id, when a row breaks it, and its severity, "error" unless a column says otherwise.
Rule = tuple


def broken(df: DataFrame, path: Column, rules: Sequence[Rule], entity: str = "plan_id") -> DataFrame:
    """Violations of all rules by rows of ``df``. A condition that is null isn't met."""

    def one(rule: str, condition: Column, severity: Column | str = "error", detail: Column | None = None) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(condition, F.struct(F.lit(rule).alias("rule_id"), level.alias("severity"), (F.lit("") if detail is None else detail.cast("string")).alias("detail")))

    found = F.array_compact(F.array(*[one(*r) for r in rules]))
    return df.select(F.col(entity).cast("string").alias("entity_id"), path.alias("path"), F.explode(found).alias("v")).select("entity_id", "v.rule_id", "v.severity", "path", "v.detail")


def blank(*columns: str) -> list[Rule]:
    """Rules that texts are there, named after them."""
    return [(f"{c} is required", is_blank(F.col(c))) for c in columns]


def not_in(column: Column | str, allowed: Sequence) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return ~F.coalesce(c.isin(*allowed), F.lit(False))


def not_true(column: str) -> Column:
    return ~F.col(column).eqNullSafe(F.lit(True))


def not_false(column: str) -> Column:
    return ~F.col(column).eqNullSafe(F.lit(False))


def texts(ids: Column, least: int = 1) -> Column:
    """Whether an array has at least so many elements and none is blank."""
    return F.coalesce((F.size(ids) >= least) & ~F.exists(ids, lambda x: F.coalesce(is_blank(x), F.lit(True))), F.lit(False))


def children(df: DataFrame, array: str, *keep: str, entity: str = "plan_id") -> DataFrame:
    """Rows for the elements of a nested array: the entity, kept columns, ``pos`` and the element's fields."""
    rows = df.select(entity, *keep, F.posexplode(array).alias("pos", "__x"))
    return rows.select(entity, *keep, "pos", "__x.*")


def label(array: str) -> Column:
    return F.concat(F.lit(f"{array}["), F.col("pos").cast("string"), F.lit("]"))
