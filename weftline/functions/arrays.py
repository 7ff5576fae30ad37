"""Array helpers whose work grows with the array and not with its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Elements that are folded at once.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def worked_out(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with columns that are worked out once a row, however many filters and columns after them name them.

    Spark moves a filter below the columns that it reads, and puts one on an array that is exploded, and either repeats their work.
    It moves none below an explosion, here that of an array of one.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in values.items()]))))


def blocks(values: Column, size: int = BLOCK) -> Column:
    """An array as an array of arrays of at most ``size`` elements."""

    def cut(v: Column) -> Column:
        n = F.size(v)
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / size), F.lit(0)).cast("int")), lambda b: F.slice(v, b * size + 1, F.lit(size)))
        return F.when(n > 0, parts).otherwise(F.slice(parts, F.lit(1), F.lit(0)))

    return let(values, cut)


def _sums(numbers: Column) -> Column:
    """For a short array, 0 and all sums of its first numbers."""
    return F.aggregate(numbers, F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def sums_before(numbers: Column) -> Column:
    """For each number of an array of bigint, the sum of those before it."""
    inner = lambda parts: F.transform(parts, _sums)

    def joined(sums: Column) -> Column:
        bases = _sums(F.transform(sums, lambda s: F.element_at(s, -1)))
        return let(bases, lambda base: F.flatten(F.transform(sums, lambda s, i: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda x: x + F.get(base, i)))))

    return let(inner(blocks(numbers)), joined)
