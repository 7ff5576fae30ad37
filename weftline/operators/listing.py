"""Listings: facets, search, time windows, orders and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.values import shanghai_day_start

UNKNOWN, ALL = "unknown", "all"
DEFAULT_PAGE, MOST_PAGE, MOST_DAYS = 20, 100, 366


def faceted(df: DataFrame, chosen: Mapping[str, Sequence], groups: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Rows that match one of the chosen values in every dimension. A dimension left out, empty or ``all`` doesn't restrict.

    ``unknown`` chooses null. A code that ``groups`` names stands for its members.
    """
    for dimension, codes in chosen.items():
        wanted = [m for c in codes for m in (groups or {}).get(c, [c])]
        if not wanted or ALL in wanted:
            continue
        known = [c for c in wanted if c != UNKNOWN]
        match = F.coalesce(F.col(dimension).isin(*known), F.lit(False)) if known else F.lit(False)
        df = df.where(match | F.col(dimension).isNull() if UNKNOWN in wanted else match)
    return df


def search(df: DataFrame, columns: Sequence[str], text: str, longest: int = 2000) -> DataFrame:
    """Rows with the text, as it stands, in one of the columns."""
    if len(text) > longest:
        raise ValueError(f"a search has at most {longest} characters")
    return df.where(reduce(Column.__or__, [F.coalesce(F.contains(F.col(c), F.lit(text)), F.lit(False)) for c in columns]))


def updated_since(df: DataFrame, column: str, moment: Column) -> DataFrame:
    return df.where(F.col(column) >= moment)


def overlapping(df: DataFrame, start: Column, end: Column, low: Column, high: Column) -> DataFrame:
    """Rows whose [start, end] meets [low, high); rows with an unknown bound are left out."""
    return df.where((start < high) & (end >= low))


def day_window(now: Column, days: int) -> tuple[Column, Column]:
    """From the start of today in Shanghai to the end of the ``days``-th day, in UTC."""
    low = shanghai_day_start(now)
    return low, low + F.make_dt_interval(F.lit(days))


def time_filter(df: DataFrame, start: Column, end: Column, now: Column, date: str | None = None, time_range: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """One of three: ``date``, ``time_range`` (next7, next30), or ``date_from`` with ``date_to``; days are Shanghai's, ends included."""
    if sum((date is not None, time_range is not None, date_from is not None or date_to is not None)) > 1:
        raise ValueError("date, time_range and date_from/date_to exclude each other")
    if (date_from is None) != (date_to is None):
        raise ValueError("date_from and date_to go together")
    if time_range is not None:
        low, high = day_window(now, {"next7": 7, "next30": 30}[time_range])
    elif date is not None or date_from is not None:
        from datetime import date as day

        first, last = day.fromisoformat(date or date_from), day.fromisoformat(date or date_to)
        if not 0 <= (last - first).days < MOST_DAYS:
            raise ValueError(f"a range has 1 to {MOST_DAYS} days")
        low = F.to_utc_timestamp(F.lit(str(first)).cast("timestamp"), "Asia/Shanghai")
        high = F.to_utc_timestamp(F.date_add(F.lit(str(last)).cast("date"), 1).cast("timestamp"), "Asia/Shanghai")
    else:
        return df
    return overlapping(df, start, end, low, high)


def same_child(parents: DataFrame, children: DataFrame, on: Column, *predicates: Column) -> DataFrame:
    """Parents of which one child meets all predicates at once."""
    return parents.join(children.where(reduce(Column.__and__, predicates)), on, "left_semi")


def facets(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """The values of each dimension with how many rows have them: dimension, value, n."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit(UNKNOWN)).alias("value")) for d in dimensions])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def listing_order(mode: str, updated: str, deadline: str, key: str) -> list[Column]:
    """``updated``: newest first; ``deadline``: nearest first, unknown last. The key settles ties."""
    return [F.desc(updated), F.asc(key)] if mode == "updated" else [F.asc_nulls_last(deadline), F.asc(key)]


def event_rank(start: Column, end: Column, now: Column) -> Column:
    """0 for what is to come, 1 for what is going on, 2 where the time isn't known, 3 for what is over."""
    return F.when(start.isNull(), 2).when(start > now, 0).when(end.isNull() | (end >= now), 1).otherwise(3)


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = DEFAULT_PAGE) -> DataFrame:
    """The ``number``-th page, from 1."""
    if number < 1 or not 1 <= size <= MOST_PAGE:
        raise ValueError(f"pages count from 1 and have 1 to {MOST_PAGE} rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_totals(df: DataFrame, number: int = 1, size: int = DEFAULT_PAGE) -> DataFrame:
    """One row about a page: total, page, page_size, has_more. The total stands for an empty page too."""
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", F.lit(number).alias("page"), F.lit(size).alias("page_size"), (F.col("total") > number * size).alias("has_more"))
