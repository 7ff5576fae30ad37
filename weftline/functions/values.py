"""Functions of dates, URLs, numbers, arrays and boxes as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ZONED = r"(?:[Zz]|[+-]\d{2}:?\d{2})$"


def valid_ts(c: Column) -> Column:
    """A timestamp text with a zone."""
    return F.coalesce(F.try_to_timestamp(c).isNotNull() & c.rlike(ZONED), F.lit(False))


def valid_day(c: Column) -> Column:
    """A strict ISO calendar day."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull(), F.lit(False))


def valid_date(c: Column) -> Column:
    """Null, or an ISO day or timestamp."""
    return c.isNull() | valid_day(c) | F.coalesce(F.try_to_timestamp(c).isNotNull() & c.contains("T"), F.lit(False))


def valid_http_url(c: Column) -> Column:
    """http or https, with a host and without user information."""
    part = lambda p: F.try_parse_url(c, F.lit(p))
    return F.coalesce(F.lower(part("PROTOCOL")).isin("http", "https") & (part("HOST") != "") & part("USERINFO").isNull(), F.lit(False))


def url_origin(c: Column) -> Column:
    """Scheme, lower-case host and port, the scheme's own port left out; null for a malformed URL."""
    scheme = F.lower(F.try_parse_url(c, F.lit("PROTOCOL")))
    host, port = F.lower(F.try_parse_url(c, F.lit("HOST"))), F.regexp_extract(F.try_parse_url(c, F.lit("AUTHORITY")), ":([0-9]+)$", 1)
    own = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.concat(scheme, F.lit("://"), host, F.when(own, "").otherwise(F.concat(F.lit(":"), port)))


def safe_rel_path(c: Column, prefix: str | None = None) -> Column:
    """A path that isn't absolute, has no ``..``, and begins with the required folder if one is named."""
    parts = F.split(c, "/")
    ok = ~c.startswith("/") & ~F.exists(parts, lambda p: p == "..") & (c != "")
    return F.coalesce(ok & (F.element_at(parts, 1) == prefix) if prefix else ok, F.lit(False))


def ratio_matches(ratio: Column, width: Column, height: Column) -> Column:
    """Whether ``a:b`` is the shape of width by height, by whole numbers."""
    a, b = (F.get(F.split(ratio, ":"), F.lit(k)).try_cast("long") for k in (0, 1))
    return F.coalesce((F.size(F.split(ratio, ":")) == 2) & (a > 0) & (b > 0) & (width * b == height * a), F.lit(False))


def box_in_canvas(box: Column, width: Column, height: Column, margin: Column) -> Column:
    """Whether a box (x, y, width, height) is at least ``margin`` away from all four sides."""
    ok = (box["x"] >= margin) & (box["y"] >= margin) & (box["width"] > 0) & (box["height"] > 0) & (box["x"] + box["width"] <= width - margin) & (box["y"] + box["height"] <= height - margin)
    return F.coalesce(ok, F.lit(False))


def frame_rate(c: Column) -> Column:
    """A rate written ``n/d`` or as a number; null where it is neither."""
    parts = F.split(c, "/")
    return F.when(F.size(parts) == 2, F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))).otherwise(c.try_cast("double"))


def same_rate(c: Column, expected: float, tolerance: float = 0.01) -> Column:
    return F.coalesce(F.abs(frame_rate(c) - expected) <= tolerance, F.lit(False))


def rotation(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360))


def valid_id_array(c: Column, least: int = 1) -> Column:
    """An array of at least ``least`` texts, none blank and none twice."""
    return F.coalesce((F.size(c) >= least) & F.forall(c, lambda x: F.coalesce(x.rlike(r"(?U)\S"), F.lit(False))) & (F.size(F.array_distinct(c)) == F.size(c)), F.lit(False))


def layered(*values: Column, zero_is_unset: bool = False) -> Column:
    """The first value that is set: argument, configuration, preset, constant. ``zero_is_unset`` also passes over zeros."""
    return F.coalesce(*[F.when(v != 0, v) if zero_is_unset and k < len(values) - 1 else v for k, v in enumerate(values)])


def shanghai_day_start(moment: Column) -> Column:
    """The UTC time at which the moment's calendar day in Shanghai began."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(moment, "Asia/Shanghai")), "Asia/Shanghai")


def dbfs(level: Column, full: float = 32768.0) -> Column:
    """Decibels of full scale; negative infinity for silence."""
    return F.when(level > 0, 20 * F.log10(level / full)).otherwise(F.lit(float("-inf")))
