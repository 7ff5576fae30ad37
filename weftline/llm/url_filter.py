"""URL filters by a temporal list join. DataFrame functions only.

A filter list is a log of dated entries (key, effective_at, action): from that time on the key is blocked, allowed or off the
list. The entries of a key become validity intervals, and an as-of join gives every capture the entry that was active when the
page was fetched. Time is cut into days, so that all work on a key is split by day: slices of a day are built by a window over
(key, day), what is carried into a day comes from a window over the key's days (one row a day), and captures meet slices on
(key, day) and the moment inside it. A host with a third of all captures is therefore many groups, one for each day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.llm.common import hashed_bits
from weftline.session import settled

DAY = 86_400
#: Specificity of the kinds of keys, least first.
LEVELS = ("domain", "host", "path", "url")
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """Lower-case host without user and port; empty where the text is no absolute URL."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), "^.*@", ""), ":[0-9]*$", "")


def url_keys(url: Column) -> Column:
    """The keys a list may name a page by, as an array of (level, key): parent domains of two labels or more, host, host and
    first path segment, host and whole path. None for a text that is no absolute URL."""
    host, path = url_host(url), F.regexp_extract(url, URL, 2)
    labels = F.split(host, r"\.")
    parents = F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(2), F.size(labels) - 1), lambda i: F.struct(F.lit(0).alias("level"), F.array_join(F.slice(labels, F.size(labels) - i + 1, i), ".").alias("key"))))
    one = lambda level, key: F.struct(F.lit(level).alias("level"), key.alias("key"))
    segment = F.regexp_extract(path, "^/([^/]+)/", 1)
    none = F.expr("cast(array() as array<struct<level:int,key:string>>)")
    keys = F.concat(
        F.coalesce(parents, none),
        F.array(one(1, host)),
        F.when(segment != "", F.array(one(2, F.concat(host, F.lit("/"), segment, F.lit("/"))))).otherwise(none),
        F.when(F.length(path) > 1, F.array(one(3, F.concat(host, path)))).otherwise(none),
    )
    return F.when(host != "", keys).otherwise(none)


def day_of(second: Column) -> Column:
    return F.floor(second / DAY)


def day_slices(entries: DataFrame, key_days: DataFrame) -> DataFrame:
    """For each (key, day) of ``key_days``: the entry active in each part of the day, as (key, day, lo, hi, action, since).

    Of entries of a key at one moment, the last action in the alphabet holds. A part of a day before the key's first entry has no row.
    """
    log = entries.where("key is not null and effective_at is not null").groupBy("key", "effective_at").agg(F.max("action").alias("action")).withColumn("day", day_of(F.col("effective_at")))
    within = log.withColumn("hi", F.coalesce(F.lead("effective_at").over(Window.partitionBy("key", "day").orderBy("effective_at")), (F.col("day") + 1) * DAY))
    inside = within.select("key", "day", F.col("effective_at").alias("lo"), "hi", "action", F.col("effective_at").alias("since"))
    ends = log.groupBy("key", "day").agg(F.max(F.struct("effective_at", "action")).alias("last"), F.min("effective_at").alias("first"))
    absent = F.lit(None)
    days = ends.unionByName(key_days.select("key", "day").distinct().withColumn("last", absent.cast(ends.schema["last"].dataType)).withColumn("first", absent.cast("long")))
    days = days.groupBy("key", "day").agg(F.max("last").alias("last"), F.max("first").alias("first"))
    before = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.withColumn("carry", F.last("last", ignorenulls=True).over(before)).where("carry is not null")
    start = F.col("day") * DAY
    early = carried.select("key", "day", start.alias("lo"), F.coalesce("first", start + DAY).alias("hi"), F.col("carry.action").alias("action"), F.col("carry.effective_at").alias("since"))
    return inside.unionByName(early).where("lo < hi")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Each capture (page_id, url, fetched_at in epoch seconds) with the verdict of the list at its fetch time.

    The most specific key with an entry active then decides: ``block`` or ``allow``; an entry ``off`` takes the key off the list.
    Without any, and for a null or malformed URL or a null time, the verdict is ``unlisted``. Returns page_id, url, fetched_at,
    host, verdict, matched_key and listed_at, one row for each row of ``captures``, repeated ones included.
    """
    url = F.col("url")
    same = captures.groupBy("page_id", "url", "fetched_at").agg(F.count(F.lit(1)).alias("copies"))
    keyed = same.select("*", F.explode_outer(url_keys(url)).alias("k")).select("page_id", "url", "fetched_at", "copies", "k.level", "k.key", day_of(F.col("fetched_at")).alias("day"))
    slices = day_slices(entries, keyed.where("key is not null and day is not null").select("key", "day").distinct())
    met = keyed.alias("c").join(slices.alias("s"), (F.col("c.key") == F.col("s.key")) & (F.col("c.day") == F.col("s.day")) & (F.col("c.fetched_at") >= F.col("s.lo")) & (F.col("c.fetched_at") < F.col("s.hi")), "left")
    active = F.when(F.col("s.action").isin("block", "allow"), F.struct("c.level", F.length("c.key").alias("n"), "c.key", "s.action", "s.since"))
    best = met.select("page_id", "url", "fetched_at", "copies", active.alias("hit")).groupBy("page_id", "url", "fetched_at", "copies").agg(F.max("hit").alias("hit"))
    each = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("page_id", "url", "fetched_at", url_host(url).alias("host"), F.coalesce("hit.action", F.lit("unlisted")).alias("verdict"), F.col("hit.key").alias("matched_key"), F.col("hit.since").alias("listed_at"))


#: The invented times of the query: 30 days from 1 January 2024.
FIRST_SECOND, SECONDS = 1_704_067_200, 30 * DAY


def dated_captures(pages: DataFrame) -> DataFrame:
    """``pages`` has no times, so each capture gets one, hashed from its id and URL."""
    return pages.select("page_id", "url", (F.lit(FIRST_SECOND) + hashed_bits(F.lit("fetch"), F.col("page_id"), F.col("url")) % SECONDS).alias("fetched_at"))


def invented_entries(pages: DataFrame) -> DataFrame:
    """A list log over the keys that the pages have: up to four entries a key, with times and actions hashed from the key."""
    keys = pages.select(F.explode(url_keys(F.col("url"))).alias("k")).select("k.level", "k.key").distinct()
    each = keys.withColumn("n", F.explode(F.sequence(F.lit(0), (hashed_bits(F.lit("entries"), F.col("key")) % 5).cast("int")))).where("n > 0")
    action = F.element_at(F.array(*map(F.lit, ("block", "allow", "off"))), (hashed_bits(F.lit("action"), F.col("key"), F.col("n")) % 3 + 1).cast("int"))
    return each.select("key", (F.lit(FIRST_SECOND) + hashed_bits(F.lit("time"), F.col("key"), F.col("n")) % SECONDS).alias("effective_at"), action.alias("action"))


def filtered_pages(pages: DataFrame) -> DataFrame:
    """The query: all pages against the invented list. The captures are written once, as the pages' texts are far larger."""
    slim = settled(pages.select("page_id", "url"))
    return filter_urls(dated_captures(slim), invented_entries(slim))
