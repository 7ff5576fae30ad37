"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftline.session import settled

#: SHA-256 digits that give a uniform number: 13 hexadecimal digits are 52 bits, which a double holds exactly.
UNIFORM_DIGITS = 13


_HOLDER: list[tuple[str, Callable[[], None]]] = []


def claim(owner: str, forget: Callable[[], None]) -> None:
    """Called by a task that is about to remember things in its worker: what another operator remembered there is forgotten, and its
    memory given back."""
    if not _HOLDER or _HOLDER[0][0] != owner:
        for _, forget_other in _HOLDER:
            forget_other()
        _HOLDER[:] = [(owner, forget)]
        give_back()


def give_back() -> None:
    """Return memory that this worker has freed to the machine, as far as its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add under ``names`` (in either case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def hashed_bits(*parts: Column) -> Column:
    """52 bits from the SHA-256 of the parts as text, joined by ``|``; a null part counts as the text ``null``."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, UNIFORM_DIGITS), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return hashed_bits(*parts).cast("double") / F.lit(float(16**UNIFORM_DIGITS))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df``, which must be cheap to count (see ``settled``), with a broadcast hint if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def sampled_labels(labels: DataFrame, target: str, folds: int = 5, per_class: int = 4000, key: str = "doc_id") -> tuple[DataFrame, float]:
    """``(__key, __y)`` of labelled documents to learn from: those outside fold 0, about ``per_class`` of each class at most;
    and by how much the odds of label 1 among all labels exceed those in the sample.

    A class above the bound is thinned by a hash of the key, which needs no order and is the same in every run. Rows with a
    null key or label are no labels; a key with several labels has the largest.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(target).isNotNull()).where(remainder(F.col(key), folds) != 0)
    one = usable.groupBy(F.col(key).alias("__key")).agg(F.max(F.col(target).cast("int")).alias("__y"))
    counts = {r["__y"]: r["count"] for r in one.groupBy("__y").count().collect()}  # two rows
    rates = {y: min(1.0, per_class / n) for y, n in counts.items()}
    rate = F.lit(1.0)
    for y, r in rates.items():
        rate = F.when(F.col("__y") == y, F.lit(r)).otherwise(rate)
    return one.where(uniform(F.lit("sample"), F.col("__key")) < rate), rates.get(0, 1.0) / rates.get(1, 1.0)


def with_least(rows: DataFrame, group: str, value: str, name: str, most: int = 1000, keep: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """``rows`` (cheap to read, see ``settled``) with the least ``value`` of their group as ``name``; a group of more than ``most``
    rows meets its name in many tasks. ``keep`` writes what is read several times."""
    least = keep(rows.groupBy(group).agg(F.min(value).alias(name), F.ceil(F.count(F.lit(1)) / most).cast("int").alias("__parts")))
    large = broadcast_if_small(keep(least.where("__parts > 1").select(group, "__parts")), 200_000)
    salted = rows.join(large, group, "left").withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    every = least.select(group, name, F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__salt"))
    return salted.join(every, [group, "__salt"]).drop("__salt")


def text_hash(text: str) -> Column:
    """``th``, which tells texts apart; a null text is empty."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("th")


def representatives(docs: DataFrame, found: DataFrame, key: str, text: str, most_broadcast: int, keep: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """The rows of ``docs`` with the smallest key of their component, and those without a key.

    found: ``(key, th, root, component)`` of each row, cheap to read: the key, the ``text_hash``, the component and its smallest key.
    Rows are told by key and text, so an id that is used for texts of several components loses none of them unless that component
    has another representative. Of rows of one component that share a key, one stays. ``keep`` writes what the result still reads.
    """
    named = found.where("key = component")
    several = named.groupBy("key", "root").agg(F.min("th").alias("least"), F.max("th").alias("most")).where("least <> most")
    extra = found.where("key <> component").select("key", "th").unionByName(named.join(several, ["key", "root"]).where("th <> least").select("key", "th"))
    extra = keep(extra.select(F.col("key").alias("__key"), F.col("th").alias("__extra")).distinct())
    marked = docs.withColumn("__th", text_hash(text))
    kept = marked.join(broadcast_if_small(extra, most_broadcast), (F.col(f"`{key}`") == F.col("__key")) & (F.col("__th") == F.col("__extra")), "left_anti")
    if named.groupBy("key", "th").count().where("count > 1").limit(1).count():
        kept = kept.where(F.col(f"`{key}`").isNotNull()).dropDuplicates([key, "__th"]).unionByName(kept.where(F.col(f"`{key}`").isNull()))
    return kept.drop("__th")
