"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.llm.common import hashed_bits, uniform, without
from weftline.session import settled

#: Rates table rows up to which it is broadcast; beyond, the join is left to Spark, which splits hot sources at run time.
BROADCAST_ROWS = 50_000


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, as far as 52 uniform bits can tell values apart.

    Summed from logarithms, so a large rate doesn't underflow at zero.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate / k)
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))


def temperature_rates(docs: DataFrame, alpha: float = 0.5, by: str = "source", text: str = "text") -> DataFrame:
    """Mean repetitions of a document of each source, ``(source, rate)``.

    A source's target share of the characters is its own share to the power ``alpha``, scaled to sum to one, and the mixture
    is as long as the input: rate = target share * all characters / the source's characters. A source without characters
    counts as one character. Null is a source like any other.
    """
    sizes = docs.groupBy(F.col(f"`{by}`").alias("source")).agg(F.greatest(F.coalesce(F.sum(F.length(f"`{text}`")), F.lit(0)), F.lit(1)).cast("double").alias("chars"))
    sizes = settled(sizes)
    chars, powers = sizes.agg(F.sum("chars"), F.sum(F.pow("chars", F.lit(alpha)))).first()  # two numbers
    return sizes.select("source", (F.pow("chars", F.lit(alpha)) / F.lit(powers) * F.lit(chars) / F.col("chars")).alias("rate"))


def weight_rates(docs: DataFrame, weights: DataFrame, by: str = "source", text: str = "text") -> DataFrame:
    """As :func:`temperature_rates`, for given ``(source, weight)``; a source without a weight has rate 0."""
    sizes = settled(docs.groupBy(F.col(f"`{by}`").alias("source")).agg(F.greatest(F.coalesce(F.sum(F.length(f"`{text}`")), F.lit(0)), F.lit(1)).cast("double").alias("chars")))
    given = weights.groupBy("source").agg(F.sum("weight").cast("double").alias("weight"))
    joined = sizes.join(given, sizes["source"].eqNullSafe(given["source"]), "left").select(sizes["source"], "chars", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    chars, total = joined.agg(F.sum("chars"), F.sum("weight")).first()  # two numbers
    return joined.select("source", (F.col("weight") / F.lit(total) * F.lit(chars) / F.col("chars") if total else F.lit(0.0)).alias("rate"))


def replicate(docs: DataFrame, rates: DataFrame, seed: str = "mix", by: str = "source", key: str = "doc_id") -> DataFrame:
    """Each document as many times as its Poisson number says, all copies in one global random order.

    The number is the inverse of the Poisson distribution with the source's rate at a uniform number hashed from the seed
    and the key, so it doesn't depend on partitions, retries or other rows. Adds ``copy_no`` (from 0) and ``shuffle_key``
    (52 hashed bits); input columns of these names are replaced. Rows go to partitions by a hash of ``shuffle_key`` and are
    sorted by it inside, so partition after partition is a random order of all copies.

    Repeated rows, and rows that share a key, are each replicated, by the same number. A null key is a key like any other; a
    null source has its own rate. A source that ``rates`` doesn't have yields no copies. An empty table gives an empty table.
    """
    by_source = settled(rates.select(F.col("source").alias("__source"), poisson_cdf(F.col("rate")).alias("__cdf")))
    if by_source.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        by_source = F.broadcast(by_source)
    base = without(docs, "copy_no", "shuffle_key")
    key_column = F.col(f"`{key}`")
    counted = base.join(by_source, F.col(f"`{by}`").eqNullSafe(F.col("__source"))).withColumn("__n", F.size(F.filter("__cdf", lambda p: p <= uniform(F.lit(seed), key_column))))
    copies = counted.where("__n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n").cast("long") - 1)))
    placed = copies.withColumn("shuffle_key", hashed_bits(F.lit(seed), F.lit("order"), key_column, F.col("copy_no"))).select(*[f"`{c}`" for c in base.columns], "copy_no", "shuffle_key")
    return placed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
