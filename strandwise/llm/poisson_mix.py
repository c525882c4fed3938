"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source has a mean repetition rate (target rows over rows). A document's count is the inverse of
the Poisson distribution at a uniform number hashed from its doc_id and a seed, so that any executor
finds the same count again. Documents are exploded by that count and dealt out by a hash of (doc_id, copy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: A rate over PART is split into equal parts, whose counts add up to one of the whole rate.
PART = 16.0
#: Thresholds of one part: the chance of more than TERMS copies is below 2**-60.
TERMS = 72
OUT = ("copy", "shuffle_key")


def uniform_key(*parts: Column) -> Column:
    """52 bits of SHA-256 over the parts, as a bigint."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 13), 16, 10).cast("bigint")


def tempered_rates(docs: DataFrame, exponent: float, epochs: float = 1.0) -> DataFrame:
    """(source, rate): weights in proportion to rows ** exponent; epochs * rows documents are expected in all."""
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.sum(F.pow("n", F.lit(exponent))).alias("mass"))
    return n.crossJoin(total).select(  # total is one row
        "source", (F.lit(float(epochs)) * F.pow("n", F.lit(exponent)) / F.col("mass") * F.col("total") / F.col("n")).alias("rate"))


def weighted_rates(docs: DataFrame, weights: dict[str, float], epochs: float = 1.0) -> DataFrame:
    """(source, rate) for given target weights; a source without a weight gets rate 0."""
    mass = float(sum(weights.values()))
    pairs = [x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w) / mass))]
    share = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("total"))).select("source", (share * float(epochs) * F.col("total") / F.col("n")).alias("rate"))


def with_thresholds(rates: DataFrame) -> DataFrame:
    """(source, parts, cdf): the distribution function of Poisson(rate / parts) at 0, 1, .., to 12 digits."""
    part = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    part = part.withColumn("__l", F.col("rate") / F.col("parts"))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.exp(-F.col("__l")).alias("p"), F.exp(-F.col("__l")).alias("c"), F.array(F.round(F.exp(-F.col("__l")), 12)).alias("all")),
        lambda a, k: F.struct(
            (a["p"] * F.col("__l") / k).alias("p"), (a["c"] + a["p"] * F.col("__l") / k).alias("c"),
            F.concat(a["all"], F.array(F.round(a["c"] + a["p"] * F.col("__l") / k, 12))).alias("all")),
        lambda a: a["all"])
    return part.select("source", "parts", terms.alias("cdf"))


def poisson_mix(docs: DataFrame, rates: DataFrame, seed: int = 17) -> DataFrame:
    """docs, each row as often as its count says, with copy (1, 2, ..) and shuffle_key, in a random global order.

    Rows with a null source form a source of their own. A rate of 0 or null drops the source. Rows that
    share a doc_id get the same count; a null doc_id counts as the empty string. Null and empty
    texts are replicated like others. Input columns named copy or shuffle_key are replaced.
    """
    docs = docs.drop(*OUT)
    table = materialize(with_thresholds(rates.where("rate > 0").select(F.col("source").alias("__source"), "rate").withColumnRenamed("__source", "source")), "rates")
    table = table.select(F.col("source").alias("__s"), F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    mixed = docs.join(table, F.col("source").eqNullSafe(F.col("__s")))  # AQE broadcasts it when small, and splits a hot source when not
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("__parts")), F.lit(0),
        lambda n, j: n + F.size(F.filter(F.col("__cdf"), lambda c: c <= uniform_key(F.lit(seed), ident, j) / F.lit(float(1 << 52)))))
    one = F.size(F.filter(F.col("__cdf"), lambda c: c <= F.col("__u")))
    mixed = mixed.withColumn("__u", uniform_key(F.lit(seed), ident, F.lit(1)) / F.lit(float(1 << 52)))
    mixed = mixed.withColumn("__n", F.when(F.col("__parts") == 1, one).otherwise(drawn)).where("__n > 0")
    copies = mixed.drop("__s", "__parts", "__cdf", "__u").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
    copies = copies.withColumn("shuffle_key", uniform_key(F.lit(seed), ident, F.col("copy"), F.lit("order")))
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")
