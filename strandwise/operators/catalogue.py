"""A catalogue of thirty mutational signatures, made from seeds, and what matches it."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The signatures and the contexts in which each has its peaks; N stands for any base.
PEAKS = {
    "SBS1": ("N[C>T]G", "N[C>T]T"), "SBS2": ("T[C>T]T", "T[C>G]T"), "SBS3": ("C[C>A]C", "T[T>C]T"), "SBS4": ("C[A>G]C", "G[T>C]T"), "SBS5": ("T[C>T]C", "C[T>C]T"),
    "SBS6": ("C[T>C]T", "G[A>G]A"), "SBS7a": ("T[C>T]T", "C[C>T]T"), "SBS7b": ("T[C>T]C", "T[C>T]T"), "SBS7c": ("G[C>T]A", "T[C>T]G"), "SBS7d": ("T[C>T]A", "A[C>T]T"),
    "SBS8": ("T[A>C]A", "A[T>C]T"), "SBS9": ("C[T>A]T", "G[A>T]A"), "SBS10a": ("T[C>T]T", "C[T>G]T"), "SBS10b": ("G[T>G]T", "A[C>G]C"), "SBS11": ("N[C>T]N",),
    "SBS12": ("C[T>A]G", "G[A>T]C"), "SBS13": ("T[C>G]T", "T[C>G]C"), "SBS14": ("G[T>A]T", "A[C>A]T"), "SBS15": ("C[C>T]G", "G[G>A]C"), "SBS16": ("T[C>G]A", "A[G>C]T"),
    "SBS17a": ("T[T>C]A", "A[A>G]T"), "SBS17b": ("T[T>G]A", "A[A>C]T"), "SBS18": ("C[A>C]A", "T[G>T]T"), "SBS19": ("C[G>T]C", "G[C>A]G"), "SBS20": ("T[T>G]T", "A[A>C]A"),
    "SBS21": ("G[T>C]G", "C[A>G]C"), "SBS22": ("A[T>A]T", "T[A>T]A"), "SBS23": ("T[C>A]T", "A[G>T]A"), "SBS24": ("C[A>T]C", "G[T>A]G"), "SBS30": ("C[G>T]T", "A[C>A]G"),
}
#: The seed of the n-th signature is n times this; what a peak and another context draw from; a match from this similarity on is reliable.
SEED, PEAK, OTHER, RELIABLE = 12_345, (0.02, 0.05), (0.001, 0.01), 0.8
#: The 96 contexts, substitutions first.
CONTEXTS = [f"{left}[{ref}>{alt}]{right}" for ref in "CT" for alt in "ACGT" if alt != ref for left in "ACGT" for right in "ACGT"]


def _is_peak(context: str, peaks: tuple[str, ...]) -> bool:
    return any(p[1:6] == context[1:6] and p[0] in ("N", context[0]) and p[6] in ("N", context[6]) for p in peaks)


def signature(n: int) -> list[float]:
    """The probabilities of the n-th signature's contexts: draws of its own generator, in proportion."""
    rng, peaks = random.Random(n * SEED), list(PEAKS.values())[n]
    drawn = [rng.uniform(*(PEAK if _is_peak(c, peaks) else OTHER)) for c in CONTEXTS]
    total = sum(drawn)
    return [x / total for x in drawn]


def reference_signatures(spark: SparkSession) -> DataFrame:
    """(signature_id, mutation_type, p): 30 x 96 rows. Lists go by signature_id as text."""
    rows = [(name, c, p) for n, name in enumerate(PEAKS) for c, p in zip(CONTEXTS, signature(n), strict=True)]
    return spark.createDataFrame(rows, "signature_id string, mutation_type string, p double")


def matches(profiles: DataFrame, references: DataFrame, k: int = 3) -> DataFrame:
    """(id, rank, signature_id, similarity, reliable): the k nearest signatures of each profile (id, mutation_type, p) by cosine.

    Products are summed over contexts in one equi-join with the 30 signatures, so a profile's rows meet 30 numbers each. A profile of zeros, or
    without a context in common, has similarity 0 with all. Contexts that a profile lacks are zero.
    """
    norm = lambda df, by, name: df.groupBy(by).agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias(name))
    refs = references.withColumnRenamed("p", "q")
    small = F.broadcast(refs)  # 2,880 rows
    dots = profiles.where("p <> 0").join(small, "mutation_type").groupBy("id", "signature_id").agg(F.sum(F.col("p") * F.col("q")).alias("dot"))
    sizes = F.broadcast(norm(references, "signature_id", "ref_norm"))  # 30 rows
    all_ = norm(profiles, "id", "norm").crossJoin(sizes).join(dots, ["id", "signature_id"], "left")  # 30 rows a profile
    size = F.col("norm") * F.col("ref_norm")
    all_ = all_.withColumn("similarity", F.when(size == 0, 0.0).otherwise(F.round(F.coalesce("dot", F.lit(0.0)) / size, 6)))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "signature_id"))
    return all_.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "signature_id", "similarity", (F.col("similarity") >= RELIABLE).alias("reliable"))
