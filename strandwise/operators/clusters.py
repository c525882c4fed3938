"""Clusters of samples by shared variants: mean linkage of Jaccard distances, cut at a height."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spectrum import KEY
from .trees import build_trees

VARIANT = [k for k in KEY if k != "reference_id"]


def reference_pairs(keys: DataFrame) -> DataFrame:
    """(reference_id, a, b, jaccard), a < b, of all samples with variants of a reference: 200 in a cohort, so 19,900 pairs each.

    Shared variants are counted in one self-join on the variant; samples that share none get their pair from the sizes.
    """
    size = keys.groupBy("reference_id", "sample_id").agg(F.count("*").alias("size"))
    side = lambda df, s: df.withColumnsRenamed({"sample_id": s, "size": f"size_{s}"})
    shared = side(keys, "a").join(side(keys, "b"), KEY).where("a < b").groupBy("reference_id", "a", "b").agg(F.count("*").alias("shared"))
    pairs = side(size, "a").join(side(size, "b"), "reference_id").where("a < b").join(shared, ["reference_id", "a", "b"], "left")
    n = F.coalesce("shared", F.lit(0))
    return pairs.select("reference_id", "a", "b", (n / (F.col("size_a") + F.col("size_b") - n)).alias("jaccard"))


def cut(trees: DataFrame, height: float) -> DataFrame:
    """(tree_id, cluster, name): the leaves of the largest parts of each tree that are no higher than `height`; a cluster is its part's node.

    Heights are compared to 12 digits, as they are sums of lengths.
    """
    leaf = trees.where("name is not null").select("tree_id", "name", F.col("depth").alias("leaf_depth"))
    below = trees.select("tree_id", "node", "parent", "depth", F.explode("leaves").alias("name")).join(leaf, ["tree_id", "name"])
    heights = below.groupBy("tree_id", "node", "parent").agg(F.round(F.max(F.col("leaf_depth") - F.col("depth")), 12).alias("height"))
    low = F.col("height") <= F.round(F.lit(height), 12)
    above = heights.select("tree_id", F.col("node").alias("parent"), low.alias("parent_low"))
    tops = heights.where(low).join(above, ["tree_id", "parent"], "left").where(~F.coalesce("parent_low", F.lit(False))).select("tree_id", F.col("node").alias("cluster"))
    return trees.join(tops.withColumnRenamed("cluster", "node"), ["tree_id", "node"]).select("tree_id", F.col("node").alias("cluster"), F.explode("leaves").alias("name"))


def shared_variant_clusters(spectrum: DataFrame, similarity: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(clusters, shared): clusters of each reference's samples, and the variants that all samples of a cluster carry.

    clusters is (reference_id, cluster, members, member_count, shared_variants, avg_jaccard), cluster being the least member; shared is
    (reference_id, cluster, variant's columns). Distances are 1 - Jaccard, and parts of the mean-linkage tree are cut at half
    of 1 - similarity. The mean Jaccard of a single member is 1. A reference with one sample has one cluster, without shared variants.
    """
    keys = spectrum.select("sample_id", *KEY).distinct()
    pairs = reference_pairs(keys)
    trees = build_trees(pairs.select(F.col("reference_id").alias("tree_id"), "a", "b", (1 - F.col("jaccard")).alias("distance")), "upgma")
    placed = cut(trees, (1 - similarity) / 2).select(F.col("tree_id").alias("reference_id"), F.col("cluster").alias("part"), F.col("name").cast(keys.schema["sample_id"].dataType).alias("sample_id"))
    lone = keys.groupBy("reference_id").agg(F.min("sample_id").alias("sample_id"), F.max("sample_id").alias("last")).where("sample_id = last").drop("last")
    placed = placed.withColumn("alone", F.lit(False)).unionByName(lone.select("reference_id", F.lit(-1).alias("part"), "sample_id", F.lit(True).alias("alone")))
    group = placed.groupBy("reference_id", "part", "alone").agg(F.min("sample_id").alias("cluster"), F.sort_array(F.collect_list("sample_id")).alias("members"), F.count("*").alias("member_count"))
    member = placed.join(group.select("reference_id", "part", "cluster", "member_count"), ["reference_id", "part"])
    held = keys.join(member.where("not alone"), ["reference_id", "sample_id"]).groupBy("reference_id", "cluster", "member_count", *VARIANT).agg(F.count("*").alias("carriers"))
    shared = held.where("carriers = member_count").select("reference_id", "cluster", *VARIANT)
    side = lambda s: member.select("reference_id", F.col("sample_id").alias(s), F.col("cluster").alias(f"cluster_{s}"))
    inner = pairs.join(side("a"), ["reference_id", "a"]).join(side("b"), ["reference_id", "b"]).where("cluster_a = cluster_b")
    mean = inner.groupBy("reference_id", F.col("cluster_a").alias("cluster")).agg(F.avg("jaccard").alias("avg_jaccard"))
    count = shared.groupBy("reference_id", "cluster").agg(F.count("*").alias("shared_variants"))
    out = group.join(mean, ["reference_id", "cluster"], "left").join(count, ["reference_id", "cluster"], "left")
    return out.select("reference_id", "cluster", "members", "member_count", F.coalesce("shared_variants", F.lit(0).cast("bigint")).alias("shared_variants"),
                      F.round(F.coalesce("avg_jaccard", F.lit(1.0)), 6).alias("avg_jaccard")), shared
