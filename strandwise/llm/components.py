"""Connected components of a link table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of links (a, b), the smallest node it reaches.

    Each round ties a node's larger neighbours to the smallest one around it, then its smaller ones to the
    smallest (large star, small star); rounds end when all links point at a root. Links, not paths, are
    kept, so a round costs one pass over them; hubs are met by partial aggregation and by joins AQE can split.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = materialize(small.where("u <> v").distinct(), "small")
        # done when no node is both a child and a parent, and each child has one parent
        state = small.agg(F.count("*").alias("n"), F.count_distinct("u").alias("children")).first()
        middle = small.select("u").join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        edges = small
        if state["n"] == state["children"] and not middle:
            break
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
